"""The entry points, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_agrees(spark, db, name):
    assert oracle.difference(spark, entry.queries()[name], entry.oracle_sql()[name], FOLDER, db) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_run(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module", params=["empty", "null"])
def bare(spark, request, tmp_path_factory):
    """The tables without rows, or with three rows of nothing but nulls."""
    folder = tmp_path_factory.mktemp(request.param)
    for path in Path(FOLDER).glob("*.parquet"):
        rows = spark.read.parquet(str(path)).limit(3 if request.param == "null" else 0)
        rows.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.parquet(str(folder / path.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_bare_tables(spark, bare, name):
    assert entry.queries()[name](spark, bare).count() >= 0


def test_every_bid_has_the_whole_catalogue(spark):
    from tendrel import catalog

    names = [f.name for f in catalog.fields()]
    rows = entry.queries()["catalogue_fields"](spark, FOLDER).collect()
    bids = {r.bid_id for r in rows}
    assert sorted((r.bid_id, r.position, r.field_name) for r in rows) == sorted((b, k, n) for b in bids for k, n in enumerate(names, 1))
    assert {n for n in names if any(r.value for r in rows if r.field_name == n)} == set(names)
    assert {r.total for r in entry.queries()["catalogue_counts"](spark, FOLDER).collect()} == {20}
