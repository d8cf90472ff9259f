"""Dates and times in many notations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tendrel.operators.instants import normalise_instants, same_statement_pairs

NY, CHICAGO, BERLIN, KOLKATA, SAO_PAULO, PHOENIX = "America/New_York", "America/Chicago", "Europe/Berlin", "Asia/Kolkata", "America/Sao_Paulo", "America/Phoenix"

CASES = [
    ("2022-03-31T02:00:00+00:00", NY, "mdy", "2022-03-31T02:00:00Z"),
    ("2023-11-14T00:45:00.000000Z", NY, "mdy", "2023-11-14T00:45:00Z"),
    ("20210422T044500Z", NY, "mdy", "2021-04-22T04:45:00Z"),
    ("2025-08-19 15:29:00 +05:30", NY, "mdy", "2025-08-19T09:59:00Z"),
    ("2023-02-23 15:00", CHICAGO, "mdy", "2023-02-23T21:00:00Z"),
    ("2024/11/03 16:30:00", BERLIN, "dmy", "2024-11-03T15:30:00Z"),
    ("1666445400", NY, "mdy", "2022-10-22T13:30:00Z"),
    ("1615323600000", NY, "mdy", "2021-03-09T21:00:00Z"),
    ("Sun, 06 Aug 2023 15:30:00 +0200", BERLIN, "dmy", "2023-08-06T13:30:00Z"),
    ("  March 29, 2021 11:01 AM (local time) ", NY, "mdy", "2021-03-29T15:01:00Z"),
    ("12:30 PM on August 25, 2025", CHICAGO, "mdy", "2025-08-25T17:30:00Z"),
    ("12 AM on August 25, 2025", CHICAGO, "mdy", "2025-08-25T05:00:00Z"),
    ("24-NOV-24 2359 hrs", KOLKATA, "dmy", "2024-11-24T18:29:00Z"),
    ("8. Dezember 2024, 11:30 Uhr", BERLIN, "dmy", "2024-12-08T10:30:00Z"),
    ("25 novembre 2024 à 23h59", "Europe/Paris", "dmy", "2024-11-25T22:59:00Z"),
    ("1 de noviembre de 2024, 13:00 h", "Europe/Madrid", "dmy", "2024-11-01T12:00:00Z"),
    # A written abbreviation holds literally, a named clock follows its region.
    ("July 21, 2022 at 9:45 AM CST", CHICAGO, "mdy", "2022-07-21T15:45:00Z"),
    ("July 21st, 2022, 9:45am Central Time", NY, "mdy", "2022-07-21T14:45:00Z"),
    ("January 21st, 2022, 9:45 a.m. ET", CHICAGO, "mdy", "2022-01-21T14:45:00Z"),
    # Twice: the first; skipped: forward by the gap.
    ("11/07/2021 1:30 AM", NY, "mdy", "2021-11-07T05:30:00Z"),
    ("2021-03-14 02:30", NY, "mdy", "2021-03-14T07:30:00Z"),
    ("28.03.2021 02:30", BERLIN, "dmy", "2021-03-28T01:30:00Z"),
    ("2021-07-01 12:00", PHOENIX, "mdy", "2021-07-01T19:00:00Z"),
    ("03/04/2021", NY, "mdy", "2021-03-04"),
    ("03/04/2021", SAO_PAULO, "dmy", "2021-04-03"),
    ("3/4/21", NY, None, "2021-03-04"),
    ("03.04.2021", NY, "mdy", "2021-04-03"),
    ("02-Jul-24", NY, "mdy", "2024-07-02"),
    ("Jul. 4, 2025", NY, "mdy", "2025-07-04"),
    ("Friday 24th of October 2025", NY, "mdy", "2025-10-24"),
    ("20230920", NY, "mdy", "2023-09-20"),
    ("23 mars 2022", "Europe/Paris", "dmy", "2022-03-23"),
    ("10 de abril de 2022", "Europe/Madrid", "dmy", "2022-04-10"),
    ("2024-02-29", NY, "mdy", "2024-02-29"),
    ("2023-02-29", NY, "mdy", None),
    ("2023-13-01", NY, "mdy", None),
    ("2023-01-01 25:00", NY, "mdy", None),
    ("13:00 PM on May 1, 2023", NY, "mdy", None),
    ("May 1, 2023 at 9:00 AM XYZ", NY, "mdy", None),
    ("2023-01-01 09:00", None, None, "2023-01-01T09:00:00Z"),
    ("TBD", NY, "mdy", None),
    ("see cover 2", NY, "mdy", None),
    ("", NY, "mdy", None),
    (None, NY, "mdy", None),
    ("x" * 50_000, NY, "mdy", None),
]


@pytest.fixture(scope="module")
def normalised(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, t string, z string, o string, want string").withColumn("instant", F.lit(1))
    return {r.k: r for r in normalise_instants(df, "t", "z", "o").select("k", "instant.*").collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=[str(c[0])[:30] for c in CASES])
def test_statement(normalised, k):
    assert normalised[k].stated == CASES[k][3]
    assert (normalised[k].at is not None) == (CASES[k][3] is not None and "T" in CASES[k][3])


def test_pairs(spark):
    rows = [(1, "a", "x", "s"), (2, "a", "y", "s"), (3, "a", "x", "s"), (4, "a", "y", "t"), (5, "b", "z", "s"), (6, None, "x", "s"), (7, "a", "w", None), (8, "a", "y", "s")]
    df = spark.createDataFrame(rows, "k long, g string, t string, s string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and a[3] and a[3] == b[3] and a[2] != b[2]}
    got = [(r.key_a, r.key_b) for r in same_statement_pairs(df, ["g"], "k", "t", "s").collect()]
    assert sorted(got) == sorted(want)
    assert same_statement_pairs(df.where("false"), ["g"], "k", "t", "s").count() == 0
