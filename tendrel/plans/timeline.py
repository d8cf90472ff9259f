"""Queries on dates and times (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.operators.instants import normalise_instants, same_statement_pairs
from tendrel.plans.registry import Registry
from tendrel.session import cut
from tendrel.sources.tables import table

QUERIES = Registry()


def _stated(spark: SparkSession, folder: str) -> DataFrame:
    """field_name, key, of, stated_as and instant of every due date and document date.

    agencies is a fixed table of 80 rows; Spark broadcasts it by its size.
    """
    due = table(spark, folder, "bid_records").select(
        F.lit("due_date").alias("field_name"), F.col("record_id").alias("key"), F.col("bid_id").alias("of"), "agency_id", F.col("due_date").alias("stated_as")
    )
    dated = table(spark, folder, "parsed_docs").select(
        F.lit("doc_date").alias("field_name"), F.col("parsed_key").alias("key"), F.col("doc_id").alias("of"), "agency_id", F.col("metadata.doc_date").alias("stated_as")
    )
    agencies = table(spark, folder, "agencies").select("agency_id", "time_zone", "date_order")
    return normalise_instants(due.unionByName(dated).join(agencies, "agency_id", "left"), "stated_as", "time_zone", "date_order")


@QUERIES.query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one bid or document whose dates are written differently and state the same."""
    rows = cut(_stated(spark, folder).select("field_name", "key", "of", "stated_as", F.col("instant.stated").alias("stated")))
    return same_statement_pairs(rows, ["field_name", "of"], "key", "stated_as", "stated").select("field_name", "key_a", "key_b")


@QUERIES.query("p3_instants")
def p3_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Every due date and document date as a UTC instant or a calendar day; null where it states no date."""
    return _stated(spark, folder).select("field_name", "key", "stated_as", F.col("instant.at").alias("at_utc"), F.col("instant.day").alias("day"))


@QUERIES.query("p3_classes")
def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same without pairs: every statement that a bid or document makes in several notations, with its rows and notations."""
    rows = _stated(spark, folder).select("field_name", "of", "stated_as", F.col("instant.stated").alias("stated"))
    texts = rows.where("of IS NOT NULL AND stated IS NOT NULL").groupBy("field_name", "of", "stated", "stated_as").agg(F.count("*").alias("n"))
    classes = texts.groupBy("field_name", "of", "stated").agg(F.sum("n").alias("stated_rows"), F.count("*").alias("notations"))
    return classes.where("notations > 1")
