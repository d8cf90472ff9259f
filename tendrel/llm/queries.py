"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.llm import boilerplate, encoding, leakage, mixing, splitting, truncation, visual
from tendrel.plans.registry import Registry
from tendrel.sources.tables import table

QUERIES = Registry()


@QUERIES.query(
    "p1_found",
    "SELECT chunk_key FROM chunks WHERE length(trim(text, concat(' ', chr(9), chr(10), chr(13)))) > 1000",
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limit: those that come out in more than one piece, each by its second piece."""
    return splitting.split_texts(table(spark, folder, "chunks")).where("piece_no = 2").select("chunk_key")


@QUERIES.query("p1_pieces")
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk in pieces of at most 1,000 characters that share 200, with the pages they stem from."""
    return splitting.split_texts(table(spark, folder, "chunks"))


@QUERIES.query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes that are in their chunk, but spelt with other characters."""
    return visual.respelt_quotes(table(spark, folder, "evidence"), table(spark, folder, "chunks"))


@QUERIES.query("p2_forms")
def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every quote and chunk text."""
    quotes = table(spark, folder, "evidence").selectExpr("'quote' AS kind", "evidence_key AS key", "quote AS text")
    texts = table(spark, folder, "chunks").selectExpr("'chunk' AS kind", "chunk_key AS key", "text")
    return visual.normalise_text(quotes.unionByName(texts), {"text": "text"})


@QUERIES.query("p6_cleaned")
def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold evaluation passages, without them."""
    return leakage.without_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@QUERIES.query("p7_mix")
def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix, with the copies that each contributes."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@QUERIES.query("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches, beside its target."""
    return mixing.mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return encoding.repair_encoding(documents, "doc_id", model=encoding.fit_text_model(documents))


@QUERIES.query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage decoded with the wrong encoding."""
    return _repaired(spark, folder).select("doc_id")


@QUERIES.query("p8_restored")
def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with their original text, as far as it can be regained."""
    return _repaired(spark, folder)


@QUERIES.query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections whose text breaks off before its end."""
    return truncation.cut_sections(table(spark, folder, "sections")).select("section_key")


@QUERIES.query("p4_rates")
def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut section rows of every feed."""
    return truncation.cut_rates(table(spark, folder, "sections"))


@QUERIES.query("p4_reasons")
def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many sections of every feed are cut, by what shows it."""
    return truncation.cut_reasons(table(spark, folder, "sections"))


def _line_model(spark: SparkSession, folder: str) -> boilerplate.LineModel:
    return boilerplate.fit_line_model(table(spark, folder, "sections"), table(spark, folder, "agencies"))


@QUERIES.query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of html sections that belong to the page and not to the notice."""
    labelled = boilerplate.label_lines(table(spark, folder, "sections"), _line_model(spark, folder))
    lines = F.explode(F.col("furniture").cast("array<long>")).alias("line_no")
    return labelled.select("section_key", lines)


@QUERIES.query("p5_bodies")
def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every html section."""
    return boilerplate.main_body(table(spark, folder, "sections"), _line_model(spark, folder))


_NGRAMS = r"SELECT DISTINCT {0}, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {0}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {1}))"


@QUERIES.query(
    "p6_found",
    f"SELECT DISTINCT doc_id, item_id FROM ({_NGRAMS.format('doc_id', 'documents')}) JOIN ({_NGRAMS.format('item_id', 'eval_items')}) USING (gram)",
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return leakage.found_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")
