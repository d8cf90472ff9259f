"""Queries on retrieval: term statistics, literal search, field search, hashed embeddings, nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel import catalog as C
from tendrel.functions import text as X
from tendrel.operators import retrieval as R
from tendrel.operators.vectors import nearest
from tendrel.plans.registry import Registry
from tendrel.plans.text_queries import TOKENS
from tendrel.sources.tables import table

QUERIES = Registry()

_INDEX = f"""
corpus AS (SELECT bid_id, chunk_id, doc_id, source_format, section_identifier, {TOKENS.format("text")} AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY bid_id, chunk_id ORDER BY chunk_key) AS rn FROM chunks
    WHERE text <> '' AND chunk_id IS NOT NULL AND bid_id IS NOT NULL) WHERE rn = 1),
lens AS (SELECT bid_id, chunk_id, len(t) AS dl FROM corpus),
bids AS (SELECT bid_id, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY bid_id),
post AS (SELECT bid_id, chunk_id, token, count(*) AS tf FROM (SELECT bid_id, chunk_id, unnest(t) AS token FROM corpus) GROUP BY ALL),
dfs AS (SELECT bid_id, token, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT bid_id, token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs JOIN bids USING (bid_id)),
means AS (SELECT bid_id, avg(idf) AS mean FROM raw GROUP BY bid_id),
idfs AS (SELECT bid_id, token, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM raw JOIN means USING (bid_id))"""

_GAIN = "sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))"

_FIELDS = ", ".join(
    "('{}', [{}], '{}')".format(f.name, ", ".join("'" + a.replace("'", "''") + "'" for a in f.aliases), f.question.replace("'", "''")) for f in C.fields()
)

_RESIDUE = "0"
for _k in range(4):
    _RESIDUE = f"(({_RESIDUE} * 1296 + CAST(concat('0x', substr(md5(w), {8 * _k + 1}, 8)) AS BIGINT)) % 2000)"


@QUERIES.query(
    "term_statistics",
    f"""SELECT token, count(*) AS documents, sum(tf) AS occurrences FROM (
        SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS token FROM documents) GROUP BY ALL) GROUP BY token""",
)
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents every token occurs, and how often in all."""
    # Sorted words, each marked where it is the first of its kind in the document: one shuffle by token is enough.
    words = table(spark, folder, "documents").select(F.sort_array(X.tokens(F.col("text"))).alias("words"))
    marked = F.transform("words", lambda x, i: F.struct(x.alias("token"), ((i == 0) | (x != F.get("words", i - 1))).alias("first")))
    return (
        words.select(F.explode(marked).alias("w"))
        .groupBy(F.col("w.token").alias("token"))
        .agg(F.count_if("w.first").alias("documents"), F.count("*").alias("occurrences"))
    )


@QUERIES.query(
    "literal_search",
    f"""WITH {_INDEX},
    asked AS (SELECT evidence_key, bid_id, token, count(*) AS times FROM (
        SELECT evidence_key, bid_id, unnest({TOKENS.format("quote")}) AS token FROM evidence WHERE evidence_key % 20 = 0 AND quote IS NOT NULL) GROUP BY ALL),
    scored AS (SELECT evidence_key, bid_id, chunk_id, {_GAIN} AS score
        FROM asked JOIN idfs USING (bid_id, token) JOIN post USING (bid_id, token) JOIN lens USING (bid_id, chunk_id) JOIN bids USING (bid_id) GROUP BY ALL)
    SELECT evidence_key, bid_id, rank, chunk_id, round(score, 6) AS score FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY evidence_key ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE round(score, 9) > 0) WHERE rank <= 5""",
)
def literal_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best chunks of its bid for every 20th quote, by BM25."""
    asked = table(spark, folder, "evidence").where("evidence_key % 20 = 0 AND quote IS NOT NULL")
    return R.literal_search(table(spark, folder, "chunks"), asked.select("evidence_key", "bid_id", F.col("quote").alias("text")), "evidence_key")


@QUERIES.query(
    "hash_embeddings",
    f"""WITH w AS (SELECT chunk_key, unnest(CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END) AS w FROM (SELECT chunk_key, {TOKENS.format("text")} AS t FROM chunks WHERE text <> '')),
    r AS (SELECT chunk_key, {_RESIDUE} AS r, count(*) AS n FROM w GROUP BY ALL),
    v AS (SELECT chunk_key, i, CAST(sum(n * ((r + 17 * i) % 2000 - 1000)) AS BIGINT) AS v FROM r, range(256) AS x(i) GROUP BY ALL)
    SELECT chunk_key, max(v) FILTER (WHERE i = 0) AS c0, max(v) FILTER (WHERE i = 255) AS c255, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM v GROUP BY chunk_key""",
)
def hash_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The hashed embedding (times 1,000, before normalising) of every chunk: its first and last component and a digest of all."""
    rows = table(spark, folder, "chunks").where("text <> ''").select("chunk_key", X.tokens(F.col("text")).alias("words"))
    vectors = R.embeddings(rows, "chunk_key")
    ends = [F.get("vector", F.lit(i)).alias(f"c{i}") for i in (0, 255)]
    return vectors.select("chunk_key", *ends, F.md5(F.array_join("vector", ",")).alias("digest"))


@QUERIES.query(
    "nearest_vectors",
    """SELECT vec_id, rank, near_id, similarity FROM (
        SELECT q.vec_id, d.vec_id AS near_id, round(list_cosine_similarity(q.e, d.e), 6) AS similarity,
            CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, d.e), 9) DESC, d.vec_id) AS INTEGER) AS rank
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q,
            (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) d WHERE q.vec_id <> d.vec_id) WHERE rank <= 5""",
)
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every 20th one, by cosine, exactly."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


def field_search_sql(per_document: bool) -> str:
    """SQL of the field search; {K} are the columns of a group, {P} attaches the document."""
    keys = "bid_id, doc_id, field_name" if per_document else "bid_id, field_name"
    place = "JOIN homes USING (bid_id, chunk_id)" if per_document else ""
    return f"""WITH {_INDEX},
    homes AS (SELECT bid_id, chunk_id, doc_id FROM corpus),
    fields(field_name, aliases, question) AS (VALUES {_FIELDS}),
    alias AS (SELECT field_name, generate_subscripts(aliases, 1) AS alias_no, unnest(aliases) AS alias FROM fields),
    asked AS (SELECT field_name, alias_no, token, count(*) AS times FROM (SELECT field_name, alias_no, unnest({TOKENS.format("alias")}) AS token FROM alias) GROUP BY ALL),
    scored AS (SELECT * FROM (SELECT field_name, alias_no, bid_id, chunk_id, {_GAIN} AS score
        FROM asked JOIN idfs USING (token) JOIN post USING (bid_id, token) JOIN lens USING (bid_id, chunk_id) JOIN bids USING (bid_id) GROUP BY ALL) {place}),
    by_alias AS (SELECT *, row_number() OVER (PARTITION BY {keys}, alias_no ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE round(score, 9) > 0),
    lex AS (SELECT {keys}, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s FROM by_alias GROUP BY ALL),
    lexical AS (SELECT {keys}, chunk_id, row_number() OVER (PARTITION BY {keys} ORDER BY round(s, 9) DESC, chunk_id) AS lexical_rank FROM lex),
    cw AS (SELECT bid_id, chunk_id, unnest(CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END) AS w FROM corpus),
    cr AS (SELECT bid_id, chunk_id, {_RESIDUE} AS r, count(*) AS n FROM cw GROUP BY ALL),
    cv AS (SELECT bid_id, chunk_id, i, CAST(sum(n * ((r + 17 * i) % 2000 - 1000)) AS DOUBLE) AS v FROM cr, range(256) AS x(i) GROUP BY ALL),
    qw AS (SELECT field_name, unnest({TOKENS.format("question")}) AS w FROM fields),
    qr AS (SELECT field_name, {_RESIDUE} AS r, count(*) AS n FROM qw GROUP BY ALL),
    qv AS (SELECT field_name, i, CAST(sum(n * ((r + 17 * i) % 2000 - 1000)) AS DOUBLE) AS v FROM qr, range(256) AS x(i) GROUP BY ALL),
    cn AS (SELECT bid_id, chunk_id, sqrt(sum(v * v)) AS n FROM cv GROUP BY ALL),
    qn AS (SELECT field_name, sqrt(sum(v * v)) AS n FROM qv GROUP BY ALL),
    dots AS (SELECT bid_id, chunk_id, field_name, sum(cv.v * qv.v) AS dot FROM cv JOIN qv USING (i) GROUP BY ALL),
    sims AS (SELECT * FROM (SELECT bid_id, chunk_id, field_name, dot / (cn.n * qn.n) AS s FROM dots JOIN cn USING (bid_id, chunk_id) JOIN qn USING (field_name) WHERE dot > 0) {place}),
    semantic AS (SELECT {keys}, chunk_id, row_number() OVER (PARTITION BY {keys} ORDER BY round(s, 9) DESC, chunk_id) AS semantic_rank FROM sims),
    labelled AS (SELECT DISTINCT {keys}, chunk_id FROM corpus, alias WHERE source_format = 'html' AND length(trim(section_identifier)) >= 3
        AND (contains(lower(trim(section_identifier)), lower(alias)) OR contains(lower(alias), lower(trim(section_identifier))))),
    labels AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY chunk_id) AS label_rank FROM labelled),
    lists AS (SELECT {keys}, chunk_id, lexical_rank AS rank FROM lexical UNION ALL SELECT {keys}, chunk_id, semantic_rank FROM semantic
        UNION ALL SELECT {keys}, chunk_id, label_rank FROM labels),
    scores AS (SELECT {keys}, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM lists GROUP BY ALL),
    final AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(fused, 9) DESC, chunk_id) AS final_rank FROM scores),
    found AS (SELECT final.*, lexical_rank, semantic_rank, label_rank FROM final LEFT JOIN lexical USING ({keys}, chunk_id)
        LEFT JOIN semantic USING ({keys}, chunk_id) LEFT JOIN labels USING ({keys}, chunk_id) WHERE final_rank <= 6 OR lexical_rank <= 2)
    SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY CASE WHEN final_rank <= 6 THEN final_rank ELSE 6 + lexical_rank END) AS overall_rank,
        chunk_id, round(fused, 9) AS fused_score, lexical_rank, semantic_rank, label_rank IS NOT NULL AS label_hit, final_rank > 6 AS floor_inserted FROM found"""


@QUERIES.query("field_search", field_search_sql(False))
def field_search(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of every bid for each of the 20 fields, by fused lexical, semantic and label ranks."""
    return R.field_search(table(spark, folder, "chunks"))


@QUERIES.query("document_field_search", field_search_sql(True))
def document_field_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same, apart for every document of a bid."""
    return R.field_search(table(spark, folder, "chunks"), per_document=True)
