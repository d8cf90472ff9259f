"""Queries on documents, evidence and records: order, neighbours, grounding, choice among values, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel import catalog as C
from tendrel.functions import text as X
from tendrel.operators import evidence as E
from tendrel.operators import packing
from tendrel.operators import retrieval as R
from tendrel.operators.retrieval import first_by
from tendrel.plans.registry import Registry
from tendrel.plans.retrieval_queries import field_search_sql
from tendrel.plans.text_queries import BLANKS, COMPARABLE, PUNCTUATION, TOKENS
from tendrel.session import cut
from tendrel.sources.tables import table

QUERIES = Registry()

NAMES = [f.name for f in C.fields()]
_SPACED = f"regexp_replace({{0}}, '{BLANKS}+', '{{1}}', 'g')"


def _q(form: str, *args: str) -> str:
    return form.format(*args)


@QUERIES.query(
    "document_sizes",
    r"""SELECT doc_id, sum(length(text)) AS text_chars, count(*) AS n_sections, array_to_string(list_sort(list(DISTINCT page) FILTER (WHERE page IS NOT NULL AND words < 10)), ',') AS low_pages
    FROM (SELECT doc_id, text, metadata.page_number AS page, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS words FROM sections)
    GROUP BY doc_id""",
)
def document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, sections and pages of few words of every document."""
    words = F.size(F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), " "), lambda x: x != ""))
    rows = table(spark, folder, "sections").select("doc_id", "text", F.col("metadata.page_number").alias("page"), words.alias("words"))
    low = F.array_sort(F.collect_set(F.when((F.col("words") < 10), F.col("page"))))
    return rows.groupBy("doc_id").agg(
        F.sum(F.length("text")).alias("text_chars"), F.count("*").alias("n_sections"), F.nullif(F.array_join(low, ","), F.lit("")).alias("low_pages")
    )


@QUERIES.query(
    "document_texts",
    """SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, string_agg(text, ' ' ORDER BY section_seq, section_key) AS t FROM sections WHERE text IS NOT NULL GROUP BY doc_id)""",
)
def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every document, its sections in order; given as length and digest."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_seq", "section_key", "text"))), lambda x: x["text"]), " ")
    texts = table(spark, folder, "sections").where("text IS NOT NULL").groupBy("doc_id").agg(joined.alias("t"))
    return texts.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@QUERIES.query(
    "first_chunks",
    "SELECT chunk_id, chunk_key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL AND text <> '') WHERE rn = 1",
)
def first_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk id: the first one wins."""
    return first_by(table(spark, folder, "chunks").where("chunk_id IS NOT NULL AND text <> ''"), ["chunk_id"], "chunk_key").select("chunk_id", "chunk_key", "doc_id")


@QUERIES.query(
    "latest_ingests",
    "SELECT doc_id, parsed_key, feed FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, parsed_key DESC) AS rn FROM parsed_docs) WHERE rn = 1",
)
def latest_ingests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: the last ingest wins."""
    rows = first_by(table(spark, folder, "parsed_docs"), ["doc_id"], F.col("ingested_at").desc(), F.col("parsed_key").desc())
    return rows.select("doc_id", "parsed_key", "feed")


@QUERIES.query(
    "different_evidence",
    """SELECT candidate_id, evidence_key, times FROM (SELECT candidate_id, evidence_key, count(*) OVER (PARTITION BY candidate_id, quote) AS times,
        row_number() OVER (PARTITION BY candidate_id, quote ORDER BY evidence_key) AS rn FROM evidence) WHERE rn = 1""",
)
def different_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence without repeats of (candidate, quote), with how often each was given."""
    rows = table(spark, folder, "evidence").groupBy("candidate_id", "quote").agg(F.min("evidence_key").alias("evidence_key"), F.count("*").alias("times"))
    return rows.select("candidate_id", "evidence_key", "times")


@QUERIES.query(
    "chunk_neighbours",
    """SELECT chunk_key, CAST(row_number() OVER w - 1 AS INTEGER) AS position, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id
    FROM chunks WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_seq, chunk_key)""",
)
def chunk_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every chunk in its document, and the chunks before and after it."""
    return E.neighbours(table(spark, folder, "chunks"))


@QUERIES.query(
    "near_chunks",
    """SELECT DISTINCT a.chunk_key AS asked_key, b.chunk_key AS near_key FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.chunk_key <> b.chunk_key
        AND (abs(a.chunk_seq - b.chunk_seq) <= 1 OR list_has_any(a.page_numbers, b.page_numbers)) WHERE a.chunk_key % 20 = 0""",
)
def near_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What context adds to every 20th chunk: its neighbours and the chunks of its pages."""
    chunks = table(spark, folder, "chunks")
    asked = chunks.where("chunk_key % 20 = 0")
    return E.within(chunks, asked).unionByName(E.same_pages(chunks, asked)).distinct()


@QUERIES.query(
    "chunk_provenance",
    """SELECT c.chunk_key, d.parsed_key, d.metadata.document_type AS document_type, d.metadata.addendum_number AS addendum_number, c.page_numbers[1] AS page
    FROM chunks c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, parsed_key DESC) AS rn FROM parsed_docs) WHERE rn = 1) d USING (doc_id)""",
)
def chunk_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with the latest ingest of its document and its first page."""
    docs = first_by(table(spark, folder, "parsed_docs"), ["doc_id"], F.col("ingested_at").desc(), F.col("parsed_key").desc())
    docs = docs.select("doc_id", "parsed_key", F.col("metadata.document_type").alias("document_type"), F.col("metadata.addendum_number").alias("addendum_number"))
    return table(spark, folder, "chunks").join(docs, "doc_id").select("chunk_key", "parsed_key", "document_type", "addendum_number", F.get("page_numbers", F.lit(0)).alias("page"))


_Q2, _T2 = (_q(_SPACED, _q(PUNCTUATION, c), " ") for c in ("quote", "text"))
_Q4, _T4 = (f"lower({_q(_SPACED, _q(PUNCTUATION, c), '')})" for c in ("quote", "text"))


JUDGED = f"""texts AS (SELECT chunk_id, text, TRUE AS there FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
    matched AS (SELECT evidence_key, quote, text, there, CASE WHEN trim(coalesce(quote, '')) = '' OR contains(quote, '...') OR coalesce(text, '') = '' THEN NULL
        WHEN contains(text, quote) THEN 'L1' WHEN contains({_T2}, {_Q2}) THEN 'L2' WHEN contains(lower({_T2}), lower({_Q2})) THEN 'L3'
        WHEN {_Q4} <> '' AND contains({_T4}, {_Q4}) THEN 'L4' END AS level FROM evidence LEFT JOIN texts USING (chunk_id)),
    judged AS (SELECT evidence_key, quote, text, level, CASE WHEN trim(coalesce(quote, '')) = '' THEN 'no_evidence' WHEN contains(quote, '...') THEN 'invalid_quote'
        WHEN there IS NULL THEN 'unknown_evidence_id' WHEN level IS NULL THEN 'quote_not_in_chunk' END AS reason FROM matched)"""
_IS_BLANK = f"regexp_full_match(substr(text, CAST({{0}} AS INTEGER), 1), '{BLANKS}')"
_KEPT = f"""CASE WHEN level IN ('L2', 'L3') THEN list_filter(range(length(text)), lambda i: NOT ({_IS_BLANK.format("i + 1")} AND i > 0 AND {_IS_BLANK.format("i")}))
        WHEN level = 'L4' THEN list_filter(range(length(text)), lambda i: NOT {_IS_BLANK.format("i + 1")}) ELSE range(length(text)) END"""
# The same with the place of every match.
JUDGED = f"""{JUDGED},
    forms AS (SELECT *, CASE level WHEN 'L1' THEN instr(text, quote) WHEN 'L2' THEN instr({_T2}, {_Q2}) WHEN 'L3' THEN instr(lower({_T2}), lower({_Q2})) WHEN 'L4' THEN instr({_T4}, {_Q4}) END AS p,
        CASE level WHEN 'L1' THEN length(quote) WHEN 'L4' THEN length({_Q4}) ELSE length({_Q2}) END AS size, {_KEPT} AS kept FROM judged),
    spans AS (SELECT *, CAST(kept[p] AS INTEGER) AS start_at, CAST(kept[p + size - 1] + 1 AS INTEGER) AS end_at FROM forms),
    placed AS (SELECT evidence_key, level, start_at, end_at, substr(text, start_at + 1, end_at - start_at) AS matched, reason FROM spans)"""
_GROUNDED = f"WITH {JUDGED} SELECT * FROM placed"


@QUERIES.query(
    "grounded_evidence",
    _GROUNDED,
)
def grounded_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether and how every quote is found in its chunk, else the first reason against it."""
    return E.ground(table(spark, folder, "evidence"), table(spark, folder, "chunks"))


@QUERIES.query(
    "candidate_status",
    f"""WITH {JUDGED},
    owned AS (SELECT candidate_id, evidence_key, level, reason FROM judged JOIN (SELECT evidence_key, candidate_id FROM evidence WHERE candidate_id IS NOT NULL) USING (evidence_key)),
    grouped AS (SELECT candidate_id, count(*) AS pieces, coalesce(bool_or(level = 'L1'), FALSE) AS verbatim, min(evidence_key) FILTER (WHERE reason IS NOT NULL) AS failed_key FROM owned GROUP BY candidate_id)
    SELECT g.candidate_id, pieces, failed_key IS NULL AS accepted, CASE WHEN failed_key IS NULL THEN CASE WHEN verbatim THEN 'exact' ELSE 'semantic' END END AS match, reason, failed_key
    FROM grouped g LEFT JOIN (SELECT evidence_key AS failed_key, reason FROM owned) USING (failed_key)""",
)
def candidate_status(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every candidate is accepted, how it matches, else the first reason against it."""
    return E.candidates(table(spark, folder, "evidence"), table(spark, folder, "chunks"))


@QUERIES.query(
    "supported_claims",
    f"""SELECT e.evidence_key, len(list_filter({TOKENS.format("e.quote")}, lambda t: length(t) > 4 AND NOT contains(lower(c.text), t))) = 0 AS supported
    FROM evidence e JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1) c USING (chunk_id)
    WHERE e.quote IS NOT NULL AND c.text IS NOT NULL""",
)
def supported_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every longer word of a quote occurs in its chunk, in any order."""
    texts = E.first_texts(table(spark, folder, "chunks")).select("chunk_id", "text")
    rows = table(spark, folder, "evidence").join(texts, "chunk_id").where("quote IS NOT NULL AND text IS NOT NULL")
    return rows.select("evidence_key", X.supported(F.col("quote"), F.col("text")).alias("supported"))


@QUERIES.query(
    "field_coverage",
    "SELECT field_name, count(*) AS records, count(value) AS found, count(*) - count(value) AS missing FROM bid_records UNPIVOT INCLUDE NULLS (value FOR field_name IN ("
    + ", ".join(NAMES)
    + ")) GROUP BY field_name",
)
def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have a value, for each of the 20 fields."""
    rows = table(spark, folder, "bid_records")
    counts = rows.agg(F.count("*").alias("records"), *[F.count(n).alias(n) for n in NAMES])
    long = counts.unpivot("records", NAMES, "field_name", "found")
    return long.select("field_name", "records", "found", (F.col("records") - F.col("found")).alias("missing"))


_TIERS = {"direct_upload": 0, "portal_north": 1, "lakes_portal": 1, "county_ftp": 1, "statewide_rss": 2, "mail_gateway": 2, "pdf_drop": 2}
_TIER_SQL = "CASE feed " + " ".join(f"WHEN '{f}' THEN {t}" for f, t in _TIERS.items()) + " ELSE 3 END"


_STATED = r"""NOT (trim({0}) = '' OR NOT regexp_matches({0}, '[\p{{L}}\p{{N}}_]') OR contains({0}, '___') OR regexp_matches(trim({0}), '(?s)^[(\[{{].*[)\]}}]$')
            OR lower(trim({0})) IN ('n/a', 'na', 'none', 'null', 'tbd', 'unknown', 'not specified', 'not stated', 'not applicable'))"""


def _resolved_sql(names: list[str]) -> str:
    return f"""WITH long AS (SELECT bid_id, record_id, tier, late, field_name, value, {COMPARABLE.format("value")} AS form FROM (UNPIVOT
        (SELECT bid_id, record_id, {_TIER_SQL} AS tier, epoch_us(extracted_at) AS late, {", ".join(names)} FROM bid_records) ON {", ".join(names)} INTO NAME field_name VALUE value)
        WHERE {_STATED.format("value")}),
    best AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY bid_id, field_name) AS candidates,
        row_number() OVER (PARTITION BY bid_id, field_name ORDER BY tier, late DESC, record_id) AS rn FROM long) WHERE rn = 1),
    rivals AS (SELECT bid_id, field_name, count(*) AS rivals FROM long JOIN best b USING (bid_id, field_name, tier)
        WHERE CASE WHEN long.form = '' OR b.form = '' THEN long.form <> b.form ELSE long.form <> b.form AND NOT contains(long.form, b.form) AND NOT contains(b.form, long.form) END GROUP BY ALL)
    SELECT bid_id, field_name, value, record_id, candidates, coalesce(rivals, 0) AS rivals, coalesce(rivals, 0) > 0 AS conflicting FROM best LEFT JOIN rivals USING (bid_id, field_name)"""


def _resolved(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    tier = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TIERS.items() for x in kv]), F.col("feed")), F.lit(3))
    return E.resolve(table(spark, folder, "bid_records"), names, [tier, (-F.unix_micros(F.col("extracted_at").cast("timestamp"))).alias("_late")])


_COUNTS = """SELECT bid_id, count(*) AS total, count(*) FILTER (WHERE status <> 'not_found') AS found, count(*) FILTER (WHERE status = 'not_found') AS missing,
        count(*) FILTER (WHERE status = 'conflicting') AS conflicting FROM ({0}) GROUP BY bid_id"""
_JSON = """SELECT bid_id, to_json(list({{'field': field_name, 'status': status, 'value': value}} ORDER BY position))::VARCHAR AS fields FROM ({0}) GROUP BY bid_id"""


def _counts(fields: DataFrame) -> DataFrame:
    status = F.col("status")
    return fields.groupBy("bid_id").agg(
        F.count("*").alias("total"),
        F.count_if(status != "not_found").alias("found"),
        F.count_if(status == "not_found").alias("missing"),
        F.count_if(status == "conflicting").alias("conflicting"),
    )


def _json(fields: DataFrame) -> DataFrame:
    entry = F.struct(F.col("field_name").alias("field"), "status", "value")
    # A bid has a fixed number of fields, so gathering them is bounded.
    gathered = fields.groupBy("bid_id").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("entry")))).alias("all"))
    return gathered.select("bid_id", F.to_json(F.transform("all", lambda x: x["entry"]), {"ignoreNullFields": "false"}).alias("fields"))


@QUERIES.query(
    "rule_candidates",
    rf"""WITH found AS (SELECT doc_id, chunk_seq, chunk_key, generate_subscripts(f, 1) AS no, unnest(f) AS phrase FROM (
        SELECT doc_id, chunk_seq, chunk_key, list_filter(regexp_extract_all(text, '(?i)\b[a-z][a-z\-]+\s+affidavit\b'),
            lambda x: NOT regexp_matches(x, '(?i)^({X.NOT_A_FORM})\b')) AS f FROM chunks WHERE doc_id IS NOT NULL)),
    formed AS (SELECT *, lower(trim(regexp_replace(phrase, '{BLANKS.format()}+', ' ', 'g'))) AS form FROM found)
    SELECT doc_id, form, phrase, chunk_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY chunk_seq, chunk_key, no) AS rn FROM formed) WHERE rn = 1""",
)
def rule_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The forms that every document names, where it names them first."""
    return E.rule_candidates(table(spark, folder, "chunks"))


@QUERIES.query(
    "bid_overview",
    """SELECT bid_id, count(DISTINCT doc_id) AS documents, count(*) AS sections, sum(length(text)) AS chars, count(*) FILTER (WHERE source_format = 'pdf') AS pages FROM sections GROUP BY bid_id""",
)
def bid_overview(spark: SparkSession, folder: str) -> DataFrame:
    """What a bid consists of: documents, sections, characters, pdf pages."""
    return table(spark, folder, "sections").groupBy("bid_id").agg(
        F.countDistinct("doc_id").alias("documents"),
        F.count("*").alias("sections"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("source_format") == "pdf").alias("pages"),
    )


@QUERIES.query(
    "flat_json",
    "SELECT record_id, bid_id, to_json({" + ", ".join(f"'{f.label}': {f.name}" for f in C.fields()) + "})::VARCHAR AS flat FROM bid_records",
)
def flat_json(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as flat JSON of the 20 labels; missing values are null, none is left out."""
    labels = F.struct(*[F.col(f.name).alias(f.label) for f in C.fields()])
    return table(spark, folder, "bid_records").select("record_id", "bid_id", F.to_json(labels, {"ignoreNullFields": "false"}).alias("flat"))


@QUERIES.query(
    "uncached_texts",
    """SELECT DISTINCT sha256(concat('hash-256:', text)) AS cache_key FROM chunks WHERE source_format = 'html' AND text <> ''
        AND sha256(concat('hash-256:', text)) NOT IN (SELECT sha256(concat('hash-256:', text)) FROM chunks WHERE source_format = 'pdf' AND text <> '')""",
)
def uncached_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Cache keys of html texts that a cache filled with all pdf texts lacks."""
    rows = table(spark, folder, "chunks").where("text <> ''").select("source_format", F.sha2(F.concat(F.lit("hash-256:"), "text"), 256).alias("cache_key"))
    cached = rows.where("source_format = 'pdf'").select("cache_key")
    return rows.where("source_format = 'html'").select("cache_key").distinct().join(cached, "cache_key", "left_anti")


@QUERIES.query(
    "quote_pages",
    """WITH texts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1 AND len(page_numbers) > 0),
    found AS (SELECT evidence_key, page_numbers, string_split(text, chr(12)) AS parts, quote FROM evidence JOIN texts USING (chunk_id) WHERE quote <> ''),
    hits AS (SELECT *, list_filter(page_numbers, lambda p, i: contains(parts[i], quote)) AS with_it FROM found)
    SELECT evidence_key, array_to_string(CASE WHEN len(parts) = len(page_numbers) AND len(with_it) = 1 THEN with_it ELSE page_numbers END, ',') AS pages FROM hits""",
)
def quote_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that every quote can stand on."""
    return E.quote_pages(table(spark, folder, "evidence"), table(spark, folder, "chunks")).select("evidence_key", F.array_join("pages", ",").alias("pages"))


#: Fields for which a context also takes what shares a page with a hit.
_PAGED = [f.name for g in ("products", "specifications") for f in C.fields(g)]


@QUERIES.query(
    "context_selection",
    f"""WITH hits AS (SELECT bid_id, doc_id, chunk_id, bool_or(field_name IN ({", ".join(f"'{n}'" for n in _PAGED)})) AS paged FROM ({field_search_sql(True)}) GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(length(text)) AS text_chars FROM sections GROUP BY doc_id),
    types AS (SELECT doc_id, metadata.document_type AS document_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, parsed_key DESC) AS rn FROM parsed_docs) WHERE rn = 1),
    sized AS (SELECT c.*, text_chars, coalesce(document_type = 'affidavit', FALSE) AS affidavit FROM chunks c JOIN sizes USING (doc_id) LEFT JOIN types USING (doc_id)),
    bodies AS (SELECT * FROM sized WHERE NOT affidavit AND text_chars > 15000),
    asked AS (SELECT b.*, paged FROM bodies b JOIN hits USING (bid_id, doc_id, chunk_id)),
    picked AS (SELECT chunk_key, 'affidavit' AS reason FROM sized WHERE affidavit
            AND len(list_filter(regexp_extract_all(text, '(?i)\\b[a-z][a-z\\-]+\\s+affidavit\\b'), lambda x: NOT regexp_matches(x, '(?i)^({X.NOT_A_FORM})\\b'))) > 0
        UNION SELECT chunk_key, 'whole' FROM sized WHERE NOT affidavit AND text_chars <= 15000
        UNION SELECT chunk_key, 'front' FROM bodies WHERE len(list_filter(page_numbers, lambda p: p <= 2)) > 0
        UNION SELECT chunk_key, 'retrieved' FROM asked
        UNION SELECT b.chunk_key, 'neighbour' FROM asked a JOIN bodies b ON a.doc_id = b.doc_id AND abs(a.chunk_seq - b.chunk_seq) <= 1 AND a.chunk_key <> b.chunk_key
        UNION SELECT b.chunk_key, 'page' FROM asked a JOIN bodies b ON a.doc_id = b.doc_id AND list_has_any(a.page_numbers, b.page_numbers) AND a.chunk_key <> b.chunk_key WHERE a.paged)
    SELECT chunk_key, string_agg(reason, ',' ORDER BY reason) AS reasons FROM picked GROUP BY chunk_key""",
)
def context_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the contexts of all bids may draw on, with the rules that chose them; what is retrieved is the field search by document."""
    chunks = table(spark, folder, "chunks")
    sizes = table(spark, folder, "sections").groupBy("doc_id").agg(F.sum(F.length("text")).alias("text_chars"))
    latest = first_by(table(spark, folder, "parsed_docs"), ["doc_id"], F.col("ingested_at").desc(), F.col("parsed_key").desc())
    documents = sizes.join(latest.select("doc_id", F.col("metadata.document_type").alias("document_type")), "doc_id", "left")
    return E.select_context(chunks, documents, cut(R.field_search(chunks, per_document=True)), _PAGED)


@QUERIES.query(
    "context_order",
    """SELECT chunk_key, concat('E', substr(sha256(chunk_id), 1, 8)) AS handle, lag(concat('E', substr(sha256(chunk_id), 1, 8))) OVER (PARTITION BY doc_id ORDER BY chunk_seq, chunk_key) AS follows
    FROM chunks WHERE chunk_id IS NOT NULL AND length(text) > 500""",
)
def context_order(spark: SparkSession, folder: str) -> DataFrame:
    """Which chunk each longer chunk follows, among the longer ones of its document."""
    chunks = table(spark, folder, "chunks")
    return E.follows(chunks, chunks.where(F.length("text") > 500))


@QUERIES.query(
    "evidence_by_document",
    """SELECT e.bid_id, e.field_name, c.doc_id, count(*) AS pieces, count(DISTINCT e.candidate_id) AS candidates, min(e.evidence_key) AS first_key
    FROM evidence e JOIN (SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE chunk_id IS NOT NULL) c USING (chunk_id) GROUP BY ALL""",
)
def evidence_by_document(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of a field, apart by document: pieces, candidates and the first piece."""
    homes = table(spark, folder, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "doc_id").distinct()
    joined = table(spark, folder, "evidence").join(homes, "chunk_id")
    return joined.groupBy("bid_id", "field_name", "doc_id").agg(
        F.count("*").alias("pieces"), F.countDistinct("candidate_id").alias("candidates"), F.min("evidence_key").alias("first_key")
    )


def _agreement(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    long = table(spark, folder, "bid_records").unpivot("bid_id", names, "field_name", "value").where("value IS NOT NULL")
    forms = long.select("bid_id", "field_name", X.comparable(F.col("value")).alias("form"))
    return forms.groupBy("bid_id", "field_name").agg(F.count("*").alias("stated"), F.countDistinct("form").alias("forms"), F.min("form").alias("a_form"))


@QUERIES.query("packed_chunks")
def packed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks made of the sections of every document: short ones packed together, long ones split with an overlap."""
    return packing.pack_sections(table(spark, folder, "sections"))


# A fold in order: every chunk of a bid after the one before it.
_PACKED = f"""RECURSIVE ordered AS (SELECT bid_id, doc_id, chunk_key, length(text) + {E.EXCERPT_OVERHEAD} AS size, row_number() OVER (PARTITION BY bid_id ORDER BY doc_id NULLS FIRST, chunk_seq NULLS FIRST, chunk_key) AS no
        FROM chunks WHERE text <> '' AND bid_id IS NOT NULL),
    folded(bid_id, no, used, taken, kept) AS (
        SELECT bid_id, 0::BIGINT, 0::BIGINT, 0, FALSE FROM ordered GROUP BY bid_id
        UNION ALL SELECT f.bid_id, o.no, f.used + CASE WHEN f.used + o.size <= {packing.MAX_CHARS} AND f.taken < {packing.MAX_EXCERPTS} THEN o.size ELSE 0 END,
            f.taken + CASE WHEN f.used + o.size <= {packing.MAX_CHARS} AND f.taken < {packing.MAX_EXCERPTS} THEN 1 ELSE 0 END,
            f.used + o.size <= {packing.MAX_CHARS} AND f.taken < {packing.MAX_EXCERPTS}
        FROM folded f JOIN ordered o ON o.bid_id = f.bid_id AND o.no = f.no + 1),
    packed AS (SELECT f.bid_id, f.taken AS place, o.doc_id, o.chunk_key, f.used FROM folded f JOIN ordered o USING (bid_id, no) WHERE kept)"""


def _packed_context(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_context(table(spark, folder, "chunks"), overhead=E.EXCERPT_OVERHEAD)


@QUERIES.query("packed_context", f"WITH {_PACKED} SELECT bid_id, place, doc_id, chunk_key, used FROM packed")
def packed_context(spark: SparkSession, folder: str) -> DataFrame:
    """What fits into the context of a bid, in order; what is too large is skipped, not a stop."""
    return _packed_context(spark, folder)


@QUERIES.query("trimmed_context", f"WITH {_PACKED} SELECT bid_id, chunk_key FROM ordered WHERE chunk_key NOT IN (SELECT chunk_key FROM packed)")
def trimmed_context(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that the context of a bid left out."""
    return packing.trimmed(table(spark, folder, "chunks"), _packed_context(spark, folder))


@QUERIES.query(
    "context_texts",
    f"""WITH {_PACKED} SELECT p.bid_id, count(*)::INTEGER AS excerpts,
        string_agg(concat('{E.EXCERPT[0]}', coalesce(concat('E', substr(sha256(chunk_id), 1, 8)), 'none'), '>', chr(10), replace(text, '</excerpt>', '</excerpt_>'), chr(10), '</excerpt>'), chr(10) ORDER BY place) AS context
    FROM packed p JOIN chunks USING (chunk_key) GROUP BY p.bid_id""",
)
def context_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every bid as one text of excerpts."""
    return E.context_texts(table(spark, folder, "chunks"), _packed_context(spark, folder))


#: The fields of one value and those of a list, in catalogue order.
_SINGLE, _MANY = ([f.name for f in C.fields() if f.many == many] for many in (False, True))
#: List fields whose value is running text, one item a record.
_PROSE = frozenset({"product_specification"})

_CATALOGUE_RESOLVED = _resolved_sql(_SINGLE)
_CATALOGUE_LISTS = rf"""WITH long AS (UNPIVOT (SELECT bid_id, record_id, {", ".join(_MANY)} FROM bid_records) ON {", ".join(_MANY)} INTO NAME field_name VALUE value),
    split AS (SELECT bid_id, record_id, field_name, CASE WHEN field_name IN ({", ".join(f"'{n}'" for n in sorted(_PROSE))}) THEN [value] ELSE regexp_extract_all(value, '{E.ITEM}') END AS l FROM long),
    items AS (SELECT bid_id, record_id, field_name, generate_subscripts(l, 1) AS place, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS item FROM split),
    formed AS (SELECT *, {COMPARABLE.format("item")} AS form FROM items WHERE {_STATED.format("item")}),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bid_id, field_name, form ORDER BY record_id, place) AS rn FROM formed) WHERE rn = 1)
    SELECT bid_id, field_name, string_agg(item, '; ' ORDER BY record_id, place) AS items FROM firsts GROUP BY bid_id, field_name"""
_CATALOGUE_ROWS = ", ".join(f"({f.position}, '{f.name}')" for f in C.fields())
_CATALOGUE_FIELDS = f"""SELECT bid_id, position, field_name, CASE WHEN conflicting THEN 'conflicting' WHEN value IS NOT NULL THEN 'found' ELSE 'not_found' END AS status, value
    FROM (SELECT DISTINCT bid_id FROM bid_records) CROSS JOIN (VALUES {_CATALOGUE_ROWS}) AS f(position, field_name)
    LEFT JOIN (SELECT bid_id, field_name, value, conflicting FROM ({_CATALOGUE_RESOLVED}) UNION ALL SELECT bid_id, field_name, items, FALSE FROM ({_CATALOGUE_LISTS})) USING (bid_id, field_name)"""


@QUERIES.query("catalogue_resolved", _CATALOGUE_RESOLVED)
def catalogue_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The value of all 13 fields of one value of every bid: by the feed's tier, then the latest extraction; with its rivals."""
    return _resolved(spark, folder, _SINGLE)


@QUERIES.query("catalogue_lists", _CATALOGUE_LISTS)
def catalogue_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The different items of all seven list fields of every bid, over all its records."""
    return E.combine_lists(table(spark, folder, "bid_records"), _MANY, _PROSE)


def _catalogue_fields(spark: SparkSession, folder: str) -> DataFrame:
    lists = catalogue_lists(spark, folder).select("bid_id", "field_name", F.col("items").alias("value"), F.lit(False).alias("conflicting"))
    chosen = _resolved(spark, folder, _SINGLE).select("bid_id", "field_name", "value", "conflicting")
    return E.all_fields(table(spark, folder, "bid_records"), chosen.unionByName(lists), NAMES)


@QUERIES.query("catalogue_fields", _CATALOGUE_FIELDS)
def catalogue_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every bid with all 20 fields in catalogue order, found or not."""
    return _catalogue_fields(spark, folder)


@QUERIES.query("catalogue_counts", _COUNTS.format(_CATALOGUE_FIELDS))
def catalogue_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the 20 fields of a bid are found, missing and conflicting; a conflicting one counts as found."""
    return _counts(_catalogue_fields(spark, folder))


@QUERIES.query("catalogue_json", _JSON.format(_CATALOGUE_FIELDS))
def catalogue_json(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON line per bid: all 20 fields in order, with status and value."""
    return _json(_catalogue_fields(spark, folder))


@QUERIES.query(
    "catalogue_agreement",
    f"""WITH forms AS (SELECT bid_id, field_name, {COMPARABLE.format("value")} AS form FROM (UNPIVOT (SELECT bid_id, {", ".join(NAMES)} FROM bid_records) ON {", ".join(NAMES)} INTO NAME field_name VALUE value))
    SELECT bid_id, field_name, count(*) AS stated, count(DISTINCT form) AS forms, min(form) AS a_form FROM forms GROUP BY ALL""",
)
def catalogue_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many different values the records of a bid state for each of the 20 fields, spelling aside."""
    return _agreement(spark, folder, NAMES)


@QUERIES.query(
    "catalogue_placeholders",
    f"""SELECT record_id, field_name, value FROM (UNPIVOT (SELECT record_id, {", ".join(NAMES)} FROM bid_records) ON {", ".join(NAMES)} INTO NAME field_name VALUE value) WHERE NOT ({_STATED.format("value")})""",
)
def catalogue_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the 20 fields that only stand in for missing ones."""
    rows = table(spark, folder, "bid_records").unpivot("record_id", NAMES, "field_name", "value")
    return rows.where(X.placeholder(F.col("value")))


_ROLE_CUE = "coalesce(" + ", ".join(f"nullif(regexp_extract(w, '(?i){cue}', 0), '')" for cue in X.AMENDMENT_CUES) + ")"


@QUERIES.query(
    "amendment_roles",
    f"""WITH texts AS (SELECT chunk_id, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
    placed AS (SELECT evidence_key, text, q, instr(text, q) AS p FROM (SELECT evidence_key, text, coalesce(quote, '') AS q FROM evidence JOIN texts USING (chunk_id))),
    windows AS (SELECT evidence_key, CASE WHEN p = 0 THEN text ELSE substr(text, greatest(1, p - {X.CUE_WINDOW}), p + length(q) + {X.CUE_WINDOW} - greatest(1, p - {X.CUE_WINDOW})) END AS w FROM placed),
    cues AS (SELECT evidence_key, w, {_ROLE_CUE} AS cue FROM windows)
    SELECT evidence_key, CASE WHEN cue IS NOT NULL THEN 'amendment' WHEN regexp_matches(w, '(?im){X.ANSWER}') THEN 'clarification' ELSE 'baseline' END AS role, cue FROM cues""",
)
def amendment_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the text around every quote amends, clarifies or only states, and the first cue of an amendment."""
    texts = E.first_texts(table(spark, folder, "chunks"))
    rows = table(spark, folder, "evidence").join(texts.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), "chunk_id")
    around = X.amendment_window(F.col("text"), F.coalesce("quote", F.lit("")))
    windows = rows.select("evidence_key", around.alias("w"))
    return windows.select("evidence_key", X.amendment_role(F.col("w")).alias("role"), X.amendment_cue(F.col("w")).alias("cue"))
