"""Queries on single texts and values: tokens, patterns, normal forms, match levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.functions import text as X
from tendrel.plans.registry import Registry
from tendrel.sources.tables import table

QUERIES = Registry()

#: SQL of the same functions, for the oracle.
TOKENS = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"
COMPARABLE = r"trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'µ', 'μ'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
# Apostrophes, quotation marks and dashes, and the plain character of each.
_SHAPED, _PLAIN = "‘’‛′“”‟″‐‑‒–—―−", "''''''''" + '""""' + "-------"
PUNCTUATION = f"translate({{0}}, '{_SHAPED}', '{_PLAIN}')"
# All white space.
BLANKS = r"[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
COLLAPSED = f"trim(regexp_replace({{0}}, '{BLANKS}+', ' ', 'g'))"


@QUERIES.query(
    "text_tokens",
    f"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, {TOKENS.format("text")} AS t FROM documents WHERE text IS NOT NULL)""",
)
def text_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokenised documents: counts and a digest of the words in order."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@QUERIES.query(
    "document_types",
    """SELECT parsed_key, CASE WHEN contains(f, 'addendum') THEN 'addendum' WHEN contains(f, 'affidavit') THEN 'affidavit'
        WHEN contains(f, 'spec') THEN 'specification' WHEN source_format = 'pdf' THEN 'rfp_main' ELSE 'portal_listing' END AS inferred,
        CASE WHEN t IN ('rfp_main', 'addendum', 'affidavit', 'specification', 'portal_listing') THEN t ELSE 'unknown' END AS stated
    FROM (SELECT parsed_key, lower(metadata.source_filename) AS f, metadata.source_format AS source_format, metadata.document_type AS t FROM parsed_docs)""",
)
def document_types(spark: SparkSession, folder: str) -> DataFrame:
    """The type that a file name suggests, and the stated type with unknown ones made one."""
    docs = table(spark, folder, "parsed_docs").select(
        "parsed_key", F.lower("metadata.source_filename").alias("f"), F.col("metadata.source_format").alias("fmt"), F.col("metadata.document_type").alias("t")
    )
    inferred = F.when(F.contains("f", F.lit("addendum")), "addendum").when(F.contains("f", F.lit("affidavit")), "affidavit")
    inferred = inferred.when(F.contains("f", F.lit("spec")), "specification").when(F.col("fmt") == "pdf", "rfp_main").otherwise("portal_listing")
    known = F.col("t").isin("rfp_main", "addendum", "affidavit", "specification", "portal_listing")
    return docs.select("parsed_key", inferred.alias("inferred"), F.when(known, F.col("t")).otherwise("unknown").alias("stated"))


@QUERIES.query(
    "stated_facts",
    r"""SELECT section_key, TRY_CAST(nullif(regexp_extract(text, '(?i)ADDENDUM\s+NO\.?\s*(\d+)', 1), '') AS INTEGER) AS addendum_number,
        nullif(regexp_extract(text, '(?i)(?:date|issued):\s*([A-Za-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4})', 1), '') AS doc_date
    FROM sections WHERE text IS NOT NULL""",
)
def stated_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The first addendum number and the first labelled date in a section."""
    date = r"(?i)(?:date|issued):\s*([A-Za-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{4})"
    return (
        table(spark, folder, "sections")
        .where("text IS NOT NULL")
        .select(
            "section_key",
            F.regexp_extract("text", r"(?i)ADDENDUM\s+NO\.?\s*(\d+)", 1).try_cast("int").alias("addendum_number"),
            F.nullif(F.regexp_extract("text", date, 1), F.lit("")).alias("doc_date"),
        )
    )


@QUERIES.query(
    "see_more",
    r"""SELECT section_key, regexp_matches(text, '(?i)See more(\s+description)?') AS truncated, md5(t) AS digest
    FROM (SELECT section_key, text, trim(regexp_replace(text, '(?i)See more(\s+description)?', '', 'g')) AS t FROM sections) WHERE t <> ''""",
)
def see_more(spark: SparkSession, folder: str) -> DataFrame:
    """Sections without their "See more" marks, with a flag of whether they had one; empty ones are dropped."""
    mark = r"(?i)See more(\s+description)?"
    rows = table(spark, folder, "sections").select("section_key", "text", F.trim(F.regexp_replace("text", mark, "")).alias("t"))
    return rows.where("t <> ''").select("section_key", F.col("text").rlike(mark).alias("truncated"), F.md5("t").alias("digest"))


@QUERIES.query(
    "chunk_ids",
    r"""SELECT chunk_key, md5(concat(doc_id, '_', coalesce(section_identifier, 'unknown'), '_', text)) AS made_id,
        CASE WHEN source_format = 'pdf' AND starts_with(lower(section_identifier), 'page')
            THEN TRY_CAST(trim(replace(lower(section_identifier), 'page', '')) AS INTEGER) END AS page
    FROM chunks WHERE text IS NOT NULL""",
)
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Content ids of chunks, and the page that the section name states."""
    return (
        table(spark, folder, "chunks")
        .where("text IS NOT NULL")
        .select(
            "chunk_key",
            F.md5(F.concat("doc_id", F.lit("_"), F.coalesce("section_identifier", F.lit("unknown")), F.lit("_"), "text")).alias("made_id"),
            X.page_number(F.col("section_identifier"), F.col("source_format")).alias("page"),
        )
    )


# What makes a date relative, and the abbreviations that are written out as zones in all others.
RELATIVE = r"regexp_matches({0}, '(?i)within\s+\d+\s+days|after\s+award')"
DATED = (
    "CASE WHEN " + RELATIVE + " THEN {0} ELSE replace(replace(replace(replace({0}, 'CST', 'America/Chicago'), 'CDT', 'America/Chicago'), "
    "'EST', 'America/New_York'), 'EDT', 'America/New_York') END"
)


@QUERIES.query(
    "normal_values",
    rf"""SELECT record_id, upper(regexp_replace(bid_number, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS identifier, {COLLAPSED.format("title")} AS title,
        {RELATIVE.format("due_date")} AS relative_date,
        {DATED.format("due_date")} AS dated,
        {PUNCTUATION.format("bid_summary")} AS plain_summary
    FROM bid_records""",
)
def normal_values(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms of identifiers, strings, dates and punctuation of a record."""
    return table(spark, folder, "bid_records").select(
        "record_id",
        X.identifier(F.col("bid_number")).alias("identifier"),
        X.collapsed(F.col("title")).alias("title"),
        X.relative_date(F.col("due_date")).alias("relative_date"),
        X.dated(F.col("due_date")).alias("dated"),
        X.standard_punctuation(F.col("bid_summary")).alias("plain_summary"),
    )


@QUERIES.query(
    "distinct_lists",
    rf"""SELECT record_id, len(d) AS n_items, array_to_string(d, '; ') AS items FROM (
        SELECT record_id, list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i) AS d FROM (
            SELECT record_id, list_transform(string_split(concat_ws(';', product, additional_documentation, model_no), ';'), lambda v: {COLLAPSED.format("v")}) AS c FROM bid_records))""",
)
def distinct_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The list fields of a record as one list of different items, the first spelling kept."""
    items = X.distinct_items(F.split(F.concat_ws(";", "product", "additional_documentation", "model_no"), ";"))
    rows = table(spark, folder, "bid_records").select("record_id", items.alias("d"))
    return rows.select("record_id", F.size("d").cast("bigint").alias("n_items"), F.array_join("d", "; ").alias("items"))


@QUERIES.query(
    "contacts",
    rf"""WITH parts AS (SELECT record_id, contact_info, list_filter(list_transform(string_split(regexp_extract(contact_info, '\(([^)]*)\)', 1), ';'), lambda x: regexp_replace(x, '{BLANKS.format()}+', '', 'g')), lambda x: x <> '') AS p
        FROM bid_records WHERE contact_info IS NOT NULL),
    named AS (SELECT record_id, nullif({COLLAPSED.format("regexp_extract(contact_info, '^([^(]*)', 1)")}, '') AS name, list_filter(p, lambda x: contains(x, '@'))[1] AS email,
        list_filter(p, lambda x: NOT contains(x, '@') AND regexp_matches(x, '[0-9]'))[1] AS phone FROM parts)
    SELECT record_id, name, email, phone, nullif(CASE WHEN name IS NULL THEN concat_ws('; ', phone, email) WHEN phone IS NULL AND email IS NULL THEN name
        ELSE concat(name, ' (', concat_ws('; ', phone, email), ')') END, '') AS flat FROM named""",
)
def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Name, e-mail and phone of a contact that is written on one line, and the contact written from them again."""
    rows = table(spark, folder, "bid_records").where("contact_info IS NOT NULL")
    parted = rows.select("record_id", X.contact(F.col("contact_info")).alias("c")).select("record_id", "c.*")
    return parted.withColumn("flat", X.flat_contact(F.col("name"), F.col("email"), F.col("phone")))


@QUERIES.query(
    "amendment_cues",
    "SELECT doc_id, coalesce("
    + ", ".join(f"nullif(regexp_extract(text, '(?i){cue}', 0), '')" for cue in X.AMENDMENT_CUES)
    + ") AS cue FROM documents WHERE text IS NOT NULL",
)
def amendment_cues(spark: SparkSession, folder: str) -> DataFrame:
    """The first cue of an amendment in every document."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.amendment_cue(F.col("text")).alias("cue"))


@QUERIES.query(
    "named_forms",
    rf"""WITH found AS (SELECT section_key, unnest(regexp_extract_all(text, '(?i)\b[a-z][a-z\-]+\s+affidavit\b')) AS form FROM sections)
    SELECT section_key, lower(form) AS form, count(*) AS times FROM found
    WHERE NOT regexp_matches(form, '(?i)^({X.NOT_A_FORM})\b') GROUP BY ALL""",
)
def named_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The affidavits that sections name."""
    found = table(spark, folder, "sections").select("section_key", F.explode(X.named_forms(F.col("text"))).alias("form"))
    return found.groupBy("section_key", F.lower("form").alias("form")).agg(F.count("*").alias("times"))


@QUERIES.query(
    "highlights",
    r"SELECT chunk_key, md5(regexp_replace(text, '(?i)(vendor)', '**\1**', 'g')) AS digest, contains(lower(text), 'vendor') AS hit FROM chunks WHERE text IS NOT NULL",
)
def highlights(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the hits of a literal marked, and whether there are any."""
    rows = table(spark, folder, "chunks").where("text IS NOT NULL")
    return rows.select("chunk_key", F.md5(X.highlighted(F.col("text"), "vendor")).alias("digest"), F.contains(F.lower("text"), F.lit("vendor")).alias("hit"))


@QUERIES.query(
    "handles",
    """SELECT bid_id, chunk_id, CASE WHEN count(*) OVER (PARTITION BY bid_id, p) > 1 THEN concat('E', substr(h, 1, 12)) ELSE concat('E', p) END AS handle
    FROM (SELECT bid_id, chunk_id, h, substr(h, 1, 8) AS p FROM (SELECT DISTINCT bid_id, chunk_id, sha256(chunk_id) AS h FROM chunks WHERE chunk_id IS NOT NULL))""",
)
def handles(spark: SparkSession, folder: str) -> DataFrame:
    """Short handles of the chunks of a bid, longer ones where two would collide."""
    from pyspark.sql import Window

    rows = table(spark, folder, "chunks").where("chunk_id IS NOT NULL").select("bid_id", "chunk_id").distinct()
    short = X.handle(F.col("chunk_id"))
    clash = F.count("*").over(Window.partitionBy("bid_id", short)) > 1
    return rows.select("bid_id", "chunk_id", F.when(clash, X.handle(F.col("chunk_id"), 12)).otherwise(short).alias("handle"))


@QUERIES.query(
    "prompt_costs",
    """SELECT bid_id, count(*) AS excerpts, sum(length(replace(text, '</excerpt>', '</excerpt_>')) + 1 + length(concat('E', substr(sha256(chunk_id), 1, 8)))) AS chars
    FROM chunks WHERE text <> '' AND chunk_id IS NOT NULL GROUP BY bid_id""",
)
def prompt_costs(spark: SparkSession, folder: str) -> DataFrame:
    """What the escaped excerpts of a bid cost in characters, with their handles."""
    rows = table(spark, folder, "chunks").where("text <> '' AND chunk_id IS NOT NULL")
    size = F.length(F.replace("text", F.lit("</excerpt>"), F.lit("</excerpt_>"))) + 1 + F.length(X.handle(F.col("chunk_id")))
    return rows.groupBy("bid_id").agg(F.count("*").alias("excerpts"), F.sum(size).alias("chars"))


@QUERIES.query(
    "printed_labels",
    r"""SELECT section_key, list_filter(list_transform(l[1:3] || l[greatest(4, len(l) - 2):], lambda x: trim(x)), lambda x: regexp_full_match(x, '(?i)(page\s+)?\d+\s+(of|\|)\s+\d+'))[1] AS label
    FROM (SELECT section_key, string_split(text, chr(10)) AS l FROM sections WHERE source_format = 'pdf' AND text IS NOT NULL)""",
)
def printed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The page label printed among the first or last three lines of a page, as in `Page 3 of 12`."""
    pages = table(spark, folder, "sections").where("source_format = 'pdf' AND text IS NOT NULL")
    return pages.select("section_key", X.printed_label(F.col("text")).alias("label"))
