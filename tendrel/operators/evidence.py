"""Evidence: ground quotes in their chunks, choose among several values of a field, and the order of chunks in documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions import text as X
from tendrel.operators.retrieval import first_by

#: Reasons why a quote is not accepted, in the order in which they are tried.
REASONS = ("no_evidence", "invalid_quote", "unknown_evidence_id", "quote_not_in_chunk")


def ground(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence_key, level (L1 to L4 or null), start_at, end_at, matched and reason (null where the quote is accepted).

    start_at and end_at (exclusive) are the place in the chunk's text, from 0, and matched what stands there. A chunk_id
    that has several rows stands for the first by chunk_key. A null or blank quote is no evidence, one with an ellipsis is
    invalid. One shuffle by chunk_id; levels beyond L1 are computed only for what L1 does not find.
    """
    known = first_texts(chunks).select("chunk_id", F.col("text").alias("_text"), F.lit(True).alias("_there"))
    rows = evidence.select("evidence_key", "chunk_id", "quote").join(known, "chunk_id", "left")
    quote = F.coalesce("quote", F.lit(""))
    usable = (F.trim(quote) != "") & ~F.contains(quote, F.lit("..."))
    # A column each, so that none is computed again for the next.
    rows = rows.withColumn("level", F.when(usable, X.match_level(F.col("quote"), F.coalesce("_text", F.lit("")))))
    rows = rows.withColumn("matched", X.matched_text(F.col("level"), F.col("quote"), F.col("_text")))
    rows = rows.withColumn("start_at", F.instr("_text", F.col("matched")) - 1)
    reason = (
        F.when(F.trim(quote) == "", REASONS[0])
        .when(~usable, REASONS[1])
        .when(F.col("_there").isNull(), REASONS[2])
        .when(F.col("level").isNull(), REASONS[3])
    )
    end = F.col("start_at") + F.length("matched")
    return rows.select("evidence_key", "level", "start_at", end.alias("end_at"), "matched", reason.alias("reason"))


def first_texts(chunks: DataFrame) -> DataFrame:
    """The first row by chunk_key of every chunk_id, with what there is of chunk_key, doc_id, page_numbers and text.

    Repeats are few, so nothing is gained by aggregating before the shuffle; the window's partitioning and order by
    chunk_id serve the join that follows, so texts are moved and sorted once.
    """
    columns = [c for c in ("chunk_id", "chunk_key", "doc_id", "page_numbers", "text") if c in chunks.columns]
    return first_by(chunks.where("chunk_id IS NOT NULL").select(*columns), ["chunk_id"], "chunk_key")


def resolve(records: DataFrame, fields: list[str], order: list[Column]) -> DataFrame:
    """bid_id, field_name, value, record_id, candidates, rivals, conflicting: the chosen value of every field of a bid.

    The first record by `order` that has a value wins. Rivals are candidates of the winner's tier (the first column of
    the order) whose comparable value is materially different; with any the field is conflicting. Null and placeholder
    values are no candidates; ties fall to the lower record_id.
    """
    tier, *rest = order
    long = records.select("bid_id", "record_id", tier.alias("_tier"), F.struct(*rest, F.col("record_id")).alias("_order"), *fields)
    long = long.unpivot(["bid_id", "record_id", "_tier", "_order"], fields, "field_name", "value")
    stated = long.where(F.col("value").isNotNull() & ~X.placeholder(F.col("value")))
    rows = stated.withColumn("_form", X.comparable(F.col("value")))
    key = ["bid_id", "field_name"]
    # min_by and conditional counts aggregate before the shuffle, so a bid with very many records is no hot task.
    first = F.min_by(F.struct("record_id", "value", "_form", "_tier"), F.struct("_tier", "_order"))
    best = rows.groupBy(*key).agg(first.alias("_best"), F.count("*").alias("candidates"))
    forms = rows.groupBy(*key, "_tier", "_form").agg(F.count("*").alias("_n"))
    rivals = (
        forms.join(best.select(*key, "_best"), key)
        .where((F.col("_tier") == F.col("_best._tier")) & X.materially_different(F.col("_form"), F.col("_best._form")))
        .groupBy(*key)
        .agg(F.sum("_n").alias("_rivals"))
    )
    return best.join(rivals, key, "left").select(
        *key,
        F.col("_best.value").alias("value"),
        F.col("_best.record_id").alias("record_id"),
        "candidates",
        F.coalesce("_rivals", F.lit(0)).alias("rivals"),
        (F.coalesce("_rivals", F.lit(0)) > 0).alias("conflicting"),
    )


#: An item of a list value: up to a semicolon that stands outside brackets, as in `Desk (a@b.example; 555-0100)`.
ITEM = r"(?:\([^)]*\)|[^;(]+|\()+"


def combine_lists(records: DataFrame, fields: list[str], texts: frozenset[str] = frozenset()) -> DataFrame:
    """bid_id, field_name and items: the different items of every list field over all records of a bid, first spelling first.

    Fields among `texts` hold running text, which is one item whatever its semicolons. Placeholders are no items.
    """
    long = records.select("bid_id", "record_id", *fields).unpivot(["bid_id", "record_id"], fields, "field_name", "value")
    split = F.regexp_extract_all("value", F.lit(ITEM), F.lit(0))
    items = F.when(F.col("field_name").isin(*texts), F.array("value")).otherwise(split) if texts else split
    rows = long.where("value IS NOT NULL").select("bid_id", "record_id", "field_name", F.posexplode(items).alias("at", "item"))
    rows = rows.withColumn("item", F.regexp_replace("item", r"^\s+|\s+$", "")).where(~X.placeholder(F.col("item")))
    rows = rows.withColumn("form", X.comparable(F.col("item")))
    place = F.struct("record_id", "at")
    first = rows.groupBy("bid_id", "field_name", "form").agg(F.min_by("item", place).alias("item"), F.min(place).alias("place"))
    # One entry per different item; sorting the pairs puts them in order of appearance.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "form", "item"))), lambda x: x["item"])
    return first.groupBy("bid_id", "field_name").agg(F.array_join(listed, "; ").alias("items"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_key, position (from 0), previous_id, next_id: the place of a chunk in its document, by chunk_seq then key."""
    order = Window.partitionBy("doc_id").orderBy("chunk_seq", "chunk_key")
    return chunks.where("doc_id IS NOT NULL").select(
        "chunk_key",
        (F.row_number().over(order) - 1).alias("position"),
        F.lag("chunk_id").over(order).alias("previous_id"),
        F.lead("chunk_id").over(order).alias("next_id"),
    )


def within(chunks: DataFrame, asked: DataFrame, reach: int = 1) -> DataFrame:
    """asked chunk_key and near_key: chunks of the same document within `reach` places, by an equi-join on the place."""
    steps = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)])).alias("step")
    stepped = asked.select("doc_id", F.col("chunk_key").alias("asked_key"), "chunk_seq", steps)
    sought = stepped.select("doc_id", "asked_key", (F.col("chunk_seq") + F.col("step")).alias("chunk_seq"))
    near = chunks.select("doc_id", "chunk_seq", F.col("chunk_key").alias("near_key"))
    return sought.join(near, ["doc_id", "chunk_seq"]).where("asked_key <> near_key").select("asked_key", "near_key")


def same_pages(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """asked chunk_key and near_key: chunks of the same document that share a page."""
    pages = F.explode("page_numbers").alias("page")
    left = asked.select("doc_id", F.col("chunk_key").alias("asked_key"), pages)
    right = chunks.select("doc_id", F.col("chunk_key").alias("near_key"), pages)
    return left.join(right, ["doc_id", "page"]).where("asked_key <> near_key").select("asked_key", "near_key").distinct()


def quote_pages(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence_key and pages: the pages that a quote can stand on, as far as its chunk tells.

    One page is that page. Of several, separated by form feeds in the text, it is the only one that contains the quote,
    else all. Chunks without pages, unknown chunks and null quotes give no row; of a repeated chunk_id the first row counts.
    """
    rows = first_texts(chunks)
    found = evidence.where("quote <> ''").join(rows.where("size(page_numbers) > 0"), "chunk_id")
    parts = F.split("text", "\f")
    paired = F.arrays_zip(F.col("page_numbers").alias("page"), parts.alias("part"))
    with_it = F.transform(F.filter(paired, lambda x: F.contains(x["part"], F.col("quote"))), lambda x: x["page"])
    single = (F.size(parts) == F.size("page_numbers")) & (F.size(with_it) == 1)
    return found.select("evidence_key", F.when(single, with_it).otherwise(F.col("page_numbers")).alias("pages"))


def select_context(chunks: DataFrame, documents: DataFrame, found: DataFrame, paged: list[str], small: int = 15_000, front: int = 2) -> DataFrame:
    """chunk_key and reasons (sorted, comma separated): the chunks that a context may draw on, and why.

    affidavit: chunks of affidavits that name a form, and nothing else of these; whole: chunks of other documents of at
    most `small` characters. Of larger ones: front: chunks on the first `front` pages; retrieved: what `found` (bid_id,
    doc_id, chunk_id, field_name) has; neighbour: what stands next to that; page: what shares a page with what was found
    for one of the fields of `paged`. documents: doc_id, text_chars and document_type; chunks of other documents are left
    out. Each rule is a plan of its own; their union is grouped once.
    """
    sized = chunks.join(documents.select("doc_id", "text_chars", "document_type"), "doc_id")
    is_affidavit = F.coalesce(F.col("document_type") == "affidavit", F.lit(False))
    other, large = sized.where(~is_affidavit), ~is_affidavit & (F.col("text_chars") > small)

    def why(df: DataFrame, reason: str, key: str = "chunk_key") -> DataFrame:
        return df.select(F.col(key).alias("chunk_key"), F.lit(reason).alias("reason"))

    named = sized.where(is_affidavit & F.col("text").rlike(X.NAMED_FORM))
    first = sized.where(large & F.exists("page_numbers", lambda p: p <= front))
    columns = ["chunk_key", "doc_id", "chunk_seq", "page_numbers", "bid_id", "chunk_id"]
    bodies = sized.where(large).select(*columns)
    hits = found.groupBy("bid_id", "doc_id", "chunk_id").agg(F.bool_or(F.col("field_name").isin(*paged)).alias("_paged"))
    asked = bodies.join(hits, ["bid_id", "doc_id", "chunk_id"])
    near = within(bodies, asked)
    on_page = same_pages(bodies, asked.where("_paged"))
    rules = [why(named, "affidavit"), why(other.where(F.col("text_chars") <= small), "whole"), why(first, "front"), why(asked, "retrieved")]
    rules += [why(near, "neighbour", "near_key"), why(on_page, "page", "near_key")]
    every = reduce(DataFrame.unionByName, rules)
    return every.groupBy("chunk_key").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def follows(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    """chunk_key, handle and follows: the handle of the chunk before, among the selected ones of its document."""
    rows = chunks.join(selected.select("chunk_key"), "chunk_key", "left_semi").where("chunk_id IS NOT NULL")
    rows = rows.select("chunk_key", "doc_id", "chunk_seq", X.handle(F.col("chunk_id")).alias("handle"))
    order = Window.partitionBy("doc_id").orderBy("chunk_seq", "chunk_key")
    return rows.select("chunk_key", "handle", F.lag("handle").over(order).alias("follows"))


def candidates(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidate_id, pieces, accepted, match (exact, semantic or null), reason and failed_key.

    Every piece of evidence must be found; the first that is not, by evidence_key, gives the reason. A match is exact if
    any piece is found verbatim. Rows with a null candidate_id take no part.
    """
    owners = evidence.where("candidate_id IS NOT NULL").select("evidence_key", "candidate_id")
    judged = ground(evidence, chunks).join(owners, "evidence_key")
    bad = F.col("reason").isNotNull()
    grouped = judged.groupBy("candidate_id").agg(
        F.count("*").alias("pieces"),
        F.bool_or(F.col("level") == "L1").alias("verbatim"),
        F.min_by("reason", F.when(bad, F.col("evidence_key"))).alias("first"),
        F.min(F.when(bad, F.col("evidence_key"))).alias("failed_key"),
    )
    accepted = F.col("failed_key").isNull()
    match = F.when(accepted, F.when(F.col("verbatim"), "exact").otherwise("semantic"))
    reason = F.when(~accepted, F.col("first"))
    return grouped.select("candidate_id", "pieces", accepted.alias("accepted"), match.alias("match"), reason.alias("reason"), "failed_key")


def rule_candidates(chunks: DataFrame) -> DataFrame:
    """doc_id, form, phrase, chunk_key: every form that a document names, where it names it first."""
    named = F.posexplode(X.named_forms(F.col("text"))).alias("no", "phrase")
    rows = chunks.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "chunk_seq", "chunk_key", named)
    rows = rows.withColumn("form", F.lower(X.collapsed(F.col("phrase"))))
    earliest = F.min_by(F.struct("phrase", "chunk_key"), F.struct("chunk_seq", "chunk_key", "no"))
    first = rows.groupBy("doc_id", "form").agg(earliest.alias("first"))
    return first.select("doc_id", "form", "first.phrase", "first.chunk_key")


def all_fields(bids: DataFrame, resolved: DataFrame, names: list[str]) -> DataFrame:
    """bid_id, position (from 1), field_name, status and value: every bid with all fields, in the order of `names`.

    Status is found, conflicting or not_found; a field that nothing was chosen for has a null value.
    """
    every = F.posexplode(F.array(*map(F.lit, names))).alias("at", "field_name")
    wide = bids.select("bid_id").distinct().select("bid_id", every)
    joined = wide.join(resolved.select("bid_id", "field_name", "value", "conflicting"), ["bid_id", "field_name"], "left")
    status = F.when(F.col("conflicting"), "conflicting").when(F.col("value").isNotNull(), "found").otherwise("not_found")
    return joined.select("bid_id", (F.col("at") + 1).alias("position"), "field_name", status.alias("status"), "value")


def public_contact(contact: Column) -> Column:
    """map of the parts that a contact has: name, email, phone; empty ones are left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("k"), contact[n].alias("v")) for n in ("name", "email", "phone")])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["v"], F.lit("")) != ""))


#: What stands around an excerpt in a context, and what an excerpt so adds to its text (the handle has nine characters).
EXCERPT = ("<excerpt id=", ">\n", "\n</excerpt>")
EXCERPT_OVERHEAD = sum(map(len, EXCERPT)) + 9 + len("\n")


def context_texts(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """bid_id, excerpts and context: the packed chunks of a bid as one text, each under its handle, in order.

    The budget of the packing bounds the text of a bid, so gathering it in one row is safe.
    """
    rows = packed.select("bid_id", "place", "chunk_key").join(chunks.select("chunk_key", "chunk_id", "text"), "chunk_key")
    escaped = F.replace("text", F.lit("</excerpt>"), F.lit("</excerpt_>"))
    begin, behind, end = map(F.lit, EXCERPT)
    block = F.concat(begin, F.coalesce(X.handle(F.col("chunk_id")), F.lit("none")), behind, escaped, end)
    gathered = rows.groupBy("bid_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("blocks"))
    joined = F.array_join(F.transform("blocks", lambda x: x["block"]), "\n")
    return gathered.select("bid_id", F.size("blocks").alias("excerpts"), joined.alias("context"))
