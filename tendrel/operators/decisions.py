"""From grounded candidates to decided fields: provenance, role, precedence, and what became of every candidate.

A candidate is one value for one field of one bid with the evidence for it. All steps are joins and aggregations on
(bid, field) that combine before they shuffle; no group of candidates is gathered, so what became of the candidates is a
row for each instead of lists within a field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.functions import text as X
from tendrel.operators.evidence import first_texts, ground
from tendrel.operators.retrieval import first_by, ranked

#: What became of a candidate: it gives the value, adds to it, agrees with it, was set aside for a stronger one, disagrees
#: with an equally strong one, or only clarifies.
CHOSEN, CONTRIBUTING, AGREEING, SUPERSEDED, CONFLICT, CLARIFICATION = "chosen", "contributing", "agreeing", "superseded", "conflict", "clarification"
#: The field to which rules contribute.
RULE_FIELD = "additional_documentation"
_KEY = ["bid_id", "field_name"]


def document_labels(documents: DataFrame, largest: int | None = None) -> DataFrame:
    """bid_id, doc_id and label (D1, D2 ... by doc_id) of the different documents of every bid, however many it has."""
    rows = documents.select("bid_id", "doc_id").distinct().withColumn("_one", F.lit(0.0))
    numbered = ranked(rows, ["bid_id"], "_one", "doc_id", "_no", largest)
    return numbered.select("bid_id", "doc_id", F.concat(F.lit("D"), F.col("_no")).alias("label"))


def model_candidates(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidate_id, bid_id, field_name, value, chunk_id, doc_id, pieces, role, cue and origin (llm) of accepted candidates.

    A candidate is accepted if all its pieces of evidence are found. Its value, chunk and role are those of its first piece
    by evidence_key, as the text stands in the chunk. Pieces without a candidate_id take no part.
    """
    judged = ground(evidence, chunks).select("evidence_key", "matched", "reason")
    owned = evidence.where("candidate_id IS NOT NULL").select("evidence_key", "candidate_id", "bid_id", "field_name", "chunk_id")
    rows = owned.join(judged, "evidence_key")
    first = F.min_by(F.struct("bid_id", "field_name", "chunk_id", F.col("matched").alias("value")), "evidence_key")
    grouped = rows.groupBy("candidate_id").agg(first.alias("_first"), F.count("*").alias("pieces"), F.count("reason").alias("_bad"))
    accepted = grouped.where("_bad = 0").select("candidate_id", "_first.*", "pieces")
    return _with_role(accepted, chunks).withColumn("origin", F.lit("llm"))


def rule_candidates(chunks: DataFrame) -> DataFrame:
    """The same columns for the forms that documents name, each where its document names it first; origin is rule."""
    named = F.posexplode(X.named_forms(F.col("text"))).alias("no", "phrase")
    rows = chunks.where("doc_id IS NOT NULL AND chunk_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("bid_id", "doc_id", "chunk_seq", "chunk_key", "chunk_id", named)
    earliest = F.min_by(F.struct("bid_id", "chunk_id", "phrase"), F.struct("chunk_seq", "chunk_key", "no"))
    first = rows.groupBy("doc_id", X.casefold(X.collapsed(F.col("phrase"))).alias("form")).agg(earliest.alias("f"))
    found = first.select("f.bid_id", F.lit(RULE_FIELD).alias("field_name"), F.col("f.phrase").alias("value"), "f.chunk_id", F.lit(1).cast("long").alias("pieces"))
    # The id of a candidate: equal for equal field, chunk and value.
    text = F.concat(F.lit(f"{RULE_FIELD}:"), "chunk_id", F.lit(":"), F.to_json(F.array("value")))
    return _with_role(found.withColumn("candidate_id", F.substring(F.sha2(text, 256), 1, 12)), chunks).withColumn("origin", F.lit("rule"))


def _with_role(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows with doc_id, role and cue: what the text around the value in its chunk does (see `amendment_role`)."""
    joined = rows.join(first_texts(chunks).select("chunk_id", "doc_id", F.coalesce("text", F.lit("")).alias("_text")), "chunk_id")
    columns = ["candidate_id", "bid_id", "field_name", "value", "chunk_id", "doc_id", "pieces"]
    windows = joined.select(*columns, X.amendment_window(F.col("_text"), F.col("value")).alias("_window"))
    window = F.col("_window")
    return windows.select(*columns, X.amendment_role(window).alias("role"), X.amendment_cue(window).alias("cue"))


def with_provenance(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """candidates with document_type, addendum_number, doc_label, tier, and role and cue of addenda only.

    documents: bid_id, doc_id, ingested_at, parsed_key and metadata; the latest ingest of a document counts. Candidates of
    documents that are not there are left out. The tier is 1 for an addendum that amends, else 0.
    """
    latest = first_by(documents.where("doc_id IS NOT NULL"), ["doc_id"], F.col("ingested_at").desc(), F.col("parsed_key").desc())
    latest = latest.select("doc_id", F.col("metadata.document_type").alias("document_type"), F.col("metadata.addendum_number").alias("addendum_number"))
    labels = document_labels(documents.where("doc_id IS NOT NULL AND bid_id IS NOT NULL")).withColumnRenamed("label", "doc_label")
    addendum = F.coalesce(F.col("document_type") == "addendum", F.lit(False))
    role = F.when(addendum, F.col("role")).otherwise("baseline")
    rows = candidates.join(latest, "doc_id").join(labels, ["bid_id", "doc_id"], "left")
    rows = rows.withColumns({"role": role, "cue": F.when(addendum, F.col("cue")), "doc_label": F.coalesce("doc_label", F.lit("D?"))})
    return rows.withColumn("tier", (F.col("role") == "amendment").cast("int"))


def decide(candidates: DataFrame, many: list[str]) -> DataFrame:
    """candidates with part: what became of each in its field of its bid.

    Candidates that only clarify decide nothing. Of the others the strongest comes first: by tier, then the highest
    addendum, the document's label as text, the id. In a field of one value it is chosen; materially different ones of its
    tier are conflicts, of lower tiers superseded, all else agrees. In the fields of `many` values all contribute, unless an
    amendment is there: then those of its tier only, and the rest is superseded.
    """
    order = F.struct((-F.col("tier")).alias("a"), (-F.coalesce("addendum_number", F.lit(0))).alias("b"), "doc_label", "candidate_id")
    rows = candidates.withColumn("_form", X.comparable(F.col("value")))
    best = F.min_by(F.struct("candidate_id", "tier", "_form"), order).alias("_best")
    strongest = rows.where(F.col("role") != "clarification").groupBy(*_KEY).agg(best)
    joined = rows.join(strongest, _KEY, "left")
    listed = F.col("field_name").isin(*many)
    differs = X.materially_different(F.col("_form"), F.col("_best._form"))
    weaker = F.col("tier") < F.col("_best.tier")
    part = (
        F.when(F.col("role") == "clarification", CLARIFICATION)
        .when(F.col("candidate_id") == F.col("_best.candidate_id"), CHOSEN)
        .when(listed, F.when(weaker, SUPERSEDED).otherwise(CONTRIBUTING))
        .when(differs, F.when(weaker, SUPERSEDED).otherwise(CONFLICT))
        .otherwise(AGREEING)
    )
    return joined.select(*candidates.columns, part.alias("part"))


def decided_fields(decisions: DataFrame, many: list[str]) -> DataFrame:
    """bid_id, field_name, status, rule, value, chosen_id, and counts of candidates by part and of pieces of evidence.

    status: found, conflicting, or not_found where candidates only clarify. The value of a field of many values is its
    different items, first spelling first, joined by semicolons; it is null where nothing was found.
    """
    listed, amended = F.col("field_name").isin(*many), F.col("tier") == 1
    used = F.col("part").isin(CHOSEN, CONTRIBUTING)
    order = F.struct((-F.col("tier")).alias("a"), (-F.coalesce("addendum_number", F.lit(0))).alias("b"), "doc_label", "candidate_id")
    counts = [F.count_if(F.col("part") == p).alias(n) for p, n in ((SUPERSEDED, "superseded"), (CONFLICT, "conflicts"), (CLARIFICATION, "clarifications"))]
    chosen = F.max_by(F.struct("candidate_id", "value", "document_type", "tier"), F.when(F.col("part") == CHOSEN, 1))
    fields = decisions.groupBy(*_KEY).agg(
        chosen.alias("_c"), F.count("*").alias("considered"), F.count_if(used).alias("contributing"), *counts, F.sum(F.when(used, F.col("pieces"))).alias("evidence")
    )
    items = decisions.where(used & listed).withColumn("_form", X.comparable(F.col("value"))).where("_form <> ''")
    items = items.groupBy(*_KEY, "_form").agg(F.min(order).alias("_at"), F.min_by("value", order).alias("value"))
    # One entry per different item, which is what the field states.
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "; ")
    fields = fields.join(items.groupBy(*_KEY).agg(joined.alias("_items")), _KEY, "left")
    amended, there = F.col("_c.tier") == 1, F.col("_c").isNotNull()
    single = F.when(amended, "addendum_amendment").when(F.col("_c.document_type") == "portal_listing", "portal_only").otherwise("highest_authority")
    suffix = F.when(F.col("conflicts") > 0, "_with_conflict").otherwise("")
    rule = F.when(~there, "clarification_only").when(listed, F.when(amended, "addendum_amendment_aggregated").otherwise("aggregated_all_tiers"))
    return fields.select(
        *_KEY,
        F.when(~there, "not_found").when(F.col("conflicts") > 0, "conflicting").otherwise("found").alias("status"),
        rule.otherwise(F.concat(single, suffix)).alias("rule"),
        F.when(listed, F.col("_items")).otherwise(F.col("_c.value")).alias("value"),
        F.col("_c.candidate_id").alias("chosen_id"),
        "considered",
        "contributing",
        "superseded",
        "conflicts",
        "clarifications",
        F.coalesce("evidence", F.lit(0)).alias("evidence"),
    )


def all_decided(bids: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """The decided fields of every bid with all fields in the order of `names`; those without a candidate are not found."""
    every = bids.select("bid_id").where("bid_id IS NOT NULL").distinct().select("bid_id", F.posexplode(F.array(*map(F.lit, names))).alias("_at", "field_name"))
    joined = every.join(fields, _KEY, "left")
    numbers = ("considered", "contributing", "superseded", "conflicts", "clarifications", "evidence")
    return joined.select(
        "bid_id",
        (F.col("_at") + 1).alias("position"),
        "field_name",
        F.coalesce("status", F.lit("not_found")).alias("status"),
        F.coalesce("rule", F.lit("no_candidates")).alias("rule"),
        "value",
        "chosen_id",
        *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
    )


def violations(fields: DataFrame) -> DataFrame:
    """Rows of decided fields that contradict themselves: not found with a value, or found without evidence."""
    found = F.col("status") != "not_found"
    return fields.where((~found & F.col("value").isNotNull()) | (found & (F.col("evidence") == 0)))


def diagnostics(decisions: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """bid_id, field_name, part, candidate_id and entry: a JSON object for every candidate, with its provenance.

    kinds: the kind of value of every field, by which the entry's normalised form is made (see `text.normalised`).
    """
    names = ["candidate_id", "value", "origin", "role", "tier", F.col("cue").alias("amendment_cue"), "doc_label", "document_type", "addendum_number", "chunk_id"]
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("field_name"))
    entry = F.struct(*names, X.normalised(F.col("value"), kind).alias("normalised"))
    return decisions.select(*_KEY, "part", "candidate_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def rejected(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """bid_id, field_name, candidate_id, reason and failed_key of candidates that are not accepted, with the first reason."""
    owned = evidence.where("candidate_id IS NOT NULL").select("evidence_key", "candidate_id", "bid_id", "field_name")
    judged = ground(evidence, chunks).where("reason IS NOT NULL").select("evidence_key", "reason")
    first = F.min_by(F.struct("bid_id", "field_name", "reason", F.col("evidence_key").alias("failed_key")), "evidence_key")
    grouped = owned.join(judged, "evidence_key").groupBy("candidate_id").agg(first.alias("f"))
    return grouped.select("f.bid_id", "f.field_name", "candidate_id", "f.reason", "f.failed_key")
