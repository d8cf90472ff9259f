"""Queries on candidates: provenance and roles, decisions, decided fields, typed and flat records, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel import catalog as C
from tendrel.functions import text as X
from tendrel.operators import decisions as D
from tendrel.operators import evidence as E
from tendrel.plans.evidence_queries import JUDGED, NAMES
from tendrel.plans.registry import Registry
from tendrel.plans.text_queries import BLANKS, COLLAPSED, COMPARABLE, DATED, RELATIVE
from tendrel.session import cut
from tendrel.sources.tables import table

QUERIES = Registry()

MANY = [f.name for f in C.fields() if f.many]
KINDS = {f.name: f.kind for f in C.fields()}
_MANY_SQL = "(" + ", ".join(f"'{n}'" for n in MANY) + ")"
_CUE = "coalesce(" + ", ".join(f"nullif(regexp_extract(w, '(?i){cue}', 0), '')" for cue in X.AMENDMENT_CUES) + ")"
_WINDOW = f"CASE WHEN p = 0 THEN text ELSE substr(text, greatest(1, p - {X.CUE_WINDOW}), p + length(value) + {X.CUE_WINDOW} - greatest(1, p - {X.CUE_WINDOW})) END"


@QUERIES.query(
    "document_labels",
    "SELECT bid_id, doc_id, concat('D', row_number() OVER (PARTITION BY bid_id ORDER BY doc_id)) AS label FROM (SELECT DISTINCT bid_id, doc_id FROM parsed_docs)",
)
def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Short labels of the documents of a bid, in order of their ids."""
    return D.document_labels(table(spark, folder, "parsed_docs"))


# The matched text of a quote is that of the query grounded_evidence; here a candidate's first piece stands for it.
_CANDIDATES = f"""{JUDGED},
    pieces AS (SELECT e.candidate_id, e.bid_id, e.field_name, e.chunk_id, evidence_key, level, start_at, end_at, matched, reason FROM placed JOIN evidence e USING (evidence_key) WHERE candidate_id IS NOT NULL),
    llm AS (SELECT candidate_id, bid_id, field_name, matched AS value, chunk_id, pieces FROM (
        SELECT *, count(*) OVER w AS pieces, count(reason) OVER w AS bad, row_number() OVER (PARTITION BY candidate_id ORDER BY evidence_key) AS rn FROM pieces WINDOW w AS (PARTITION BY candidate_id)) WHERE rn = 1 AND bad = 0),
    named AS (SELECT bid_id, doc_id, chunk_seq, chunk_key, chunk_id, generate_subscripts(f, 1) AS no, unnest(f) AS phrase FROM (
        SELECT *, list_filter(regexp_extract_all(text, '(?i)\\b[a-z][a-z\\-]+\\s+affidavit\\b'), lambda x: NOT regexp_matches(x, '(?i)^({X.NOT_A_FORM})\\b')) AS f FROM chunks WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL)),
    ruled AS (SELECT bid_id, '{D.RULE_FIELD}' AS field_name, phrase AS value, chunk_id, 1 AS pieces FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, lower({COLLAPSED.format("phrase")}) ORDER BY chunk_seq, chunk_key, no) AS rn FROM named) WHERE rn = 1),
    every AS (SELECT *, 'llm' AS origin FROM llm UNION ALL
        SELECT substr(sha256(concat('{D.RULE_FIELD}:', chunk_id, ':', CAST(to_json([value]) AS VARCHAR))), 1, 12), bid_id, field_name, value, chunk_id, pieces, 'rule' FROM ruled),
    homes AS (SELECT chunk_id, doc_id, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_key) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1),
    latest AS (SELECT doc_id, metadata.document_type AS document_type, metadata.addendum_number AS addendum_number FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC, parsed_key DESC) AS rn FROM parsed_docs WHERE doc_id IS NOT NULL) WHERE rn = 1),
    labels AS (SELECT bid_id, doc_id, concat('D', row_number() OVER (PARTITION BY bid_id ORDER BY doc_id)) AS doc_label FROM (SELECT DISTINCT bid_id, doc_id FROM parsed_docs WHERE doc_id IS NOT NULL AND bid_id IS NOT NULL)),
    around AS (SELECT every.*, doc_id, text, instr(text, value) AS p FROM every JOIN homes USING (chunk_id)),
    windows AS (SELECT *, {_WINDOW} AS w FROM around),
    roles AS (SELECT *, {_CUE} AS found_cue, CASE WHEN {_CUE} IS NOT NULL THEN 'amendment' WHEN regexp_matches(w, '(?im){X.ANSWER}') THEN 'clarification' ELSE 'baseline' END AS found_role FROM windows),
    scored AS (SELECT candidate_id, r.bid_id, field_name, value, chunk_id, r.doc_id, pieces, origin, document_type, addendum_number, coalesce(doc_label, 'D?') AS doc_label,
        CASE WHEN document_type = 'addendum' THEN found_role ELSE 'baseline' END AS role, CASE WHEN document_type = 'addendum' THEN found_cue END AS cue
        FROM roles r JOIN latest USING (doc_id) LEFT JOIN labels l ON l.bid_id = r.bid_id AND l.doc_id = r.doc_id),
    tiered AS (SELECT *, CASE WHEN role = 'amendment' THEN 1 ELSE 0 END AS tier FROM scored)"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    every = D.model_candidates(table(spark, folder, "evidence"), chunks).unionByName(D.rule_candidates(chunks))
    return D.with_provenance(every, table(spark, folder, "parsed_docs"))


@QUERIES.query("candidate_provenance", f"WITH {_CANDIDATES} SELECT * FROM tiered")
def candidate_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted candidates of model and rules, each with its document, and its role where that is an addendum."""
    return _candidates(spark, folder)


@QUERIES.query("candidates_by_field", f"WITH {_CANDIDATES} SELECT bid_id, field_name, count(*) AS candidates, count(*) FILTER (WHERE origin = 'rule') AS by_rule FROM tiered GROUP BY ALL")
def candidates_by_field(spark: SparkSession, folder: str) -> DataFrame:
    """How many accepted candidates every field of a bid has."""
    return _candidates(spark, folder).groupBy("bid_id", "field_name").agg(F.count("*").alias("candidates"), F.count_if(F.col("origin") == "rule").alias("by_rule"))


_ORDER = "tier DESC, coalesce(addendum_number, 0) DESC, doc_label, candidate_id"
_DECISIONS = f"""{_CANDIDATES},
    formed AS (SELECT *, {COMPARABLE.format("value")} AS form FROM tiered),
    best AS (SELECT bid_id, field_name, candidate_id AS best_id, tier AS best_tier, form AS best_form FROM (
        SELECT *, row_number() OVER (PARTITION BY bid_id, field_name ORDER BY {_ORDER}) AS rn FROM formed WHERE role <> 'clarification') WHERE rn = 1),
    decided AS (SELECT f.*, CASE WHEN role = 'clarification' THEN 'clarification' WHEN candidate_id = best_id THEN 'chosen'
        WHEN field_name IN {_MANY_SQL} THEN CASE WHEN tier < best_tier THEN 'superseded' ELSE 'contributing' END
        WHEN CASE WHEN form = '' OR best_form = '' THEN form <> best_form ELSE form <> best_form AND NOT contains(form, best_form) AND NOT contains(best_form, form) END
            THEN CASE WHEN tier < best_tier THEN 'superseded' ELSE 'conflict' END ELSE 'agreeing' END AS part FROM formed f LEFT JOIN best USING (bid_id, field_name))"""


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return D.decide(_candidates(spark, folder), MANY)


@QUERIES.query("candidate_decisions", f"WITH {_DECISIONS} SELECT candidate_id, bid_id, field_name, tier, role, part FROM decided")
def candidate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every accepted candidate in its field."""
    return _decisions(spark, folder).select("candidate_id", "bid_id", "field_name", "tier", "role", "part")


_FIELDS = f"""{_DECISIONS},
    counts AS (SELECT bid_id, field_name, count(*) AS considered, count(*) FILTER (WHERE part IN ('chosen', 'contributing')) AS contributing, count(*) FILTER (WHERE part = 'superseded') AS superseded,
        count(*) FILTER (WHERE part = 'conflict') AS conflicts, count(*) FILTER (WHERE part = 'clarification') AS clarifications, coalesce(sum(pieces) FILTER (WHERE part IN ('chosen', 'contributing')), 0)::BIGINT AS evidence FROM decided GROUP BY ALL),
    chosen AS (SELECT bid_id, field_name, candidate_id AS chosen_id, value AS chosen_value, document_type, tier FROM decided WHERE part = 'chosen'),
    items AS (SELECT bid_id, field_name, string_agg(value, '; ' ORDER BY {_ORDER}) AS items FROM (
        SELECT *, row_number() OVER (PARTITION BY bid_id, field_name, form ORDER BY {_ORDER}) AS rn FROM decided WHERE part IN ('chosen', 'contributing') AND form <> '' AND field_name IN {_MANY_SQL}) WHERE rn = 1 GROUP BY ALL),
    stated AS (SELECT bid_id, field_name, CASE WHEN chosen_id IS NULL THEN 'not_found' WHEN conflicts > 0 THEN 'conflicting' ELSE 'found' END AS status,
        CASE WHEN chosen_id IS NULL THEN 'clarification_only' WHEN field_name IN {_MANY_SQL} THEN CASE WHEN tier = 1 THEN 'addendum_amendment_aggregated' ELSE 'aggregated_all_tiers' END
            ELSE concat(CASE WHEN tier = 1 THEN 'addendum_amendment' WHEN document_type = 'portal_listing' THEN 'portal_only' ELSE 'highest_authority' END, CASE WHEN conflicts > 0 THEN '_with_conflict' ELSE '' END) END AS rule,
        CASE WHEN field_name IN {_MANY_SQL} THEN items ELSE chosen_value END AS value, chosen_id, considered, contributing, superseded, conflicts, clarifications, evidence
        FROM counts LEFT JOIN chosen USING (bid_id, field_name) LEFT JOIN items USING (bid_id, field_name)),
    catalogue(position, field_name, label, kind) AS (VALUES {", ".join(f"({f.position}, '{f.name}', '{f.label}', '{f.kind}')" for f in C.fields())}),
    record AS (SELECT b.bid_id, position, c.field_name, coalesce(status, 'not_found') AS status, coalesce(rule, 'no_candidates') AS rule, value, chosen_id, coalesce(considered, 0) AS considered, coalesce(contributing, 0) AS contributing,
        coalesce(superseded, 0) AS superseded, coalesce(conflicts, 0) AS conflicts, coalesce(clarifications, 0) AS clarifications, coalesce(evidence, 0) AS evidence
        FROM (SELECT DISTINCT bid_id FROM parsed_docs WHERE bid_id IS NOT NULL) b CROSS JOIN catalogue c LEFT JOIN stated s ON s.bid_id = b.bid_id AND s.field_name = c.field_name)"""


def _record(spark: SparkSession, folder: str) -> DataFrame:
    # Counts, items and chosen values come from one table of decisions, which is written once.
    return D.all_decided(table(spark, folder, "parsed_docs"), D.decided_fields(cut(_decisions(spark, folder)), MANY), NAMES)


@QUERIES.query("decided_fields", f"WITH {_FIELDS} SELECT * FROM record")
def decided_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Every bid with all 20 fields, decided from its candidates: status, rule, value, and how many candidates took which part."""
    return _record(spark, folder)


@QUERIES.query("field_violations", f"WITH {_FIELDS} SELECT * FROM record WHERE (status = 'not_found' AND value IS NOT NULL) OR (status <> 'not_found' AND evidence = 0)")
def field_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Decided fields that contradict themselves; there should be none."""
    return D.violations(_record(spark, folder))


def _public(record: DataFrame) -> DataFrame:
    """bid_id and record: typed JSON of the 20 labels: strings, arrays of strings, a contact as an object; null if not found."""
    by_label = []
    for f in C.fields():
        value = F.max(F.when(F.col("field_name") == f.name, F.col("value")))
        by_label.append(value.alias(f.name))
    wide = record.groupBy("bid_id").agg(*by_label)

    def typed(f: C.Field) -> F.Column:
        if f.kind == "list":
            return F.split(f.name, "; ")
        if f.kind == "contact":
            return F.when(F.col(f.name).isNotNull(), E.public_contact(X.contact(F.col(f.name))))
        return F.col(f.name)

    fields = F.struct(*[typed(f).alias(f.label) for f in C.fields()])
    return wide.select("bid_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


_LABELLED = ", ".join(f"max(value) FILTER (WHERE field_name = '{f.name}') AS {f.name}" for f in C.fields())


def _typed_sql(f: C.Field) -> str:
    if f.kind == "list":
        return f"string_split({f.name}, '; ')"
    if f.kind == "contact":
        parts = f"list_transform(string_split(regexp_extract({f.name}, '\\(([^)]*)\\)', 1), ';'), lambda x: regexp_replace(x, '{BLANKS.format()}+', '', 'g'))"
        entries = (
            ("name", f"nullif({COLLAPSED.format(f"regexp_extract({f.name}, '^([^(]*)', 1)")}, '')"),
            ("email", f"list_filter({parts}, lambda x: contains(x, '@'))[1]"),
            ("phone", f"list_filter({parts}, lambda x: NOT contains(x, '@') AND regexp_matches(x, '[0-9]'))[1]"),
        )
        listed = ", ".join(f"{{'k': '{k}', 'v': {v}}}" for k, v in entries)
        return f"CASE WHEN {f.name} IS NOT NULL THEN map_from_entries(list_filter([{listed}], lambda x: x.v IS NOT NULL)) END"
    return f.name


@QUERIES.query(
    "typed_records",
    f"WITH {_FIELDS}, wide AS (SELECT bid_id, {_LABELLED} FROM record GROUP BY bid_id) SELECT bid_id, to_json({{" + ", ".join(f"'{f.label}': {_typed_sql(f)}" for f in C.fields()) + "})::VARCHAR AS record FROM wide",
)
def typed_records(spark: SparkSession, folder: str) -> DataFrame:
    """A typed JSON record per bid: lists as arrays, the contact as an object without empty parts, null where nothing was found."""
    return _public(_record(spark, folder))


@QUERIES.query(
    "flat_records",
    f"WITH {_FIELDS}, wide AS (SELECT bid_id, {_LABELLED} FROM record GROUP BY bid_id) SELECT bid_id, to_json({{" + ", ".join(f"'{f.label}': {f.name}" for f in C.fields()) + "})::VARCHAR AS flat FROM wide",
)
def flat_records(spark: SparkSession, folder: str) -> DataFrame:
    """A flat JSON record per bid: the 20 labels with a string or null each; what `write_by_bid` and `write_aggregate` take."""
    return flat_record(_record(spark, folder))


def flat_record(record: DataFrame) -> DataFrame:
    """bid_id and flat of decided fields."""
    wide = record.groupBy("bid_id").agg(*[F.max(F.when(F.col("field_name") == f.name, F.col("value"))).alias(f.label) for f in C.fields()])
    return wide.select("bid_id", F.to_json(F.struct(*[f"`{f.label}`" for f in C.fields()]), {"ignoreNullFields": "false"}).alias("flat"))


_KIND = "CASE field_name " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in KINDS.items()) + " END"
_LIST_FORM = (
    f"list_transform(string_split(value, ';'), lambda v: {COLLAPSED.format('v')})",
    "array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '; ')",
)


@QUERIES.query(
    "decision_diagnostics",
    f"""WITH {_DECISIONS},
    parted AS (SELECT *, {_KIND} AS kind, {_LIST_FORM[0]} AS l, list_filter(list_transform(string_split(regexp_extract(value, '\\(([^)]*)\\)', 1), ';'), lambda x: regexp_replace(x, '{BLANKS.format()}+', '', 'g')), lambda x: x <> '') AS q,
        nullif({COLLAPSED.format("regexp_extract(value, '^([^(]*)', 1)")}, '') AS name FROM decided),
    contacted AS (SELECT *, concat_ws('; ', list_filter(q, lambda x: NOT contains(x, '@') AND regexp_matches(x, '[0-9]'))[1], list_filter(q, lambda x: contains(x, '@'))[1]) AS details FROM parted),
    normal AS (SELECT *, CASE kind WHEN 'datetime' THEN {DATED.format("value")} WHEN 'list' THEN {_LIST_FORM[1]}
        WHEN 'contact' THEN nullif(CASE WHEN name IS NULL THEN details WHEN details = '' THEN name ELSE concat(name, ' (', details, ')') END, '') ELSE {COLLAPSED.format("value")} END AS form_value,
        CASE WHEN kind = 'datetime' AND {RELATIVE.format("value")} THEN 'relative_date' ELSE kind END AS data_type FROM contacted)
    SELECT bid_id, field_name, part, candidate_id, to_json({{'candidate_id': candidate_id, 'value': value, 'origin': origin, 'role': role, 'tier': tier, 'amendment_cue': cue, 'doc_label': doc_label,
        'document_type': document_type, 'addendum_number': addendum_number, 'chunk_id': chunk_id, 'normalised': {{'value': form_value, 'data_type': data_type}}}})::VARCHAR AS entry FROM normal""",
)
def decision_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows of a run: what every accepted candidate was, where it came from, and what became of it."""
    return D.diagnostics(_decisions(spark, folder), KINDS)


@QUERIES.query(
    "rejected_candidates",
    f"""WITH {JUDGED}
    SELECT bid_id, field_name, candidate_id, reason, failed_key FROM (SELECT e.bid_id, e.field_name, e.candidate_id, reason, evidence_key AS failed_key,
        row_number() OVER (PARTITION BY e.candidate_id ORDER BY evidence_key) AS rn FROM placed JOIN evidence e USING (evidence_key) WHERE e.candidate_id IS NOT NULL AND reason IS NOT NULL) WHERE rn = 1""",
)
def rejected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows of candidates that were not accepted, with the first reason."""
    return D.rejected(table(spark, folder, "evidence"), table(spark, folder, "chunks"))


@QUERIES.query(
    "group_packages",
    "SELECT bid_id, field_group, fields, aliases FROM (SELECT DISTINCT bid_id FROM parsed_docs WHERE bid_id IS NOT NULL) CROSS JOIN (VALUES "
    + ", ".join("('{}', '{}', {})".format(g, ",".join(f.name for f in C.fields(g)), len(C.aliases(g))) for g in C.GROUPS)
    + ") AS g(field_group, fields, aliases)",
)
def group_packages(spark: SparkSession, folder: str) -> DataFrame:
    """What a model is asked for: every bid with the six groups of fields, and how many aliases retrieval uses for each."""
    groups = [F.struct(F.lit(g).alias("field_group"), F.lit(",".join(f.name for f in C.fields(g))).alias("fields"), F.lit(len(C.aliases(g))).alias("aliases")) for g in C.GROUPS]
    bids = table(spark, folder, "parsed_docs").where("bid_id IS NOT NULL").select("bid_id").distinct()
    return bids.select("bid_id", F.explode(F.array(*groups)).alias("g")).select("bid_id", "g.*")
