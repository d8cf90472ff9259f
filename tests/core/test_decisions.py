"""Decisions among candidates and the files of a run, on small fixtures."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tendrel import catalog as C
from tendrel.functions import text as X
from tendrel.operators import decisions as D
from tendrel.operators import evidence, extraction, retrieval
from tendrel.plans import decision_queries as Q
from tendrel.sources import files, sinks

SCORED = "candidate_id string, bid_id string, field_name string, value string, chunk_id string, doc_id string, pieces long, role string, cue string, origin string, document_type string, addendum_number int, doc_label string, tier int"


def scored(spark, *rows):
    """Candidates (id, field, value, role, document type, addendum, label) of one bid."""
    full = [(i, "b", f, v, "c", "d", 1, r, None, "llm", t, a, label, int(r == "amendment")) for i, f, v, r, t, a, label in rows]
    return spark.createDataFrame(full, SCORED)


def outcome(df):
    parts = D.decide(df, Q.MANY)
    fields = {r.field_name: r for r in D.decided_fields(parts, Q.MANY).collect()}
    return {r.candidate_id: r.part for r in parts.collect()}, fields


def test_amendment_beats_main_and_higher_addendum_wins(spark):
    parts, fields = outcome(scored(
        spark, ("m", "due_date", "May 1", "baseline", "rfp_main", None, "D1"), ("a1", "due_date", "May 8", "amendment", "addendum", 1, "D2"), ("a2", "due_date", "May 9", "amendment", "addendum", 2, "D3"),
    ))
    assert parts == {"m": "superseded", "a1": "conflict", "a2": "chosen"}
    f = fields["due_date"]
    assert (f.status, f.rule, f.value, f.superseded, f.conflicts) == ("conflicting", "addendum_amendment_with_conflict", "May 9", 1, 1)


def test_clarifications_decide_nothing(spark):
    parts, fields = outcome(scored(spark, ("q", "title", "Pumps", "clarification", "addendum", 1, "D2"), ("q2", "installation", "No", "clarification", "addendum", 1, "D2"), ("p", "title", "Valves", "baseline", "portal_listing", None, "D1")))
    assert parts == {"q": "clarification", "q2": "clarification", "p": "chosen"}
    assert (fields["title"].status, fields["title"].rule, fields["title"].value) == ("found", "portal_only", "Valves")
    assert (fields["installation"].status, fields["installation"].rule, fields["installation"].value, fields["installation"].evidence) == ("not_found", "clarification_only", None, 0)


def test_repeats_agree_and_lists_collect(spark):
    parts, fields = outcome(scored(
        spark, ("a", "title", "New Pumps", "baseline", "rfp_main", None, "D1"), ("b", "title", "new pumps.", "baseline", "rfp_main", None, "D10"), ("c", "title", "Pumps", "baseline", "rfp_main", None, "D2"),
        ("x", "product", "Pump", "baseline", "rfp_main", None, "D2"), ("y", "product", "PUMP", "baseline", "addendum", 1, "D3"), ("z", "product", "Valve", "baseline", "rfp_main", None, "D10"),
    ))
    assert parts == {"a": "chosen", "b": "agreeing", "c": "agreeing", "x": "contributing", "y": "chosen", "z": "contributing"}
    # An addendum's number ranks before the label, and labels rank as text: D10 before D2.
    assert fields["product"].value == "PUMP; Valve" and fields["product"].rule == "aggregated_all_tiers" and fields["product"].evidence == 3
    parts, fields = outcome(scored(spark, ("x", "product", "Pump", "baseline", "rfp_main", None, "D1"), ("y", "product", "Valve", "amendment", "addendum", 1, "D2")))
    assert parts == {"x": "superseded", "y": "chosen"} and fields["product"].value == "Valve" and fields["product"].rule == "addendum_amendment_aggregated"


def test_candidates_and_provenance(spark):
    long = "x" * 400
    chunks = spark.createDataFrame(
        [
            (1, "c1", "b", "d1", 0, f"The due date is hereby changed to May 9. {long} Title: Pumps", None), (2, "c2", "b", "d2", 0, "Bring the Vendor Affidavit and the\nvendor  affidavit.", None),
            (3, "c1", "b", "d1", 1, "a repeat", None), (4, "c3", "b", "gone", 0, "Lost text", None), (5, "c4", "b", "d1", 2, None, None),
        ],
        "chunk_key long, chunk_id string, bid_id string, doc_id string, chunk_seq int, text string, page_numbers array<int>",
    )
    evidence = spark.createDataFrame(
        [(1, "A", "b", "due_date", "c1", "May 9"), (2, "A", "b", "due_date", "c1", "due  date"), (3, "B", "b", "title", "c1", "pumps"), (4, "C", "b", "title", "c1", "absent"), (5, "D", "b", "title", "c3", "Lost"), (6, None, "b", "title", "c1", "Pumps"), (7, "E", "b", "title", "c4", "x")],
        "evidence_key long, candidate_id string, bid_id string, field_name string, chunk_id string, quote string",
    )
    at = datetime(2024, 1, 1)
    documents = spark.createDataFrame(
        [(1, "b", "d1", at, ("rfp_main", None)), (2, "b", "d1", datetime(2024, 2, 1), ("addendum", 3)), (3, "b", "d2", at, ("affidavit", None)), (4, None, "d9", at, None)],
        "parsed_key long, bid_id string, doc_id string, ingested_at timestamp, metadata struct<document_type string, addendum_number int>",
    )
    every = D.model_candidates(evidence, chunks).unionByName(D.rule_candidates(chunks))
    rows = {r.candidate_id if r.origin == "llm" else "rule": r for r in D.with_provenance(every, documents).collect()}
    assert set(rows) == {"A", "B", "rule"}
    assert (rows["A"].value, rows["A"].pieces, rows["A"].role, rows["A"].cue, rows["A"].doc_label, rows["A"].addendum_number, rows["A"].tier) == ("May 9", 2, "amendment", "is hereby changed", "D1", 3, 1)
    assert (rows["B"].value, rows["B"].role, rows["B"].cue) == ("Pumps", "baseline", None)
    assert (rows["rule"].value, rows["rule"].field_name, rows["rule"].document_type, rows["rule"].doc_label) == ("Vendor Affidavit", D.RULE_FIELD, "affidavit", "D2")
    assert {r.candidate_id: (r.reason, r.failed_key) for r in D.rejected(evidence, chunks).collect()} == {"C": ("quote_not_in_chunk", 4), "E": ("quote_not_in_chunk", 7)}
    entries = {r.candidate_id: json.loads(r.entry) for r in D.diagnostics(D.decide(D.with_provenance(every, documents), Q.MANY), Q.KINDS).collect()}
    assert entries["A"]["normalised"] == {"value": "May 9", "data_type": "datetime"} and entries["A"]["amendment_cue"] == "is hereby changed"
    empty = D.model_candidates(evidence.where("false"), chunks).unionByName(D.rule_candidates(chunks.where("false")))
    assert D.decided_fields(D.decide(D.with_provenance(empty, documents), Q.MANY), Q.MANY).count() == 0


def test_labels_of_a_bid_of_any_size(spark):
    df = spark.createDataFrame([("b", f"d{k:02}") for k in range(30)] * 2 + [("c", "d05")], "bid_id string, doc_id string")
    want = {("b", f"d{k:02}"): f"D{k + 1}" for k in range(30)} | {("c", "d05"): "D1"}
    for largest in (None, 10**9):  # over all tasks, and by a window
        assert {(r.bid_id, r.doc_id): r.label for r in D.document_labels(df, largest).collect()} == want


def test_records_and_invariants(spark):
    df = scored(spark, ("t", "title", "Pumps", "baseline", "rfp_main", None, "D1"), ("m", "model_no", "A-1", "baseline", "rfp_main", None, "D1"), ("n", "model_no", "B-2", "baseline", "rfp_main", None, "D2"), ("k", "contact_info", "Ann (555-0100)", "baseline", "rfp_main", None, "D1"))
    bids = spark.createDataFrame([("b",), ("none",), (None,)], "bid_id string")
    record = D.all_decided(bids, D.decided_fields(D.decide(df, Q.MANY), Q.MANY), [f.name for f in C.fields()])
    assert record.count() == 40 and D.violations(record).count() == 0
    assert D.violations(record.withColumn("evidence", F.lit(0))).count() == 3
    typed = {r.bid_id: json.loads(r.record) for r in Q._public(record).collect()}
    assert list(typed["b"]) == [f.label for f in C.fields()] and set(typed["none"].values()) == {None}
    assert typed["b"]["Title"] == "Pumps" and typed["b"]["Model_no"] == ["A-1", "B-2"] and typed["b"]["contact_info"] == {"name": "Ann", "phone": "555-0100"}


def test_value_forms(spark):
    rows = [("identifier", "rfp 1-2", ("RFP12", "identifier")), ("datetime", "within 3 days", ("within 3 days", "relative_date")), ("datetime", "9 EST", ("9 America/New_York", "datetime")), ("contact", "A (5 5; a @b)", ("A (55; a@b)", "contact")), ("list", "a;A ; b", ("a; b", "list")), ("string", " x  y", ("x y", "string")), ("string", None, None)]
    df = spark.createDataFrame([(n, k, v) for n, (k, v, _) in enumerate(rows)], "n int, k string, v string").orderBy("n")
    assert [r.x and tuple(r.x) for r in df.select(X.normalised(F.col("v"), F.col("k")).alias("x")).collect()] == [w for *_, w in rows]
    pairs = spark.createDataFrame([("Ann", None, "555", "ask Ann, 555"), ("Ann", "a@b", None, "ask ann"), (None, "", None, "x")], "n string, e string, p string, x string")
    assert [r.s for r in pairs.select(X.contact_supported(*map(F.col, "nepx")).alias("s")).collect()] == [True, False, False]
    lists = spark.createDataFrame([(["a-1", "b"], "A–1 and b"), (["c"], "a"), ([], "a")], "i array<string>, x string")
    assert [r.s for r in lists.select(X.list_supported(F.col("i"), F.col("x")).alias("s")).collect()] == [True, False, True]


def test_files_of_a_run(spark, tmp_path):
    flat = spark.createDataFrame([("b/2", '{"Title": "É", "Model_no": null}'), ("a", '{"Title": null}'), (None, "{}"), ("c", None)], "bid_id string, flat string")
    for _ in range(2):  # a second run replaces the files
        paths = {r.bid_id: r.path for r in sinks.write_by_bid(flat, "flat", str(tmp_path / "out"), ".flat.json").collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.flat.json", "b%2F2.flat.json"] and set(paths) == {"a", "b/2"}
    assert (tmp_path / "out" / "b%2F2.flat.json").read_text() == '{\n  "Title": "É",\n  "Model_no": null\n}\n'
    assert sinks.write_aggregate(flat.where("flat IS NOT NULL"), "flat", str(tmp_path / "all.json")) == 2
    document = json.loads((tmp_path / "all.json").read_text())
    assert document["schema"] == [f.label for f in C.fields()] and [b["bid_id"] for b in document["bids"]] == ["a", "b/2"]
    assert sinks.write_aggregate(flat.where("false"), "flat", str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text())["bids"] == []
    calls = spark.createDataFrame([("a", "provider_error"), ("a", "provider_error"), ("b/2", "provider_error"), ("b/2", "ok")], "bid_id string, status string")
    assert {r.bid_id for r in sinks.answered(flat.where("bid_id IS NOT NULL"), calls).collect()} == {"b/2", "c"}


@pytest.mark.parametrize("group", [*C.GROUPS, "unknown"])
def test_groups(group):
    fields = C.fields(group)
    assert all(f.group == group for f in fields) and bool(fields) == (group != "unknown")
    assert len(C.aliases(group)) == len(set(C.aliases(group))) and sum(len(C.fields(g)) for g in C.GROUPS) == 20


def test_providers_by_name():
    known = {"fake": lambda: extraction.ScriptedProvider([]), "other": lambda: None}
    assert extraction.provider_factory({"LLM_PROVIDER": " Fake"}, known) is known["fake"] and extraction.provider_factory({}, known, "other") is known["other"]
    for settings in ({}, {"LLM_PROVIDER": "absent"}):
        with pytest.raises(extraction.ConfigError):
            extraction.provider_factory(settings, known)


def test_coverage_of_replies(spark):
    rows = [("p", "ok", "candidate", "title"), ("p", "ok", "candidate", "title"), ("p", "ok", "not_found", "title"), ("p", "ok", "candidate", "product"), ("p", "ok", "not_found", "due_date"), ("p", "ok", "missing", "installation"), ("p", "ok", "warning", "x"), ("q", "provider_error", "error", None)]
    df = spark.createDataFrame(rows, "package_id string, status string, kind string, field string")
    got = {(r.package_id, r.field): r.state for r in extraction.coverage(df).collect()}
    assert got == {("p", "title"): "both", ("p", "product"): "candidates", ("p", "due_date"): "not_found", ("p", "installation"): "missing"}


def test_search_in_named_documents(spark):
    chunks = spark.createDataFrame(
        [(k, f"c{k}", "b", f"d{k % 3}", "pdf", None, "bid bond due date " + "pump " * k) for k in range(12)],
        "chunk_key long, chunk_id string, bid_id string, doc_id string, source_format string, section_identifier string, text string",
    )
    files = spark.createDataFrame([("b", "d0", ("main.pdf",)), ("b", "d1", ("x.pdf",)), ("b", "d2", None)], "bid_id string, doc_id string, metadata struct<source_filename string>")
    for name in ("main.pdf", "d0"):
        only = retrieval.documents_named(files, name)
        got = retrieval.field_search(chunks, only=only).collect()
        assert got and {int(r.chunk_id[1:]) % 3 for r in got} == {0}
        # The same as the search of that document on its own: the statistics are those of the bid either way.
        alone = {tuple(r[1:]) for r in retrieval.field_search(chunks, per_document=True).where("doc_id = 'd0'").collect()}
        assert {tuple(r) for r in got} == {(r[0], *r[1:]) for r in ((("b", *a[1:])) for a in alone)}
    assert retrieval.field_search(chunks, only=retrieval.documents_named(files, "none")).count() == 0


def test_context_rules(spark):
    chunks = spark.createDataFrame(
        [
            (1, "a1", "b", "aff", 0, "The Vendor Affidavit", [1]), (2, "a2", "b", "aff", 1, "this affidavit", [1]), (3, "s1", "b", "small", 0, "x", None),
            *[(10 + k, f"l{k}", "b", "large", k, "x", [k // 2 + 1]) for k in range(10)], (99, "n", "b", "none", 0, "x", None),
        ],
        "chunk_key long, chunk_id string, bid_id string, doc_id string, chunk_seq int, text string, page_numbers array<int>",
    )
    documents = spark.createDataFrame([("aff", 10, "affidavit"), ("small", 15_000, None), ("large", 15_001, "rfp_main")], "doc_id string, text_chars long, document_type string")
    found = spark.createDataFrame([("b", "large", "l7", "title"), ("b", "large", "l9", "product"), ("b", "small", "s1", "product")], "bid_id string, doc_id string, chunk_id string, field_name string")
    got = {r.chunk_key: r.reasons for r in evidence.select_context(chunks, documents, found, ["product"]).collect()}
    assert got == {1: "affidavit", 3: "whole", 10: "front", 11: "front", 12: "front", 13: "front", 16: "neighbour", 17: "retrieved", 18: "neighbour,page", 19: "retrieved"}


def test_replies_in_order_with_their_chunks(spark):
    rows = [("p", "ok", "candidate", f, v, h, "q") for f, v, h in (("title", "B", "E3"), ("title", "A", "E1"), ("due_date", "x", "E2"), ("bid_number", "9", "E2"), ("title", "B", "E2"))]
    rows += [("p", "ok", "not_found", "product", None, None, None), ("p", "ok", "candidate", "title", "C", "E9", "q")]
    results = spark.createDataFrame(rows, "package_id string, status string, kind string, field string, value string, handle string, detail string")
    handles = spark.createDataFrame([("p", "E1", "c1", "D10", 0), ("p", "E2", "c2", "D2", 5), ("p", "E3", "c3", "D2", 2), ("q", "E9", "c9", "D1", 0)], "package_id string, handle string, chunk_id string, doc_label string, excerpt int")
    assert sorted((r.handle or "", r.chunk_id) for r in extraction.resolved(results, handles).collect()) == [("", None), ("E1", "c1"), ("E2", "c2"), ("E2", "c2"), ("E2", "c2"), ("E3", "c3"), ("E9", None)]
    got = [(r.place, r.field, r.value, r.handle) for r in extraction.in_order(results, handles, [f.name for f in C.fields()]).orderBy("place").collect()]
    assert got == [(1, "bid_number", "9", "E2"), (2, "title", "C", "E9"), (3, "title", "B", "E3"), (4, "title", "B", "E2"), (5, "title", "A", "E1"), (6, "due_date", "x", "E2")]


def test_parsed_documents_as_files(spark, tmp_path):
    (tmp_path / "bid").mkdir()
    (tmp_path / "bid" / "a.b.html").write_text("<html><body><p>Test</p><b>Due:</b><p>May</p></body></html>")
    sections = files.parse_html(files.scan(spark, str(tmp_path / "bid")))
    documents = files.parsed_documents(sections)
    assert [(r.bid_id, r.stem) for r in documents.collect()] == [("bid", "a.b")]
    sinks.write_by_bid(documents.select(F.col("stem").alias("bid_id"), "document"), "document", str(tmp_path / "out"), "_parsed.json")
    parsed = json.loads((tmp_path / "out" / "a.b_parsed.json").read_text())
    assert parsed["metadata"]["source_filename"] == "a.b.html" and parsed["metadata"]["section_count"] == 2 and [x["text"] for x in parsed["sections"]] == ["Test", "Due: May"]
    assert files.parsed_documents(sections.where("false")).count() == 0
