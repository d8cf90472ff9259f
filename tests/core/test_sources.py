"""Files, streams and model calls."""

from __future__ import annotations

import json
import os

import pytest

from tendrel.operators import extraction as X
from tendrel.sources import files
from tendrel.streaming.ingest import ingest

PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body><header>Top</header><!-- no -->
<div><h1>Head</h1><p>First <b>Due Date:</b> May 1<p>See more description</div><script>s()</script><label>Contact:</label> Ann &amp; Bob <footer>End</footer></body></html>"""


def test_html_sections():
    assert files.html_sections(PAGE) == [("Main Content", "Head First", False), ("Due Date", "Due Date: May 1", True), ("Contact", "Contact: Ann & Bob", False)]
    assert files.html_sections("just text") == [("Main Content", "just text", False)]
    assert files.html_sections("") == [] and files.html_sections("<body></body>") == []
    assert files.html_sections("<body>a</p></div>b<br>c</body>") == [("Main Content", "a b c", False)]


def test_scan_and_parse(spark, tmp_path):
    bid = tmp_path / "Bid1"
    bid.mkdir()
    (bid / "listing.HTML").write_text(PAGE, encoding="utf-8")
    (bid / "bad.html").write_bytes(b"<body>\xff\xfe</body>")
    (bid / "main.pdf").write_bytes(b"one\x0ctwo")
    (bid / "note.txt").write_text("no")
    scanned = files.scan(spark, str(bid))
    assert {(r.bid_id, r.filename, r.kind) for r in scanned.select("bid_id", "filename", "kind").collect()} == {("Bid1", "listing.HTML", "html"), ("Bid1", "bad.html", "html"), ("Bid1", "main.pdf", "pdf")}
    out = files.parse(scanned, reader=lambda content: content.decode().split("\f"))
    rows = {(r.filename, r.section_identifier): r for r in out.collect()}
    assert rows["main.pdf", "Page 2"].page_number == 2 and rows["main.pdf", "Page 2"].text == "two"
    assert rows["bad.html", None].error.startswith("UnicodeDecodeError") and rows["listing.HTML", "Due Date"].truncated
    assert [r.low_pages for r in files.low_text_pages(out).collect()] == [[1, 2]]
    assert {r.error is None for r in files.parse_pdf(scanned, reader=lambda c: 1 / 0).collect()} == {False}
    files.write_json(out.select("bid_id", "filename", "text"), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "bid_id=Bid1")).collect()]
    assert len(lines) == 6 and all(set(x) == {"filename", "text"} for x in lines)


def test_ingest_counts_every_file_once(spark, tmp_path):
    bid = tmp_path / "in" / "Bid1"
    bid.mkdir(parents=True)
    args = (str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    (bid / "a.html").write_text("<body>one</body>")
    (bid / "copy.html").write_text("<body>one</body>")
    ingest(spark, *args).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(args[1]).collect()] == ["one"]
    (bid / "b.html").write_text("<body>two</body>")
    ingest(spark, *args).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(args[1]).collect()) == ["one", "two"]


def test_ingest_gives_the_rows_of_batch(spark, tmp_path):
    bid = tmp_path / "in" / "Bid1"
    bid.mkdir(parents=True)
    args = (str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint"))

    def pages(content):
        return content.decode().split("\f")

    for name, text, date in (("a.html", "<body>one</body>", None), ("a.pdf", "p1\fp2", None), ("old.html", "<body>old</body>", 10**9), ("older.pdf", "p3", 10**8)):
        (bid / name).write_text(text)
        if date:
            os.utime(bid / name, (date, date))
        ingest(spark, *args, reader=pages).awaitTermination(120)
    want = files.parse(files.scan(spark, str(bid)), pages)
    got = spark.read.parquet(args[1]).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {(r.filename, r.text) for r in got.collect()} == {("a.html", "one"), ("a.pdf", "p1"), ("a.pdf", "p2"), ("old.html", "old"), ("older.pdf", "p3")}


REPLY = {"candidates": [{"field": "title", "value": "T", "evidence": [{"evidence_id": "E1", "quote": "q"}, {"evidence_id": "E1", "quote": "q"}]}], "not_found": [{"field": "due_date", "reason": "r" * 300}]}


def test_parse_reply():
    fields, handles = ["title", "due_date", "product"], ["E1", "E2"]
    out = X.parse_reply(json.dumps(REPLY), fields, handles)
    assert out == [("warning", "title", "T", None, "duplicate_evidence"), ("candidate", "title", "T", "E1", "q"), ("not_found", "due_date", None, None, "r" * 200), ("missing", "product", None, None, None)]
    assert X.parse_reply("{", fields, handles)[0][4].startswith("invalid_json")
    assert X.parse_reply('{"candidates": []}', fields, handles)[0][4].startswith("schema")

    def reason(item):
        return X.parse_reply(json.dumps({"candidates": [item], "not_found": []}), fields, handles)[0][4]

    quote = [{"evidence_id": "E1", "quote": "q"}]
    assert reason({"field": "x"}) == "unknown_field" and reason({"field": "title", "value": "T"}) == "no_evidence"
    assert reason({"field": "title", "value": " ", "evidence": quote}) == "format_error"
    assert reason({"field": "title", "value": "T", "evidence": [{"evidence_id": "E9", "quote": "q"}]}) == "unknown_evidence_id"
    assert reason({"field": "title", "value": "T", "evidence": [{"evidence_id": "E1", "quote": " "}]}) == "invalid_quote"


def test_retries():
    waits = []
    provider = X.ScriptedProvider([X.TransientError("a"), X.TransientError("b"), "yes"])
    assert X.complete_with_retries(provider, "p", 3, waits.append) == "yes" and waits == [1.0, 2.0]
    with pytest.raises(X.TransientError):
        X.complete_with_retries(X.ScriptedProvider([]), "p", 1, waits.append)
    with pytest.raises(X.ConfigError):
        X.complete_with_retries(X.ScriptedProvider([X.ConfigError("c"), "yes"]), "p", 3, waits.append)


def test_extract(spark):
    def reply(prompt):
        if "broken" in prompt and "invalid" not in prompt:
            return "{"
        if "hopeless" in prompt:
            return "["
        if "down" in prompt:
            raise X.TransientError("down")
        return json.dumps(REPLY)

    rows = [(1, "fine"), (2, "broken"), (3, "hopeless"), (4, "down"), (5, None)]
    packages = spark.createDataFrame([(k, p, ["title", "due_date"], ["E1"]) for k, p in rows], "package_id long, prompt string, fields array<string>, handles array<string>")

    class Replies:
        def complete(self, prompt):
            return reply(prompt)

    out = X.extract(packages, Replies, retries=1, sleep=lambda s: None)
    status = {r.package_id: r.status for r in out.collect()}
    assert status == {1: "ok", 2: "ok", 3: "invalid_output", 4: "provider_error", 5: "provider_error"}
    assert {r.status: r.packages for r in X.group_status(out).collect()} == {"ok": 2, "invalid_output": 1, "provider_error": 2}


def test_embed_missing(spark):
    class Lengths:
        def embed_batch(self, texts):
            assert len(texts) <= 2
            return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([("a",), ("bb",), ("bb",), ("ccc",), (None,), ("",)], "text string")
    empty = spark.createDataFrame([], "cache_key string")
    first = X.embed_missing(texts, empty, Lengths, "m", 2)
    assert sorted(r.vector for r in first.collect()) == [[1.0], [2.0], [3.0]]
    cached = first.where("vector[0] < 3").select("cache_key")
    assert [r.vector for r in X.embed_missing(texts, cached, Lengths, "m", 2).collect()] == [[3.0]]
    assert X.embed_missing(texts, first, Lengths, "other", 2).count() == 3


def test_schema_and_ids():
    schema = X.reply_schema(["title"], ["E1", "E2"])
    piece = schema["properties"]["candidates"]["items"]["properties"]["evidence"]["items"]
    assert piece["properties"]["evidence_id"]["enum"] == ["E1", "E2"]
    turned = dict(reversed(list(schema.items())))
    assert X.prompt_hash("1", "p", schema) == X.prompt_hash("1", "p", turned) != X.prompt_hash("2", "p", schema)
    assert X.candidate_id("f", ["b", "a"], {"x": 1, "y": "é"}) == X.candidate_id("f", ["a", "b"], {"y": "é", "x": 1}) != X.candidate_id("f", ["a"], "v")


def test_pdf_pages_with_tables(spark, tmp_path):
    (tmp_path / "B").mkdir()
    (tmp_path / "B" / "a.pdf").write_bytes(b"x")
    page = files.PdfPage("text", files.printed_label(["Title", "body", "more", "rest", "Page 3 of 12"]), [[["a", None], ["b", "c"]]])
    (row,) = files.parse_pdf(files.scan(spark, str(tmp_path / "B")), reader=lambda content: [page]).collect()
    assert row.printed_label == "Page 3 of 12" and row.tables == [[["a", ""], ["b", "c"]]] and row.error is None
    assert files.printed_label([]) is None and files.printed_label(["3 | 9"]) == "3 | 9" and files.printed_label(["on page 3 of 9"]) is None


def test_a_missing_folder_has_no_files(spark, tmp_path):
    (tmp_path / "bid").mkdir()
    (tmp_path / "bid" / "a.html").write_text("<html><body><p>Test</p></body></html>")
    with pytest.warns(UserWarning, match="absent"):
        assert [r.filename for r in files.scan(spark, str(tmp_path / "bid"), str(tmp_path / "absent")).collect()] == ["a.html"]
    with pytest.warns(UserWarning):
        empty = files.scan(spark, str(tmp_path / "absent"))
    assert empty.columns == files.scan(spark, str(tmp_path / "b*")).columns and files.parse(empty, lambda b: []).count() == 0
