"""Folds, retrieval, vectors and evidence against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendrel.functions import text as X
from tendrel.operators import evidence, packing, retrieval
from tendrel.operators.vectors import nearest


@given(st.text("ab \n", max_size=300), st.integers(3, 60), st.data())
@settings(max_examples=150, deadline=None)
def test_split_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = packing.split_text(text, limit, overlap, 10)
    assert all(len(p) <= limit and p == p.strip() for p in pieces)
    kept = "".join(text.split())
    assert set(kept) == set("".join("".join(p.split()) for p in pieces))
    if len(text) <= limit:
        assert pieces == ([text.strip()] if text else [])


def slow_pieces(text, limit, overlap, reach):
    """Pieces by trying every end: the last place behind a blank that is near enough to the limit."""
    start, out = 0, []
    while start < len(text):
        full = min(start + limit, len(text))
        ends = [e for e in range(max(start + 2, full - reach + 1), full + 1) if text[e - 1] in " \n"] if full < len(text) else []
        out.append((start, max(ends, default=full)))
        if full == len(text):
            return out
        start = max(start + 1, out[-1][1] - overlap)
    return out


@given(st.text("ab \n", max_size=200), st.integers(2, 40), st.integers(1, 12), st.data())
@settings(max_examples=200, deadline=None)
def test_split_spans_against_all_ends(text, limit, reach, data):
    overlap = data.draw(st.integers(0, limit - 1))
    assert list(packing.split_spans(text, limit, overlap, reach)) == slow_pieces(text, limit, overlap, reach)


def test_packing_merges_short_and_splits_long(spark):
    rows = [
        ("d", 1, 1, "pdf", "Page 1", "one two"), ("d", 2, 2, "pdf", "Page 2", "three"), ("d", 3, 3, "pdf", "Page 3", "x" * 30), ("d", 4, 4, "pdf", "Page 4", " "),
        ("d", 5, 5, "pdf", "Page 5", None), ("d", 6, 6, "pdf", "Page 6", "end"), ("e", 1, 7, "html", None, "only"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, section_seq int, section_key long, source_format string, section_identifier string, text string")
    out = packing.pack_sections(df, limit=20, overlap=5).orderBy("doc_id", "chunk_seq").collect()
    assert [(r.doc_id, r.section_identifier, r.page_numbers, r.text) for r in out] == [
        ("d", "Page 1 & Page 2", [1, 2], "one two\n\nthree"), ("d", "Page 3", [3], "x" * 20), ("d", "Page 3", [3], "x" * 15), ("d", "Page 6", [6], "end"), ("e", "unknown", None, "only"),
    ]
    assert packing.pack_sections(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack_sections(df, limit=5, overlap=5)


def slow_context(sizes, budget, most):
    used, out = 0, []
    for k, size in enumerate(sizes):
        if used + size <= budget and len(out) < most:
            used += size
            out.append((k, len(out) + 1, used))
    return out


def test_context_against_a_plain_fold(spark):
    rng = random.Random(8)
    bids = {"b": [5, 4, 9, 2, 1, 1], "one": [30], "many": [rng.randint(1, 9) for _ in range(60)], "late": [11, 12, 10] * 6 + [1]}
    rows = [(b, "d", k, k, "x" * n) for b, sizes in bids.items() for k, n in enumerate(sizes)] + [("b", "d", 9, 9, None), (None, "d", 9, 9, "x"), ("b", "d", 9, 9, "")]
    df = spark.createDataFrame(rows, "bid_id string, doc_id string, chunk_seq int, chunk_key long, text string")
    for budget, most in ((12, 4), (25, 3), (1000, 7)):
        got = packing.pack_context(df, budget, most).collect()
        for b, sizes in bids.items():
            left = {r.chunk_key for r in packing.trimmed(df, packing.pack_context(df, budget, most)).collect() if r.bid_id == b} if budget == 12 else None
            assert left is None or left == {k for k in range(len(sizes))} - {k for k, *_ in slow_context(sizes, budget, most)}
            assert [(r.chunk_key, r.place, r.used) for r in sorted((r for r in got if r.bid_id == b), key=lambda r: r.place)] == slow_context(sizes, budget, most)
    assert packing.pack_context(df.where("false")).count() == 0


def slow_bm25(corpus, query):
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(t for words in corpus.values() for t in set(words))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
    out = {}
    for c, words in corpus.items():
        tf = Counter(words)
        s = sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(words) / avg)) for q in query)
        if s > 0:
            out[c] = s
    return out


def test_literal_search_against_plain_bm25(spark):
    rng = random.Random(2)
    words = "pump valve bid bond late fee depot crate".split()
    chunks = [(k, f"c{k:02}", "b" if k % 3 else "a", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(40)]
    df = spark.createDataFrame([*chunks, (90, "c01", "b", "repeat"), (91, None, "b", "x"), (92, "c92", "b", None)], "chunk_key long, chunk_id string, bid_id string, text string")
    queries = [(1, "a", "Pump pump bond"), (2, "b", "late fee"), (3, "b", "unknown")]
    found = retrieval.literal_search(df, spark.createDataFrame(queries, "q long, bid_id string, text string"), "q", 5).collect()
    for q, bid, text in queries:
        want = slow_bm25({c: t.split() for _, c, b, t in chunks if b == bid}, text.lower().split())
        best = sorted(want, key=lambda c: (-round(want[c], 9), c))[:5]
        got = sorted((r for r in found if r.q == q), key=lambda r: r["rank"])
        assert [r.chunk_id for r in got] == best
        assert [r.score for r in got] == pytest.approx([want[c] for c in best], abs=1e-6)


def test_literal_search_in_parts_equals_the_whole(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    chunks = [(k, f"c{k % 180:03}", "large" if k % 5 else f"s{k % 3}", " ".join(rng.choices(words, k=rng.randint(0, 15))) or "-") for k in range(200)]
    chunks += [(300, "same1", "large", "w1 w2 w3"), (301, "same2", "large", "W1, w2; w3"), (None, "c001", "large", "w1 w1 w1"), (302, "x", None, "w1")]
    df = spark.createDataFrame(chunks, "chunk_key long, chunk_id string, bid_id string, text string")
    asked = [(k, "large" if k % 3 else f"s{k % 4}", " ".join(rng.choices(words, k=6))) for k in range(12)]
    asked += [(20, "none", "w1"), (21, None, "w1"), (22, "large", ""), (23, "large", "w1 w2 w3")]
    queries = spark.createDataFrame(asked, "q long, bid_id string, text string")
    want = {}
    for q, bid, text in asked:
        corpus = {}
        for _, c, b, t in sorted((c for c in chunks if c[2] == bid and bid), key=lambda c: (c[0] is None, c[0])):
            corpus.setdefault(c, re.findall(r"\w+", t.lower()))
        scores = slow_bm25(corpus, text.split()) if corpus and text else {}
        for rank, c in enumerate(sorted((c for c in scores if round(scores[c], 9) > 0), key=lambda c: (-round(scores[c], 9), c))[:3], 1):
            want[q, rank] = (bid, c, pytest.approx(scores[c], abs=1e-6))
    for part in (1000, 50, 7, 1):
        got = retrieval.literal_search(df, queries, "q", 3, part).collect()
        assert {(r.q, r["rank"]): (r.bid_id, r.chunk_id, r.score) for r in got} == want
        assert len(got) == len(want)
    assert retrieval.literal_search(df, queries.where("false"), "q").count() == retrieval.literal_search(df.where("false"), queries, "q").count() == 0


def test_literal_search_moves_neither_postings_nor_scores(spark):
    # Every query meets every chunk of its bid: 12,000 scores from 6,000 postings.
    rows = spark.range(300).selectExpr("id AS chunk_key", "concat('c', id) AS chunk_id", "'b' AS bid_id", "concat('a b c d e f g h i j k l m n o p q r s t', id) AS text")
    queries = spark.range(40).selectExpr("id AS q", "'b' AS bid_id", "concat('a b c d e f g h i j k l m n o p q r s t', id) AS text")
    store = spark.sparkContext._jsc.sc().statusStore()

    def moved() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before, usual = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        assert retrieval.literal_search(rows, queries, "q", 5).count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert moved() - before < 6_000


def test_ranks_over_many_tasks_equal_plain_ranks(spark):
    rng = random.Random(4)
    rows = [(g, round(rng.random(), 1) if g == "a" else 1.0, f"{rng.randint(0, 99):02}{k}") for g in "ab" for k in range(200)]
    df = spark.createDataFrame(rows, "g string, s double, t string")
    # A bound of the largest group's size, one less, none at all, and a bound given by the caller.
    for whole, largest in ((200, None), (199, None), (0, None), (10**6, 5), (0, 5)):
        got = {(r.g, r.t): r["rank"] for r in retrieval.ranked(df, ["g"], "s", "t", "rank", largest, whole).collect()}
        for g in "ab":
            want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
            assert [got[g, r[2]] for r in want] == list(range(1, 201))


def test_embedding_matches_its_definition():
    import hashlib

    words = ["pump", "naïve", "pump"]
    base = [int(hashlib.md5(w.encode()).hexdigest(), 16) for w in words]
    want = [sum(((b + 17 * i) % 2000) / 1000 - 1 for b in base) for i in range(8)]
    assert (retrieval.embed(words, 8) / 1000).tolist() == pytest.approx(want)
    assert retrieval.embed([], 8).tolist() == retrieval.embed(["empty"], 8).tolist()


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 5)).round(2)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(60, None), (61, []), (62, [0.0] * 5), (63, [1.0, None, 1.0, 1.0, 1.0]), (64, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 3, block=16).collect()
    size = np.sqrt((data**2).sum(1))
    for q in (0, 20, 40):
        s = (data @ data[q] / size / size[q]).round(9)
        want = sorted((k for k in range(60) if k != q), key=lambda k: (-s[k], k))[:3]
        assert [r.near_id for r in sorted((r for r in got if r.vec_id == q), key=lambda r: r["rank"])] == want
    assert nearest(df.where("false"), df.where("false"), "vec_id", "embedding", 3).count() == 0


def test_match_levels(spark):
    rows = [
        ("a@b.com", "mail a@b.com now", "L1"), ("it's “so”", "It is it’s \"so\"  here", "L2"), ("Two  Words", "two words", "L3"), ("a@b.com", "mail a@b.\ncom", "L4"),
        ("absent", "text", None), ("", "text", None), ("x", "", None), (None, "x", None), (" ", "ab", None),
    ]
    df = spark.createDataFrame(rows, "q string, t string, want string").select("*", X.match_level(F.col("q"), F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_resolve_and_combine(spark):
    rows = [(1, "b", 1, "Acme Inc"), (2, "b", 0, None), (3, "b", 0, "N/A"), (4, "b", 1, "ACME INC."), (5, "b", 1, "Other"), (6, "b", 2, "Third"), (7, "c", 1, "___"), (8, "d", 1, "One; two;; ONE")]
    df = spark.createDataFrame(rows, "record_id long, bid_id string, tier int, name string")
    out = {r.bid_id: r for r in evidence.resolve(df, ["name"], [F.col("tier"), F.lit(0).alias("o")]).collect()}
    assert out["b"].value == "Acme Inc" and out["b"].candidates == 4 and out["b"].rivals == 1 and out["b"].conflicting
    assert set(out) == {"b", "d"} and not out["d"].conflicting
    items = {r.bid_id: r["items"] for r in evidence.combine_lists(df, ["name"]).collect()}
    assert items["d"] == "One; two"


def test_ground_reasons(spark):
    chunks = spark.createDataFrame([("c", 1, "the text"), ("c", 2, "later"), ("n", 3, None)], "chunk_id string, chunk_key long, text string")
    rows = [(1, "c", "text"), (2, "c", "later"), (3, "z", "x"), (4, "c", None), (5, "c", "a...b"), (6, "n", "x"), (7, None, "x")]
    found = evidence.ground(spark.createDataFrame(rows, "evidence_key long, chunk_id string, quote string"), chunks).collect()
    assert {r.evidence_key: (r.level, r.reason) for r in found} == {
        1: ("L1", None), 2: (None, "quote_not_in_chunk"), 3: (None, "unknown_evidence_id"), 4: (None, "no_evidence"), 5: (None, "invalid_quote"),
        6: (None, "quote_not_in_chunk"), 7: (None, "unknown_evidence_id"),
    }
    assert {r.evidence_key: (r.start_at, r.end_at, r.matched) for r in found if r.level} == {1: (4, 8, "text")}


def test_combine_all_lists(spark):
    rows = [
        (1, "b", "Desk (a@b.example; 555-0100)", "AB-1; CD-2", "Rated; the vendor expects 5."),
        (2, "b", "desk (A@B.example; 555-0100); Ann", "cd 2;; EF-3; N/A", "Rated; the owner expects 6."),
        (3, "c", "Open (x; y", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, bid_id string, contact string, model string, text string")
    out = {(r.bid_id, r.field_name): r["items"] for r in evidence.combine_lists(df, ["contact", "model", "text"], frozenset({"text"})).collect()}
    assert out == {
        ("b", "contact"): "Desk (a@b.example; 555-0100); Ann", ("b", "model"): "AB-1; CD-2; EF-3",
        ("b", "text"): "Rated; the vendor expects 5.; Rated; the owner expects 6.", ("c", "contact"): "Open (x; y",
    }


def test_field_search_over_many_tasks(spark):
    """One bid with most of the chunks, many equal and close scores: ranks over many tasks give the same rows."""
    rng = random.Random(9)
    words = "bid bond due date contract pump model number delivery schedule product form email term of the".split()
    rows = []
    for k in range(150):
        bid = "hot" if k % 10 else f"b{k % 7}"
        text = " ".join(rng.choices(words, k=rng.randint(1, 6))) if k % 3 else "due date bond"
        rows.append((k, f"c{k:03}", bid, f"{bid}-{k % 4}", "html" if k % 2 else "pdf", "Due Date" if k % 5 == 1 else None, text))
    df = spark.createDataFrame(rows, "chunk_key long, chunk_id string, bid_id string, doc_id string, source_format string, section_identifier string, text string")
    for per_document in (False, True):
        want = sorted(map(tuple, retrieval.field_search(df, per_document=per_document).collect()), key=repr)
        assert want and sorted(map(tuple, retrieval.field_search(df, per_document=per_document, whole=20).collect()), key=repr) == want


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None)], "k int, w array<string>")
    got = {r.k: r.c for r in df.select("k", retrieval.term_counts(F.col("w")).alias("c")).collect()}
    assert {k: c and sorted(map(tuple, c)) for k, c in got.items()} == {1: [("a", 1), ("b", 2)], 2: [], 3: None}
