"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import itertools
import random
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm import arrowtext, boilerplate, encoding, leakage, mixing, splitting, truncation, visual

LONG = "wide text with words. " * 20_000


# --- arrow text


@given(st.lists(st.one_of(st.none(), st.text(st.characters(blacklist_categories=("Cs",)))), max_size=8))
@settings(max_examples=60, deadline=None)
def test_codepoints_round_trip(rows):
    column = pa.array(rows, pa.string())
    assert arrowtext.strings(*arrowtext.codepoints(column)).to_pylist() == rows
    assert arrowtext.strings(*arrowtext.codepoints(column.slice(len(rows) // 2))).to_pylist() == rows[len(rows) // 2 :]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 50, "", "c" * 9, "d"])], ["k", "t"])
    for limit in (1, 10, 1000):
        parts = list(arrowtext.slices(batch, limit))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and all(p.num_rows for p in parts)
    assert len(list(arrowtext.slices(batch, 1000))) == 1 and list(arrowtext.slices(batch.slice(0, 0), 5)) == []


# --- problem 1


@given(st.text("ab .,\n\f", max_size=400), st.integers(5, 60), st.data())
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = splitting.spans(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in spans)
    for (a, b, _), (c, d, _) in itertools.pairwise(spans):
        assert c == b - overlap and c > a and d > b
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        whole = text[spans[0][0] : spans[0][1]] + "".join(text[b - 0 : d] for (_, b, _), (_, d, _) in itertools.pairwise(spans))
        assert whole == text
    else:
        assert spans == []


def test_cuts_at_the_strongest_boundary():
    text = "a" * 600 + "\n\n" + "b " * 300
    assert splitting.spans(text, 1000, 200)[0] == (0, 602, "paragraph")
    assert splitting.spans("x" * 2500, 1000, 200)[0] == (0, 1000, "hard")
    with pytest.raises(ValueError):
        splitting.spans("abc", 10, 10)


@given(st.text("ab .,\n", max_size=120), st.integers(3, 20), st.data())
@settings(max_examples=150, deadline=None)
def test_pieces_by_other_sizes(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    sizes = data.draw(st.lists(st.integers(0, 4), min_size=len(text), max_size=len(text)))
    spans = splitting.spans(text, limit, overlap, sizes)
    for a, b, _ in spans:
        assert b > a and (sum(sizes[a:b]) <= limit or b == a + 1)
    for (a, b, _), (c, d, _) in itertools.pairwise(spans):
        assert a < c <= b < d and sum(sizes[c:b]) <= overlap
        assert c == a + 1 or sum(sizes[c - 1 : b]) > overlap or sum(sizes[c - 1 : b + 1]) > limit or sizes[c - 1] == 0
    assert [x[0] for x in spans[:1]] == [0][: len(text)] and [x[1] for x in spans[-1:]] == [len(text)][: len(text)]
    assert splitting.spans(text, limit, overlap, [1] * len(text)) == splitting.spans(text, limit, overlap)


def test_pieces_by_tokens(spark):
    pytest.importorskip("tiktoken")

    def sizes(text):
        encoding = mixing._encoding(f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")
        return splitting.token_sizes(encoding.encode_ordinary, encoding.decode_tokens_bytes)(text)

    text = "Der Bieter liefert 40 Pumpen; naïve – 日本語 text.\n" * 40
    assert sum(sizes(text)) == mixing.count_tokens([text], f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}")[0]
    df = spark.createDataFrame([(1, text, [1]), (2, "short", None), (3, None, None)], "chunk_key long, text string, page_numbers array<int>")
    rows = sorted(splitting.split_texts(df, limit=100, overlap=20, sizes=sizes).collect())
    assert rows[-1].piece == "short" and len(rows) > 8 and all(sum(sizes(text)[r.start : r.start + len(r.piece)]) <= 100 for r in rows[:-1])


def test_pages_follow_the_pieces():
    text = "a" * 700 + "\f" + "b" * 700
    spans = splitting.spans(text, 1000, 200)
    assert splitting.pages_of(text, spans, [4, 5]) == [[4], [4, 5]] or splitting.pages_of(text, spans, [4, 5])[0] == [4]
    assert splitting.pages_of(text, spans, None) == [None] * len(spans)
    assert splitting.pages_of(text, spans, [4, 5, 6]) == [[4, 5, 6]] * len(spans)


def test_split_texts_rows(spark):
    rows = [(1, "short", [1], "x"), (2, None, None, "x"), (3, "  \n", [2], "x"), (4, LONG, [1], "x"), (4, LONG, [1], "x"), (5, "y" * 1000 + "  ", None, "x")]
    df = spark.createDataFrame(rows, "chunk_key long, text string, page_numbers array<int>, piece string")
    out = splitting.split_texts(df).collect()
    by = {k: [r for r in out if r.chunk_key == k] for k in (1, 2, 3, 4, 5)}
    assert [r.piece for r in by[1]] == ["short"] and not by[2] and not by[3]
    assert len(by[5]) == 1 and len(by[4]) == 2 * by[4][0].pieces
    assert all(len(r.piece) <= 1000 for r in out)
    assert splitting.split_texts(df.where("false")).count() == 0


# --- problem 2


def test_consistent_forms():
    def form(*rows):
        return visual.consistent(pa.array(rows, pa.string())).to_pylist()

    assert form("ｆｕｌｌ　ｗｉｄｔｈ１２", "café", "ca​fé", "a b c", None, "", "​") == ["full width12", "café", "café", "a b c", None, "", ""]
    assert form("раураl", "oﬀers", "low‐profile", " two  gaps\n") == ["paypal", "offers", "low-profile", "two gaps"]
    # Another accent, case, digit or quotation mark stays another text.
    assert len(set(form("resume", "résumé", "Resume", "“a”", '"a"', "½", "1/2"))) == 7
    assert form("ệ", "ệ", "ệ") == ["ệ"] * 3


@given(st.lists(st.text("aeocsAu ̧̣́̂̌éüñ​ｂ", max_size=12), min_size=1, max_size=6))
@settings(max_examples=120, deadline=None)
def test_consistent_equals_normalisation_by_string(rows):
    def slow(s):
        s = "".join(c for c in s if unicodedata.category(c) != "Cf")
        return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFKD", s)).split())

    out = visual.consistent(pa.array(rows, pa.string()))
    assert out.to_pylist() == [slow(r) for r in rows]
    assert visual.consistent(out).to_pylist() == out.to_pylist()


@given(st.lists(st.text("각가한글ᄀ하ᅵᆨᆫaé ", max_size=10), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_hangul_equals_nfc(rows):
    def slow(s):
        return " ".join(unicodedata.normalize("NFC", s).split())

    column = pa.array(rows, pa.string())
    assert visual.consistent(column).to_pylist() == [slow(r) for r in rows]
    assert visual.consistent(pa.array([unicodedata.normalize("NFD", r) for r in rows])).to_pylist() == [slow(r) for r in rows]


def test_ideographs_and_lookalikes():
    def form(*rows):
        return visual.consistent(pa.array(rows, pa.string())).to_pylist()

    wide = [chr(cp) for cp in (*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)) if unicodedata.normalize("NFC", chr(cp)) != chr(cp)]
    assert len(wide) > 900 and form(*wide) == [unicodedata.normalize("NFC", c) for c in wide]
    assert form("օսհ", "ՕՍ", "ᎠᎡᎢ", "ꓐꓑꓓ", "ㄱㅏ", "ﾡￂ", "가") == ["ouh", "OU", "DRT", "BPD", "ㄱㅏ", "ㄱㅏ", "가"]


def test_respelt_quotes(spark):
    chunks = spark.createDataFrame([("c1", "The café opens at 9."), ("c1", "The café opens at 9."), ("c2", None), (None, "x"), ("c3", LONG)], "chunk_id string, text string")
    rows = [(1, "c1", "café opens"), (2, "c1", "café opens"), (3, "c1", "cafe opens"), (4, "c2", "x"), (5, None, "x"), (6, "c1", None), (7, "c1", "​"), (8, "c9", "café"), (9, "c3", "ｗｉｄｅ text"), (9, "c3", "ｗｉｄｅ text")]
    evidence = spark.createDataFrame(rows, "evidence_key long, chunk_id string, quote string")
    assert {r[0] for r in visual.respelt_quotes(evidence, chunks).collect()} == {2, 9}
    other = chunks.union(spark.createDataFrame([("c1", "it says café opens")], chunks.schema))
    assert {r[0] for r in visual.respelt_quotes(evidence, other).collect()} == {9}
    assert visual.respelt_quotes(evidence.where("false"), chunks).count() == 0


# --- problem 4


def test_cut_sections(spark):
    whole = ["The bid is open.\n- pumps, AB-12, qty 4\n- valves, CD-34, qty 15\nThe end is here.", "1 | pumps | AB-1 | 3 | £12,345\n2 | valves | AB-2 | 4 | £12,346\nThat is all.", "Home | News\nPosted: June 9, 2024\nSkip to content\nWelcome home."]
    cut = ["The bid is open. The owner may rej", "The bid is open.\n- pumps, AB-1", "1 | pumps | AB-1 | 3 | £12,345\n2 | valv", "The owner may…", "The owner (see § 9", "It is sent to �"]
    fine = ["All is well.", "The list:\n- pumps, AB-12, qty 44", "Home | News", "Posted: July 1, 2023", None, "", "  \n ", "1 | pumps | AB-1 | 3 | £98,765"]
    rows = [(k, "f" if k % 2 else None, t, "x") for k, t in enumerate([*whole * 4, *cut, *fine, cut[0]])]
    df = spark.createDataFrame(rows, "section_key long, feed string, text string, reason string")
    found = {r.section_key for r in truncation.cut_sections(df).collect()}
    first = len(whole) * 4
    assert found == {*range(first, first + len(cut)), len(rows) - 1}
    rates = {r.feed: r for r in truncation.cut_rates(df).collect()}
    assert sum(r.cut_sections for r in rates.values()) == len(found) and sum(r.sections for r in rates.values()) == len(rows)
    assert truncation.cut_sections(df.where("false")).count() == 0


def test_sources_without_terminators(spark):
    rows = [(k, "bare", f"Offer {k} is kept and the depot stays open") for k in range(6)] + [(9, "bare", "It is kept…")]
    rows += [(10 + k, "usual", f"Offer {k} is kept and the depot stays open.") for k in range(6)] + [(20, "usual", "Offer 7 is kept and the dep"), (21, None, "Offer 8 is kept and the dep")]
    df = spark.createDataFrame(rows, "section_key long, feed string, text string")
    assert {(r.section_key, r.reason) for r in truncation.cut_sections(df).collect()} == {(9, "sign"), (20, "sentence"), (21, "sentence")}


def test_source_that_cuts_most_of_its_texts(spark):
    inner, end = "The vendor shall deliver all pumps to the depot of the city.", "The owner may reject an offer that is lat"
    for n in (4, 5, 40):
        rows = [(k, "cuts", f"{inner}\n{end if k else inner}") for k in range(n)] + [(100 + k, "lone", end) for k in range(n)]
        rows += [(200 + k, "strips", f"{inner[:-1]}\n{inner[:-1]}\nOffer {k} was opened by them at the town hall") for k in range(n)]
        df = spark.createDataFrame(rows, "section_key long, feed string, text string")
        found = {r.section_key for r in truncation.cut_sections(df).collect()}
        assert found == {*range(1, n), *range(100, 100 + n)}
        assert {r.feed: r.cut_sections for r in truncation.cut_rates(df).collect()} == {"cuts": n - 1, "lone": n, "strips": 0}


def test_automaton_reads_the_whole_text(spark):
    open_texts = ["<b>text ends here.", "The owner (see\nthe annex\nof the contract.", 'The "supplier shall.', "<table><tr><td>a</td></tr>\n\nEnd.", "A “quoted\nword.", "„Der Bieter ist."]
    closed = ["<b>text</b> ends.", "The owner (see\nthe annex) holds.", 'The "supplier" shall.', "(an old note\n\nA new block.", "A 5\" pipe.", "<br>One.", "«Un mot» suit.", "a < b and c.", "<john@x.example> wrote.", "„Der“ Bieter.", "1) one."]
    for text in open_texts:
        assert truncation.unclosed(text), text
    for text in closed:
        assert not truncation.unclosed(text), text
    df = spark.createDataFrame([(k, "f", t) for k, t in enumerate([*open_texts, *closed])], "section_key long, feed string, text string")
    assert {(r.section_key, r.reason) for r in truncation.cut_sections(df).collect()} == {(k, "open") for k in range(len(open_texts))}


def test_terminators_by_source(spark):
    """A family that ends bare in one source and never in another: the second cuts it; a source with few lines follows all."""
    line, kept = "Questions go to the desk of the", "The vendor shall keep the depot open on all days of the week."
    ends = "depot town office mayor clerk board school port market station".split()
    rows = [(k, "bare", f"{line} {w}\n{kept}\nEnd.") for k, w in enumerate(ends)] + [(100 + k, "ends", f"{line} {w}.\nEnd.") for k, w in enumerate(ends)]
    rows += [(200, "bare", f"{line} dep"), (201, "ends", f"{line} dep"), (202, "few", f"{kept}\n{line} dep")]
    rows += [(203, "bare", f"{line} depot"), (204, "few", f"{kept}\n{line} depot")]
    df = spark.createDataFrame(rows, "section_key long, feed string, text string")
    assert {r.section_key: r.reason for r in truncation.cut_sections(df).collect()} == {200: "word", 201: "sentence", 202: "word"}


def test_counts_by_reason(spark):
    rows = [(1, "a", "It is kept…"), (2, "a", "see (the"), (3, None, "see (the"), (4, "b", "Fine."), (5, "a", None)]
    df = spark.createDataFrame(rows, "section_key long, feed string, text string")
    assert sorted(map(tuple, truncation.cut_reasons(df).collect()), key=repr) == sorted([("a", "sign", 1), ("a", "open", 1), (None, "open", 1)], key=repr)


def test_unclosed():
    assert truncation.unclosed("as set out (see") and truncation.unclosed("marked “so") and truncation.unclosed("<b bold")
    assert not truncation.unclosed("1) one 2) two") and not truncation.unclosed("(a [b] c) “d”") and not truncation.unclosed("> Home")


# --- problem 5


def cost(bits, edges, labels):
    own = sum(max(0.0, b) if not x else max(0.0, -b) for b, x in zip(bits, labels, strict=True))
    return own + sum(c for i, j, c in edges if labels[i] != labels[j])


def test_minimum_cut_against_all_labellings():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 8)
        bits = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.3, 1.0, 2.5])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        labels = boilerplate.min_cut(bits, edges)
        best = min(cost(bits, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(bits, edges, labels) == pytest.approx(best)


PLAIN = ["The vendor shall deliver 5 pumps to the depot.\n- pumps, AB-1, qty 4\nOffers are opened at noon.", "A bid bond of 5% is required with every offer.\nThe vendor keeps pumps in stock."] * 5
PAGE = "Home | News | Contact\nSkip to main content\nThe vendor shall deliver 7 pumps to the depot.\n- pumps, AB-9, qty 3\nPosted: June 9, 2024\nBid Number: AB-7\n\nPrivacy · Cookie Policy\n© 2024 Elm City. All rights reserved."


FURNITURE = [1, 2, 8, 9]


def test_furniture_lines(spark):
    model = boilerplate.LineModel.fit(PLAIN, [PAGE] * 5, ["Elm City"])
    assert boilerplate.furniture_lines(PAGE, model) == FURNITURE
    assert boilerplate.furniture_lines("", model) == [] and boilerplate.furniture_lines("\n \n", model) == []
    rows = [(k, f, t, "x") for k, (f, t) in enumerate([*[("pdf", t) for t in PLAIN], *[("html", PAGE)] * 5, ("html", None), ("html", ""), ("pdf", PAGE)])]
    df = spark.createDataFrame(rows, "section_key long, source_format string, text string, furniture string")
    names = spark.createDataFrame([("Elm City", None)], "agency_name string, site string")
    fitted = boilerplate.fit_line_model(df.where("section_key < 17"), names)
    out = {r.section_key: list(r.furniture) for r in boilerplate.label_lines(df, fitted).collect()}
    assert out == {**{k: FURNITURE for k in range(10, 15)}, 16: []}
    bodies = {r.section_key: r.body for r in boilerplate.main_body(df, fitted).collect()}
    assert bodies[10] == "\n".join(PAGE.split("\n")[2:6]) and bodies[16] is None
    empty = df.where("false")
    assert boilerplate.label_lines(empty, boilerplate.fit_line_model(empty)).count() == 0


def test_line_model_counts_all_sections(spark, monkeypatch):
    texts = [(k, "pdf", f"Clause {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} holds.\nEnd.") for k in range(4500)] * 2
    texts += [(k, "html", f"Link {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} here\nOwner: x\nPosted: y\nEnd") for k in range(4500)] * 3
    df = spark.createDataFrame(texts, "section_key long, source_format string, text string")
    monkeypatch.setattr(boilerplate, "TELLING", 3)
    fitted = boilerplate.fit_line_model(df)
    assert len(fitted.known) == 4500 and len(fitted.foreign) == 4502 and fitted.labels == {"owner", "posted"}
    counts = boilerplate.Counts()
    for _, kind, text in texts:
        counts.add(kind == "html", text)
    want = boilerplate.LineModel.of_counts(counts, [])
    assert (fitted.words, fitted.known, fitted.foreign, fitted.labels, fitted.spoken) == (want.words, want.known, want.foreign, want.labels, want.spoken)


def test_labels_do_not_rest_on_order(spark):
    """Lines that differ in their numbers only, names of sites with digits, and rows in any order and number of tasks."""
    pages = [f"{line}\nThe vendor shall deliver {k} pumps to the depot.\nSee www.city{k}.gov or call" for k, line in enumerate(["12) Home page", "1234) Home page"] * 30)]
    rows = [(k, "html", t) for k, t in enumerate(pages)] + [(100 + k, "pdf", t) for k, t in enumerate(PLAIN * 6)]
    names = spark.createDataFrame([("City 2", "www.city2.gov"), ("City 3", "www.city3.gov")], "agency_name string, site string")
    schema = "section_key long, source_format string, text string"
    random.Random(2).shuffle(mixed := list(rows))
    results = []
    for data, tasks in ((rows, 1), (rows[::-1], 1), (mixed, 5)):
        df = spark.createDataFrame(data, schema).coalesce(1).repartition(tasks) if tasks > 1 else spark.createDataFrame(data, schema).coalesce(1)
        model = boilerplate.fit_line_model(df, names)
        results.append((model.theta, sorted((r.section_key, list(r.furniture)) for r in boilerplate.label_lines(df, model).collect())))
        assert model.owned("at www.city2.gov today") and not model.owned("at www.city4.gov today")
    assert results[0] == results[1] == results[2]


def test_owners_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "OWNERS", 5)
    df = spark.createDataFrame([(1, "html", "x")], "section_key long, source_format string, text string")
    with pytest.raises(ValueError):
        boilerplate.fit_line_model(df, spark.createDataFrame([("Elm City", None)], "agency_name string, site string"))


# --- problem 6


def brute_leaks(docs, items, n):
    def grams(t):
        w = leakage.words(t)
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    return sorted((d, i) for d, t in docs if t for i, u in items if u and grams(t) & grams(u))


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for k in range(12)]
    docs = [(k, ", ".join(rng.choice([*vocabulary, "Other", "ÉTÉ"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "W0 w1-w2 " * 30), (103, LONG + items[3][1]), docs[7], docs[8], (9, docs[10][1])]
    items += [(50, None), (51, items[4][1]), items[5], (6, items[7][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    for n in (3, 4):
        want = brute_leaks(docs, items, n)
        got = sorted(map(tuple, leakage.found_leaks(d, e, n=n).collect()))
        blocks = sorted(map(tuple, leakage.found_leaks(d, e, n=n, block_words=0).collect()))
        assert [r[:2] for r in got] == want and blocks == got
    named = leakage.found_leaks(d, e.selectExpr("concat('i', item_id) AS item_id", "text"), n=4).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, named)) == sorted((a, f"i{b}") for a, b in brute_leaks(docs, items, 4))
    assert leakage.found_leaks(d, e.where("false")).count() == 0 and leakage.found_leaks(d.where("false"), e).count() == 0


def test_remove_leaks():
    def removed(text):
        return leakage.without_windows(text, [at for _, _, at in leakage.ItemIndex([(1, "one two three four")], 3).hits([text])], 3)

    assert removed("So: One, two THREE four! Then five.") == "So: ! Then five."
    assert removed("nothing here") == "nothing here"
    assert removed("İlk ONE Two three ẞtart") == "İlk  ẞtart"
    assert leakage.words("İlk ẞtart") == ["i̇lk", "sstart"]


def test_without_leaks(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "three four then five")], "item_id long, text string")
    rows = [(1, "So: One, two THREE four! Then five.", "x"), (2, "clean", "x"), (3, None, "x"), (4, "", "x"), (1, "one two three", "x"), (5, LONG + "two three four", "x"), (5, LONG + "two three four", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cleaned string")
    out = sorted((r.doc_id, r.cleaned, r.removed_chars) for r in leakage.without_leaks(df, items, n=3).collect())
    assert out == [(1, "", 13), (1, "So: .", 30), (5, LONG, 14), (5, LONG, 14)]
    assert sorted(map(tuple, leakage.without_leaks(df, items, n=3, block_words=0).collect())) == out
    assert leakage.without_leaks(df, items.where("false")).count() == 0
    again = spark.createDataFrame([(k, t) for k, t, _ in out], "doc_id long, text string")
    assert leakage.found_leaks(again, items, n=3).count() == 0


# --- problem 7


def test_mix_reaches_the_shares(spark):
    rng = random.Random(1)
    sources = {"a": 3000, "b": 400, "c": 60}
    counts, k = [], 0
    for s, n in sources.items():
        for _ in range(n):
            counts.append((k, s, rng.randint(1, 300)))
            k += 1
    counts += [(k, "unwanted", 5), (k + 1, "a", 0)]
    df = spark.createDataFrame(counts, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 9), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mix(df, targets)
    drawn = mixing.draw(df, plan).collect()
    again = {r.doc_id: r.copies for r in mixing.draw(df.repartition(7), plan).collect()}
    assert {r.doc_id: r.copies for r in drawn} == again and len(drawn) == len(counts) - 1
    expected = {r.source: r for r in plan.collect()}
    total = sum(r.tokens * r.copies for r in drawn)
    for s in sources:
        own = [r for r in drawn if r.source == s]
        e = expected[s].expected
        assert all(int(e) <= r.copies <= min(int(e) + 1, expected[s].max_repeats) for r in own)
        assert abs(sum(r.copies for r in own) - e * len(own)) <= 1
        assert abs(sum(r.tokens * r.copies for r in own) / total - expected[s].target_share) < 0.01
    assert mixing.draw(df.where("false"), mixing.plan_mix(df.where("false"), targets)).count() == 0


def test_systematic_places_do_not_depend_on_slices(spark, monkeypatch):
    df = spark.range(500).selectExpr("id AS doc_id", "'a' AS source", "id % 7 + 1 AS tokens")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.plan_mix(df, targets).withColumn("expected", mixing.F.lit(0.37))
    for size in (50_000, 40):
        monkeypatch.setattr(mixing, "GROUP", size)
        copies = [r.copies for r in mixing.draw(df, plan).collect()]
        assert len(copies) == 500 and abs(sum(copies) - 185) <= 1 and set(copies) == {0, 1}


def test_tokens_are_those_of_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{mixing.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = ["Hello world, it's 42!", "", "naïve – café\n\n  two", "<|endoftext|>", "Привет, мир", "\t x  "]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate([*texts, None])] + [(99, None, "x")], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(df).collect()}
    assert got == {**{k: len(reference.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}, len(texts): 0}
    shares = mixing.mix_shares(df, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")).collect()
    assert len(shares) == 1 and shares[0].reached_share == 1.0


# --- problem 8

CLEAN = [
    "The café’s crème brûlée costs €5 – “naïve” pricing, § 3.4 at 20 °C ± 2 µm.",
    "À l’été, où les élèves déjà âgés étudient; œuvre complète à 50 % du coût.",
    "Für größere Mengen gewährt der Bieter über das Büro Nachlässe, ÄNDERUNGEN möglich.",
    "¿Qué ocurre según el artículo 17.5? El órgano podrá ampliar el año económico.",
    "A LICITAÇÃO NÃO será em SÃO Paulo; a RETIFICAÇÃO já está disponível.",
    "Wykonawca dostarczy części zamienne; płatność nastąpi po odbiorze, zgodnie z punktem Łączny.",
    "Вопросы принимаются в письменном виде до 24 ноября; приёмка оборудования по счёту.",
    "├── AB-12\n│   └── CD-34\n└── EF-56",
    "a b für c midió 4825 piezas à la",
    "½ tonne, 3 × 4 m², №5, 10 Ω, ☰ Menu ▾ « Previous",
]
RUSSIAN = "Оплата производится через три дня после приёмки оборудования."
POLISH = "Oferty złożone po terminie zostaną odesłane, płatność nastąpi później."


def garble(text, codec):
    out = []
    for b in text.encode("utf-8"):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_clean_texts_stay():
    for text in CLEAN:
        assert encoding.label(text) == [], text


@pytest.mark.parametrize("codec", [c for c in encoding.READ_AS if c not in encoding._MULTI])
def test_utf8_round_trip(codec):
    for text in [*CLEAN[:6], RUSSIAN]:
        mixed = f"A clean sentence – before. {garble(text, codec)} After it, a clean “one” again."
        spans = encoding.label(mixed)
        assert spans, (codec, text)
        assert encoding.restore(mixed, spans) == f"A clean sentence – before. {text} After it, a clean “one” again."


@pytest.mark.parametrize(("written", "read", "text"), [("cp1251", "cp1252", RUSSIAN), ("koi8-r", "cp1252", RUSSIAN), ("iso8859-2", "latin-1", POLISH)])
def test_single_byte_round_trip(written, read, text):
    garbled = text.encode(written).decode(read, "replace")
    assert "�" in garbled or encoding.restore(garbled, encoding.label(garbled)) == text


def test_twice_and_lost():
    text = "the vendor’s café at § 5"
    twice = garble(garble(text, "cp1252"), "cp1252")
    assert encoding.restore(twice, encoding.label(twice)) == text
    assert encoding.label("The sum of �14,082 is held") and encoding.label(text.encode().decode("gbk", "replace"))


TURKISH = "Şartnamede belirtilen değişiklikler için yüklenici ile görüşülmüştür; işin süresi üç yıldır ve başlangıç tarihi değişmiştir."
GREEK = "Οι προσφορές υποβάλλονται εγγράφως έως τις δώδεκα Μαρτίου στο πρωτόκολλο της υπηρεσίας."


@pytest.mark.parametrize(("written", "read", "text"), [("cp1254", "cp1252", TURKISH), ("cp1253", "cp1252", GREEK), ("iso8859-7", "latin-1", GREEK)])
def test_further_alphabets(written, read, text):
    garbled = garble_single(text, written, read)
    assert encoding.restore(garbled, encoding.label(garbled)) == text
    for codec in ("cp1253", "cp1254", "cp1255", "cp1256", "cp1257"):
        assert encoding.restore(garble(text, codec), encoding.label(garble(text, codec))) == text
    assert encoding.label(text) == []


def garble_single(text, written, read):
    table = {b: c for c, b in encoding._byte_of(read).items()}
    return "".join(table[b] for b in text.encode(written))


def test_labels_are_per_character():
    text = "the (" + garble("“naïve”", "cp1252") + "), and x" + garble("–", "cp1252") + "y"
    assert encoding.restore(text, encoding.label(text)) == "the (“naïve”), and x–y"
    spans = encoding.label(text)
    assert text[spans[0][0]] == "â" and all(text[a] >= "\x80" for a, _, _ in spans)
    # A clean word right beside a garbled one, without a blank between.
    mixed = "café/" + garble("café", "mac_roman") + "/café"
    assert encoding.restore(mixed, encoding.label(mixed)) == "café/café/café"
    assert encoding.label("a\xa0b\xa0für\xa0c") == []


def test_model_is_fitted_on_clean_texts(spark):
    clean, bad = [RUSSIAN, *CLEAN], [garble(t, c) for t in CLEAN[:6] for c in ("cp1252", "koi8-r")] + ["lost � here"]
    rows = [(k, t) for k, t in enumerate([*clean, *bad, None, ""])]
    model = encoding.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string"))
    want = Counter(c for t in clean for c in t if c >= "\x80")
    assert model.characters == dict(want)
    pairs = Counter()
    for t in clean:
        kinds = [encoding._BLANK if c < "\x80" and not c.isalnum() else encoding._kind(c)[0] for c in t]
        pairs.update(a + b for a, b in itertools.pairwise(kinds))
    assert model.pairs == dict(pairs)
    assert encoding.fit_text_model(spark.createDataFrame([], "doc_id long, text string")).of("é") == encoding.TextModel().of("é")
    many = encoding.TextModel({"é": 500_000, "о": 900_000}, {"la": 1})
    assert many.of("é") < encoding.TextModel().of("é") and many.of("Ã") > encoding.TextModel().of("Ã")
    labeller = encoding.Labeller(encoding.TextModel({c: n * 20_000 for c, n in want.items()}, {p: n * 20_000 for p, n in pairs.items()}))
    assert [labeller.spans(t) for t in clean] == [[]] * len(clean)
    assert all(encoding.restore(b, labeller.spans(b)) == t for t in CLEAN[:6] for b in [garble(t, "cp1252")])


def test_repair_encoding(spark):
    rows = [(1, CLEAN[0], "x"), (2, garble(CLEAN[1], "cp1252"), "x"), (2, garble(CLEAN[1], "cp1252"), "x"), (3, None, "x"), (4, "", "x"), (5, "cost �5", "x"), (6, LONG + garble("café", "cp437"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    out = encoding.repair_encoding(df, "doc_id").collect()
    assert sorted(r.doc_id for r in out) == [2, 2, 5, 6]
    assert {r.restored for r in out if r.doc_id == 2} == {CLEAN[1]}
    assert [r.restorable for r in out if r.doc_id == 5] == [False]
    assert encoding.repair_encoding(df.where("false"), "doc_id").count() == 0
