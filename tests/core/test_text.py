"""Text functions on odd values."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tendrel.functions import text as X


def apply(spark, make, *rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    return [r.x for r in df.select("k", make(F.col("t")).alias("x")).orderBy("k").collect()]


def test_tokens(spark):
    assert apply(spark, X.tokens, "It's 9.5 ÉTÉ_1!", "", "…", None) == [["it", "s", "9", "5", "été_1"], [], [], None]


def test_placeholders(spark):
    stands_in = ["", "  ", "—", "N/A", " tbd ", "sign ____ here", "(none yet)", "[x\ny]", "Not Stated"]
    real = ["n/a for now", "(a) b", "0", "é"]
    assert apply(spark, X.placeholder, *stands_in) == [True] * len(stands_in)
    assert apply(spark, X.placeholder, *real, None) == [*[False] * len(real), None]


def test_forms_of_values(spark):
    assert apply(spark, X.identifier, "rfp-12 / é_3", "", None) == ["RFP12É3", "", None]
    assert apply(spark, X.collapsed, " a  b\n", "", None) == ["a b", "", None]
    assert apply(spark, X.standard_punctuation, "‘a’ “b” – c", None) == ["'a' \"b\" - c", None]
    assert apply(spark, lambda t: X.distinct_items(F.split(t, ";")), "A b; a  B;c;C ;", None) == [["A b", "c", ""], None]


def test_every_shape_of_punctuation(spark):
    shapes = {0x2018: "'", 0x2019: "'", 0x201B: "'", 0x2032: "'", 0x201C: '"', 0x201D: '"', 0x201F: '"', 0x2033: '"', **dict.fromkeys([*range(0x2010, 0x2016), 0x2212], "-")}
    others = [0x201A, 0x201E, 0x2039, 0xAB, 0x2D, 0x60, 0xB4, 0x2043, 0x2016]
    assert apply(spark, X.standard_punctuation, *map(chr, shapes), *map(chr, others)) == [*shapes.values(), *map(chr, others)]


def test_case_folds_as_in_unicode(spark):
    rows = ["Straße ΣΑΣ ς", "ŉ ﬁx ﬃ", "µ İ K ſ", "Ünï", "", None, "ᾳ ǰ"]
    assert apply(spark, X.casefold, *rows) == [None if r is None else r.casefold() for r in rows]
    assert apply(spark, X.comparable, "Große-Str. 5", "GROSSE STR 5") == ["grosse str 5"] * 2


def test_all_white_space_is_a_gap(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert len(spaces) > 25 and apply(spark, X.collapsed, *[f"a{c}{c}b" for c in spaces]) == ["a b"] * len(spaces)


def slow_match(quote, text):
    """The match by positions of the characters that stand in a form of the text."""
    plain = str.maketrans({s: p for p, group in X.SHAPES.items() for s in group})
    if not quote or not text:
        return None
    if (at := text.find(quote)) >= 0:
        return "L1", at, at + len(quote), quote

    def gaps(s):
        keep = [i for i, c in enumerate(s) if not (c.isspace() and i and s[i - 1].isspace())]
        return "".join(" " if s[i].isspace() else s[i] for i in keep).translate(plain), keep

    def tight(s):
        keep = [i for i, c in enumerate(s) if not c.isspace()]
        return "".join(s[i] for i in keep).translate(plain).lower(), keep

    for level, form, low in (("L2", gaps, False), ("L3", gaps, True), ("L4", tight, False)):
        (t, keep), (q, _) = form(text), form(quote)
        at = t.lower().find(q.lower()) if low else t.find(q)
        if q and at >= 0:
            a, b = keep[at], keep[at + len(q) - 1] + 1
            return level, a, b, text[a:b]
    return None


def test_places_of_matches(spark):
    rng = random.Random(6)
    rows = [("", "x"), ("x", ""), (None, "x"), ("x", None), ("a@b.com", "mail a@b.\n com now"), ("“so”  it", "he said \"so\"\u3000\u3000it"), ("ÉTÉ", "à l’été"), (" ", "ab"), ("$5 (a) [b] x.y* \\\\ ", "cost  $5 (A)\u2009[b] X.Y* \\\\  end"), ("\u017fee K", "see k \u017fee  K"), ("a ", "ba\n\nc"), ("pump", "x " * 30_000 + "PU MP")]
    rows += [("".join(rng.choices("aB ’\n-", k=rng.randint(1, 4))), "".join(rng.choices("AaBb  '’\n\u2003–-", k=rng.randint(1, 14)))) for _ in range(400)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, q string, t string")
    level, quote, text = X.match_level(F.col("q"), F.col("t")), F.col("q"), F.col("t")
    found = df.withColumn("l", level).withColumn("m", X.matched_text(F.col("l"), quote, text)).withColumn("c", F.when(F.col("l") > "L1", X._counted_match(F.col("l"), quote, text)))
    for (q, t), r in zip(rows, found.orderBy("k").collect(), strict=True):
        want = slow_match(q, t)
        assert (r.l and (r.l, t.find(r.m), t.find(r.m) + len(r.m), r.m)) == want, (q, t)
        assert r.c is None or r.c == r.m, (q, t)


def test_dates_and_contacts(spark):
    assert apply(spark, X.dated, "9:00 CST", "within 30 days of EST", "after  award CDT", "EDT", None) == ["9:00 America/Chicago", "within 30 days of EST", "after  award CDT", "America/New_York", None]
    lines = ["Desk (a @b.example; 555 01 00)", "Ann  Lee", "(555-0100)", "Desk (x@y.example)", "Desk (call; 555)", "", None]
    parts = [("Desk", "a@b.example", "5550100"), ("Ann Lee", None, None), (None, None, "555-0100"), ("Desk", "x@y.example", None), ("Desk", None, "555"), (None, None, None), (None, None, None)]
    assert [tuple(r) for r in apply(spark, X.contact, *lines)] == parts
    df = spark.createDataFrame([(k, *p) for k, p in enumerate([*parts, (" ", "", "1")])], "k int, n string, e string, p string").orderBy("k")
    flat = [r.x for r in df.select("k", X.flat_contact(F.col("n"), F.col("e"), F.col("p")).alias("x")).collect()]
    assert flat == ["Desk (5550100; a@b.example)", "Ann Lee", "555-0100", "Desk (x@y.example)", "Desk (555)", None, None, "1"]


def test_materially_different(spark):
    pairs = [("a b", "a b"), ("a b", "a"), ("a", "b"), ("", ""), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(X.materially_different(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [False, False, True, False, True]


def test_amendments_and_forms(spark):
    cues = apply(spark, X.amendment_cue, "It is hereby changed; a new due date", "delete a\rb insert c", "delete a\nb insert c", "nothing", None)
    assert cues == ["new due date", "delete a\rb insert", None, None, None]
    assert apply(spark, X.named_forms, "The Non-Collusion Affidavit, this affidavit and an\nOwner  affidavit.", None) == [["Non-Collusion Affidavit", "Owner  affidavit"], None]


@pytest.mark.parametrize("literal", ["a.b", "$1", "(x", r"\Q", ""])
def test_highlight_takes_literals(spark, literal):
    text = f"so {literal} and {literal.upper()}" if literal else "so"
    want = text.replace(literal, f"**{literal}**") if literal else text
    (got,) = apply(spark, lambda t: X.highlighted(t, literal), text)
    assert got.startswith(want[: len("so ") + len(literal) + 4 * bool(literal)])


def test_pages_and_labels(spark):
    df = spark.createDataFrame([("Page 7", "pdf"), ("page x", "pdf"), ("Page 7", "html"), (None, "pdf")], "s string, f string")
    assert [r.x for r in df.select(X.page_number(F.col("s"), F.col("f")).alias("x")).collect()] == [7, None, None, None]
    assert apply(spark, X.printed_label, "Title\nPage 3 of 12\nx", "a\nb\nc\nd\n 3 | 9 ", "Page 3of 9\n3|9", "", None) == ["Page 3 of 12", "3 | 9", None, None, None]


def test_residue(spark):
    words = ["pump", "été", ""]
    assert apply(spark, X.residue, *words) == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 2000 for w in words]


def test_amendment_roles(spark):
    far = "x " * 200
    rows = [
        ("The date is hereby changed. Due May 1.", "Due May 1", "amendment", "is hereby changed"), (f"The date is hereby changed. {far}Due May 1.", "Due May 1", "baseline", None),
        ("Q: when?\n Answer : Due May 1", "Due May 1", "clarification", None), (f"Answer: yes {far}Due May 1", "absent", "clarification", None),
        (f"Due May 1 {far}amended to read", "Due May 1", "baseline", None), (f"Due {far}amended to read", "absent", "amendment", "amended to read"), ("The answer: Due", "Due", "baseline", None),
    ]
    df = spark.createDataFrame(rows, "t string, q string, role string, cue string").withColumn("w", X.amendment_window(F.col("t"), F.col("q")))
    for r in df.select("*", X.amendment_role(F.col("w")).alias("got"), X.amendment_cue(F.col("w")).alias("found")).collect():
        assert (r.got, r.found) == (r.role, r.cue)
