"""Text functions as Column expressions: everything stays in the JVM.

Word characters are letters, digits and the underscore of Unicode; white space is all that Unicode has of it, and the four
separators of files, groups, records and units.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beside what `\s` matches in the JVM.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Words that stand for a missing value.
PLACEHOLDERS = ("n/a", "na", "none", "null", "tbd", "unknown", "not specified", "not stated", "not applicable")
#: Cues of an amendment, in the order in which they are tried.
AMENDMENT_CUES = (
    r"\bnew\s+(due\s+date|closing\s+date|date|deadline|time)\b",
    r"\bis\s+hereby\s+(changed|revised|amended|replaced)\b",
    r"\bis\s+(changed|revised|amended|extended)\s+to\b",
    r"\bshall\s+be\s+replaced\s+(by|with)\b",
    r"\bamended\s+to\s+read\b",
    r"\bthe\s+following\s+replaces\b",
    r"\bextend(s|ed|ing)?\s+the\s+(due\s+date|closing\s+date|deadline)\b",
    r"\brevised\s+(due\s+date|closing\s+date|deadline|schedule)\b",
    r"\bdelete\b.{0,80}\binsert\b",
)
#: Words before "affidavit" that do not name a form.
NOT_A_FORM = "this|the|an?|said|such|each|any|or|and|of|to|for|by|with|is|be|no|not|that|which"
#: The name of a form, and its first word, for patterns without lookahead.
NAMED_FORM = rf"(?i)\b(?!(?:{NOT_A_FORM})\b)[a-z][a-z\-]+\s+affidavit\b"
#: Shapes of apostrophes, quotation marks and dashes, and the plain character of each shape.
SHAPES = {"'": "\u2018\u2019\u201b\u2032", '"': "\u201c\u201d\u201f\u2033", "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a name in the plan, where plain reuse would copy the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """The words of a text in lower case, in order; null stays null."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")


def collapsed(text: Column) -> Column:
    """Every gap one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def standard_punctuation(text: Column) -> Column:
    """Apostrophes, quotation marks and dashes of any shape as plain ones, one for one."""
    return F.translate(text, "".join(SHAPES.values()), "".join(plain * len(shapes) for plain, shapes in SHAPES.items()))


def casefold(text: Column) -> Column:
    """The text without case, as Unicode folds it: lower case, and what folds further, as the sharp s, is looked up.

    Cherokee, which folds to its capitals, is left in lower case: two texts are equal without case either way.
    """
    low = F.lower(text)
    further = {c: c.casefold() for c in map(chr, range(0x20000)) if c == c.lower() != c.casefold() and not unicodedata.name(c, "").startswith("CHEROKEE")}
    table = F.create_map(*[F.lit(x) for pair in further.items() for x in pair])
    folded = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(low.rlike("[" + "".join(further) + "]"), folded).otherwise(low)


def identifier(value: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def comparable(value: Column) -> Column:
    """The form in which values are compared: without case, punctuation as gaps, gaps collapsed."""
    return F.trim(F.regexp_replace(casefold(value), r"[^\p{L}\p{N}_]+", " "))


#: What makes a date relative, and abbreviations that are written out as zones in all other dates.
RELATIVE = r"(?i)within\s+\d+\s+days|after\s+award"
ZONES = {"CST": "America/Chicago", "CDT": "America/Chicago", "EST": "America/New_York", "EDT": "America/New_York"}


def relative_date(value: Column) -> Column:
    """Whether a date counts from an event (`within 30 days`)."""
    return value.rlike(RELATIVE)


def dated(value: Column) -> Column:
    """A date with its zone written out; a relative one stays as it is."""
    out = value
    for short, zone in ZONES.items():
        out = F.replace(out, F.lit(short), F.lit(zone))
    return F.when(relative_date(value), value).otherwise(out)


def contact(line: Column) -> Column:
    """struct<name, email, phone> of a contact on one line, as `Desk (555-0100; desk@a.example)`; what is not there is null.

    The name stands before the bracket. In it, parts are separated by semicolons and hold no white space: the first with
    an @ is the e-mail, the first other one with a digit the phone.
    """
    inside = F.regexp_extract(line, r"\(([^)]*)\)", 1)
    parts = F.filter(F.transform(F.split(inside, ";"), lambda x: F.regexp_replace(x, _SPACE, "")), lambda x: x != "")
    mail, other = F.filter(parts, lambda x: F.contains(x, F.lit("@"))), F.filter(parts, lambda x: ~F.contains(x, F.lit("@")) & x.rlike("[0-9]"))
    name = F.nullif(collapsed(F.regexp_extract(line, r"^([^(]*)", 1)), F.lit(""))
    return F.struct(name.alias("name"), F.get(mail, F.lit(0)).alias("email"), F.get(other, F.lit(0)).alias("phone"))


def flat_contact(name: Column, email: Column, phone: Column) -> Column:
    """A contact on one line: `Name (phone; email)`, without what is null or blank; null if all is."""
    name, email, phone = (F.nullif(F.regexp_replace(x, f"^{_SPACE}|{_SPACE}$", ""), F.lit("")) for x in (name, email, phone))
    details = F.concat_ws("; ", phone, email)
    return F.when(name.isNull(), F.nullif(details, F.lit(""))).when(details == "", name).otherwise(F.concat(name, F.lit(" ("), details, F.lit(")")))


def normalised(value: Column, kind: Column) -> Column:
    """struct<value, data_type> of a value by its kind: identifier, datetime, contact, list (of items after semicolons), else string.

    value is text: the items of a list joined by semicolons, a contact on one line. Null for a null value.
    """
    name, email, phone = (contact(value)[n] for n in ("name", "email", "phone"))
    items = F.filter(distinct_items(F.split(value, ";")), lambda x: x != "")

    def made(form: Column, data_type: Column | str) -> Column:
        return F.struct(form.alias("value"), (F.lit(data_type) if isinstance(data_type, str) else data_type).alias("data_type"))

    date_type = F.when(relative_date(value), "relative_date").otherwise("datetime")
    form = (
        F.when(kind == "identifier", made(identifier(value), "identifier"))
        .when(kind == "datetime", made(dated(value), date_type))
        .when(kind == "contact", made(flat_contact(name, email, phone), "contact"))
        .when(kind == "list", made(F.array_join(items, "; "), "list"))
        .otherwise(made(collapsed(value), "string"))
    )
    return F.when(value.isNotNull(), form)


def contact_supported(name: Column, email: Column, phone: Column, excerpt: Column) -> Column:
    """Whether a contact has a part, and every part of it stands in the excerpt at some level."""
    parts = F.filter(F.array(name, email, phone), lambda x: F.coalesce(x, F.lit("")) != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: match_level(x, excerpt).isNotNull())


def list_supported(items: Column, excerpt: Column) -> Column:
    """Whether every item of a list stands in the excerpt at some level."""
    return F.forall(items, lambda x: match_level(x, excerpt).isNotNull())


def materially_different(a: Column, b: Column) -> Column:
    """Whether two comparable values differ and neither contains the other; an empty one differs from any other."""
    return F.when((a == "") | (b == ""), a != b).otherwise((a != b) & ~F.contains(a, b) & ~F.contains(b, a))


def distinct_items(items: Column) -> Column:
    """Collapsed items, the first of those equal without case, in order."""
    clean = F.transform(items, collapsed)
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def placeholder(value: Column) -> Column:
    """Whether a value only stands in for a missing one."""
    s = F.trim(value)
    return (
        (s == "")
        | ~s.rlike(r"[\p{L}\p{N}_]")
        | F.lower(s).isin(*PLACEHOLDERS)
        | F.contains(s, F.lit("___"))
        | s.rlike(r"(?s)^[(\[{].*[)\]}]$")
    )


def named_forms(text: Column) -> Column:
    """The affidavits that a text names, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(NAMED_FORM), 0)


def amendment_cue(text: Column) -> Column:
    """The first cue of an amendment, by the order of the cues; null where there is none."""
    found = [F.nullif(F.regexp_extract(text, "(?id)" + cue, 0), F.lit("")) for cue in AMENDMENT_CUES]
    return F.coalesce(*found)


#: Characters on either side of a quote in which a cue of an amendment counts.
CUE_WINDOW = 300
ANSWER = r"^\s*answer\s*:"


def amendment_window(text: Column, quote: Column) -> Column:
    """The first place of a quote in a text with what stands around it; the whole text where it is not found."""
    at = F.instr(text, quote)
    begin = F.greatest(F.lit(1), at - CUE_WINDOW)
    return F.when(at == 0, text).otherwise(F.substring(text, begin, at + F.length(quote) + CUE_WINDOW - begin))


def amendment_role(window: Column) -> Column:
    """amendment where a window holds a cue, else clarification where it holds an answer, else baseline."""
    answered = window.rlike("(?imd)" + ANSWER)
    return F.when(amendment_cue(window).isNotNull(), "amendment").when(answered, "clarification").otherwise("baseline")


def highlighted(text: Column, literal: str) -> Column:
    """The text with every occurrence of the literal between asterisks, whatever its case."""
    if not literal:
        return text
    return F.regexp_replace(text, r"(?iu)(\Q" + literal.replace(r"\E", "") + r"\E)", "**$1**")


def supported(claim: Column, excerpt: Column) -> Column:
    """Whether every word of more than four characters of a claim occurs in the excerpt, without case."""
    low = F.lower(excerpt)
    return F.forall(F.filter(tokens(claim), lambda t: F.length(t) > 4), lambda t: F.contains(low, t))


def match_level(quote: Column, text: Column) -> Column:
    """The level at which a quote is found (see `match`), without its place; null if nowhere."""
    q2, t2 = (F.regexp_replace(standard_punctuation(x), _SPACE, " ") for x in (quote, text))
    q4, t4 = (F.lower(F.regexp_replace(standard_punctuation(x), _SPACE, "")) for x in (quote, text))
    found = (
        F.when(F.contains(text, quote), "L1")
        .when(F.contains(t2, q2), "L2")
        .when(F.contains(F.lower(t2), F.lower(q2)), "L3")
        .when((q4 != "") & F.contains(t4, q4), "L4")
    )
    return F.when((quote != "") & (text != ""), found)


def matched_text(level: Column, quote: Column, text: Column) -> Column:
    """What stands in the text where a quote is found at a level; its place is the first of what stands there.

    Beyond L1 the quote becomes a pattern: any shape of its punctuation, any gap of its gaps (of the last one a single
    character), and for L4 gaps between all characters. What the pattern finds is compared with the quote once more; where
    letters fold differently in patterns, the characters that stand in the level's form of the text are counted instead.
    """
    q2, q4 = (F.regexp_replace(standard_punctuation(quote), _SPACE, gap) for gap in (" ", ""))
    blank = _SPACE.removesuffix("+")
    written = blank.replace("\\", "\\\\")

    def escaped(q: Column) -> Column:
        return F.regexp_replace(q, r"([^\p{L}\p{N} ])", r"\\$1")

    def any_shape(pattern: Column) -> Column:
        for plain, shapes in SHAPES.items():
            pattern = F.replace(pattern, F.lit("\\" + plain), F.lit(f"[\\{plain}{shapes}]"))
        return pattern

    gaps = F.regexp_replace(F.regexp_replace(any_shape(escaped(q2)), " $", written), " ", written + "+")
    tight = any_shape(F.regexp_replace(F.regexp_replace(escaped(q4), r"(\\\\.|[^\\\\])", f"$1{written}*"), r"\[[^\]]*\]\*$", ""))
    pattern = F.when(level == "L2", gaps).when(level == "L3", F.concat(F.lit("(?iu)"), gaps)).otherwise(F.concat(F.lit("(?iu)"), tight))
    hit = F.regexp_substr(text, pattern)
    again = match_form(level, hit) == match_form(level, quote)
    return F.when(level == "L1", quote).when(level.isNotNull(), F.coalesce(F.when(again, hit), _counted_match(level, quote, text)))


def match_form(level: Column, text: Column) -> Column:
    """The form of a text that a level compares."""
    gaps, tight = (F.regexp_replace(standard_punctuation(text), _SPACE, gap) for gap in (" ", ""))
    return F.when(level == "L1", text).when(level == "L2", gaps).when(level == "L3", F.lower(gaps)).otherwise(F.lower(tight))


def _counted_match(level: Column, quote: Column, text: Column) -> Column:
    """The same by counting the characters of the text that stand in its form."""
    blanks = F.transform(F.split(text, ""), lambda c: c.rlike(_SPACE))

    def places(b: Column) -> Column:
        kept = F.when(level == "L4", F.transform(b, lambda x: ~x)).otherwise(F.transform(b, lambda x, i: ~(x & F.coalesce(F.get(b, i - 1), F.lit(False)))))
        return F.filter(F.transform(kept, lambda k, i: F.when(k, i)), lambda i: i.isNotNull())

    form, size = match_form(level, text), F.length(match_form(level, quote))
    at = F.instr(form, match_form(level, quote))
    return _let(_let(blanks, places), lambda p: F.substring(text, F.get(p, at - 1) + 1, F.get(p, at + size - 2) + 1 - F.get(p, at - 1)))


def handle(chunk_id: Column, digits: int = 8) -> Column:
    """A short handle of a chunk."""
    return F.concat(F.lit("E"), F.substring(F.sha2(chunk_id, 256), 1, digits))


def page_number(section: Column, source_format: Column) -> Column:
    """The page that a section name states (`Page 7`), for pdf only."""
    low = F.lower(section)
    return F.when((source_format == "pdf") & low.startswith("page"), F.trim(F.regexp_replace(low, "page", "")).try_cast("int"))


#: Fixed value: a page label as it is printed.
PRINTED_LABEL = r"(?i)^(page\s+)?\d+\s+(of|\|)\s+\d+$"


def printed_label(text: Column) -> Column:
    """The first of the first and last three lines that is a page label, as `Page 3 of 12` or `3 | 12`; else null."""
    lines = F.split(text, "\n")
    tail = F.slice(lines, F.greatest(F.lit(4), F.size(lines) - 2), F.lit(3))
    edges = F.transform(F.concat(F.slice(lines, 1, 3), tail), lambda x: F.trim(x))
    return F.get(F.filter(edges, lambda x: x.rlike(PRINTED_LABEL)), F.lit(0))


def residue(word: Column, modulus: int = 2000) -> Column:
    """The 128-bit MD5 of a word modulo a small number, folded from its four 32-bit pieces."""
    digest, step = F.md5(word), (1 << 32) % modulus
    out = F.lit(0).cast("bigint")
    for k in range(4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        out = (out * step + piece) % modulus
    return out
