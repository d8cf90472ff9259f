"""Problem 4: find texts that were cut off, and how often each source cuts.

Every text runs through an automaton with a stack, from its first character to its last: brackets, quotes (straight and
typographic, by side) and elements of markup are pushed and popped. What is still open at the end, half a character or
escape, a sign of a cut, and a number or abbreviation that a full stop does not end, show the cut by themselves.

What the automaton leaves is a last line without a terminator. It is compared with a baseline, which rests on whole lines:
a text that is cut off ends in its last line, so all lines but the last of a section are whole.

* A line that stands elsewhere as a whole line is complete.
* Missing terminator: a family of lines (how they begin) that in this source never ends without a terminator is running
  text, which was then cut. Where the source has fewer than OWN lines of the family, all sources count.
* A label line (`Posted: June 9, 2024`) needs no terminator if lines with its label never have one.
* Only then the usual ends count: the last word of a family that ends in varying words must be a known one; list entries
  and table rows must have as many fields, and a last field of such a form, as whole ones do.

Each source (feed) also has a baseline of its own for terminators as such: where most of a source's inner lines of running
text lack one, as in feeds that strip it, a missing one says nothing there and is no reason. A source without such lines
has no baseline: there a line is complete that stands elsewhere with a terminator, word for word but for its fillings.

The texts are read once: a task puts out its suspects and partial counts of its whole lines, which are written and joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from tendrel.llm.arrowtext import by_batch
from tendrel.session import cut

#: An ending is usual for its kind if at least this many whole lines have it.
USUAL = 2
#: A family with at least FAMILY whole lines and at most FEW different last words ends in one of those words only.
FAMILY, FEW = 8, 3
#: Lines that a label must have, none of them with a terminator, to be a label of values and not the begin of a sentence.
LABELLED = 3
#: A source with at least so many whole lines of a family has a baseline of its own for it.
OWN = 8
#: Characters of a line in which its first words are looked for.
BEGIN = 120
#: Different lines, ends and words that a task counts before it passes its counts on.
COUNTED = 200_000
#: A source does without terminators if more than this share of its inner lines of running text lack one; running text
#: has lines of at least RUNNING characters.
WITHOUT, RUNNING = 0.5, 40

BLANKS = " \t\r\n\f\u00a0\u200b"

# Signs that stand behind a text that was cut off.
_SIGN = re.compile(
    r"(?:\[(?:…|\.{3})\]|…|\.\.+|>>|\((?:more|continued|cont\.?)\)|\[(?:more|truncated|cut)\]"
    r"|\bsee more(?: description)?|\bread more)\s*$",
    re.I,
)
# Abbreviations and number words after which a full stop does not end a sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:Rev|No|Nos|Nr|Art|Abs|approx|e\.g|i\.e|z\.B|vs|cf|Sec|Fig|núm|nº|ст|п)\.$")
# Words before a number of the form 9.9.
_SECTION = re.compile(
    r"(?:§|\b(?:section|clause|artículo|cláusula|sección|seção|article|Artikel|punktem|punkcie|пунктом|пункту|пункта)) \d+\.$",
    re.I,
)
_BROKEN = re.compile(r"(?:&(?:[a-z]{1,8}|#x?[0-9a-f]*)|\\u[0-9a-f]{0,3}|\\x[0-9a-f]?|\\|(?:%[0-9a-f]{2})+%[0-9a-f]?|�)$", re.I)
# Elements of HTML that have an end.
_ELEMENTS = frozenset(
    "a abbr address article aside b blockquote body button caption center cite code dd div dl dt em fieldset figure font footer "
    "form h1 h2 h3 h4 h5 h6 head header html i label li main nav ol option p pre q s section select small span strong sub sup "
    "table tbody td tfoot th thead title tr tt u ul".split()
)
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "‹": "›"}
_CLOSE = {c: tuple(o for o, ends in _OPEN.items() if c in ends) for c in ")]}”“»›"}
_MARK = re.compile(r"""[()\[\]{}“”„«»‹›"]|<(/?)([A-Za-z][A-Za-z0-9]*)(?=[\s/>]|$)([^<>]*)(>?)|\n[ \t\r]*\n""")
_UPPER = "".join(c for c in map(chr, range(0x2000)) if unicodedata.category(c) == "Lu")
_ENTRY, _ROW = re.compile(r"(?:[-*•–]|\(?\d{1,3}[.)])\s"), re.compile(r"\d+\s*\|")
# Marks between the links and cells of page furniture.
_MARKED = re.compile(r"[|·>•]|\s{3}")
_LABEL = re.compile(rf"([{_UPPER}](?:[^\W\d_]|[’' -]){{1,28}}): \S")
_ENDED = re.compile(r"[.!?。！？]['\"”’»)\]]*$")
_NAMES = re.compile(rf"(?:^| )[{_UPPER}](?:[^\W\d_]|[’-])*(?: [{_UPPER}](?:[^\W\d_]|[’-])*)*")
_DIGITS, _DIGIT, _MONEY, _LETTERS = re.compile(r"\d+"), re.compile(r"\d"), re.compile(r"[£€$]"), re.compile(r"[^\W\d_]+")
_WRAPPED = re.compile(r"\n(?=\s*(\w))")


def unclosed(text: str) -> bool:
    """Whether a bracket, quote or element is still open at the end of a text.

    Closers without an opener, as in `1)`, do not count. A blank line ends a block, and with it what its brackets and
    quotes left open. A straight quote opens in front of a word and closes behind one; behind a digit it is an inch mark.
    """
    stack: list[str] = []
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark[0] == "\n":
            stack = [x for x in stack if x[0] == "<"]
        elif mark[0] == "<":
            name = m.group(2).lower()
            if name not in _ELEMENTS:
                continue
            if m.group(1):
                if "<" + name in stack:
                    while stack.pop() != "<" + name:
                        pass
            elif not m.group(3).endswith("/"):
                stack.append("<" + name)
        elif mark == '"':
            before, behind = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not before or before.isspace() or before in "([{–—-/":
                if not behind.isspace():
                    stack.append(mark)
            elif mark in stack:
                while stack.pop() != mark:
                    pass
        elif opened := next((x for x in reversed(stack) if x in _CLOSE.get(mark, ())), None):
            while stack.pop() != opened:
                pass
        elif mark in _OPEN:
            # Guillemets open only before a word: else they are arrows.
            behind = text[m.end() : m.end() + 1]
            if mark not in "«‹" or behind.isalpha() or behind in ("\xa0", "\u202f"):
                stack.append(mark)
    return bool(stack)


def verdict(text: str, line: str) -> tuple[str, bool | None]:
    """(reason, whether it was cut off) of a text with this last line; None where the baseline has to decide."""
    tail = line[-40:]
    if _SIGN.search(tail):
        return "sign", None
    if _BROKEN.search(tail):
        return "broken", True
    if unclosed(text):
        return "open", None
    if _ROW.match(line):
        return "row", None
    if _ENTRY.match(line) and not _ENDED.search(tail):
        return "entry", None
    if _ABBREVIATION.search(tail) or _SECTION.search(tail):
        return "number", True
    if _ENDED.search(tail):
        return "end", False
    return "bare", None


def shape(line: str) -> str:
    """The line with numbers and runs of capitalised words masked: equal for fillings of one phrase."""
    return _NAMES.sub(_masked, _DIGITS.sub("9", line))


def _masked(m: re.Match) -> str:
    """X for a run of capitalised words; a single one at the begin of a line stays, as lines begin so."""
    run = m.group()
    return run if m.start() == 0 and run[0] != " " and " " not in run else " X" if run[0] == " " else "X"


def kind_of(line: str) -> str:
    if _ROW.match(line):
        return "row"
    if _ENTRY.match(line) and line.count("•") < 2:
        return "entry"
    return "label" if _LABEL.match(line) else "bare"


def ending(line: str, kind: str) -> str:
    """The number of fields and the form of the last, of a list entry or a row; the last word of any other line."""
    if kind in ("bare", "label"):
        return _MONEY.sub("¤", _DIGIT.sub("9", line.split()[-1]))
    fields = re.split(r"\s*\|\s*", line) if kind == "row" else re.split(r",\s+", line)
    last = _MONEY.sub("¤", _DIGIT.sub("9", fields[-1]))
    # Letters of a last field matter only as a word that leads a number; free text is one form.
    return f"{len(fields)}:{last if '9' in last else 'text'}"


def family(line: str, kind: str) -> str:
    """The kind, and for lines that are neither entry nor row how they begin: up to three words, masked."""
    if kind == "bare":
        return "bare:" + " ".join(shape(line[:BEGIN]).split(" ", 3)[:3])
    return "label:" + _LABEL.match(line).group(1) if kind == "label" else kind


def _last_word(line: str) -> str:
    """The last word of a line if it begins with a small letter; else nothing."""
    runs = _LETTERS.findall(line[-60:])
    return runs[-1] if runs and runs[-1][0].islower() and len(runs[-1]) < 60 else ""


class _Read:
    """Counts of the whole lines of a task: (what, feed, family, item) with n; see `_read`."""

    def __init__(self) -> None:
        self.n: Counter[tuple[str, str | None, str | None, str | None]] = Counter()

    def add(self, feed: str | None, text: str) -> None:
        """All lines: label lines anywhere, and of the inner ones the families, the ends and phrases of bare ones."""
        lines = [x.strip(" ") for x in text.split("\n")]
        n = self.n
        for k, line in enumerate(lines):
            if not line:
                continue
            ended, kind = bool(_ENDED.search(line[-12:])), kind_of(line)
            own = family(line, kind)
            if kind == "label":
                n["label", None, own, "ended" if ended else "bare"] += 1
            if k == len(lines) - 1:
                continue
            if kind in ("bare", "label"):
                n["family", feed, own, "ended" if ended else "bare"] += 1
            if ended:
                continue
            n["end", None, own, ending(line, kind)] += 1
            phrase = line.split(",", 1)[0] if kind == "entry" else line.split("|")[1] if kind == "row" else shape(line)
            if kind in ("bare", "label"):
                n["shape", None, None, phrase] += 1
            for word in _LETTERS.findall(phrase):
                n["word", None, None, word] += 1
        # A line whose next one begins with a small letter is wrapped there and goes on.
        joined = _WRAPPED.sub(lambda m: " " if m.group(1).islower() else "\n", text) if "\n" in text else text
        for x in joined.split("\n")[:-1]:
            line = x.strip(" ")
            if len(line) >= RUNNING and kind_of(line) == "bare" and not _MARKED.search(line):
                n["running", feed, None, "ended" if _ENDED.search(line[-12:]) else "bare"] += 1


def _read(rows: DataFrame) -> DataFrame:
    """One pass over _key, feed, _text: suspects (what = 'last') with reason and forms, and counts of whole lines.

    Counts: label lines, lines of a family in a feed, and lines of running text in a feed, each ended or bare; the ends of
    bare lines by family, their shapes and their words. Rows are partial counts of a task.
    """
    schema = T.StructType([T.StructField("what", T.StringType()), rows.schema["_key"], *(T.StructField(c, T.StringType()) for c in _TEXTS)])
    schema = schema.add("cut", T.BooleanType()).add("n", T.LongType())

    def counted(read: _Read, key: pa.DataType) -> pa.RecordBatch:
        what, feed, own, item = zip(*read.n, strict=True)
        size = len(what)
        text = {"feed": feed, "family": own, "ending": item}
        columns = [pa.array(text.get(c, [None] * size), pa.string()) for c in _TEXTS]
        numbers = [pa.nulls(size, pa.bool_()), pa.array(read.n.values(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.nulls(size, key), *columns, *numbers], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, key = _Read(), pa.null()
        for batch in batches:
            at, found, key = [], [], batch.column(0).type
            for k, (feed, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                read.add(feed, text)
                line = text[text.rfind("\n") + 1 :].strip(" ")
                reason, cut_off = verdict(text, line)
                if cut_off is not False and line:
                    kind = kind_of(line)
                    at.append(k)
                    found.append((feed, family(line, kind), ending(line, kind), reason, kind, shape(line), _last_word(line), cut_off))
            if at:
                *texts, cuts = zip(*found, strict=True)
                columns = [pa.array(["last"] * len(at), pa.string()), batch.column(0).take(pa.array(at)), *(pa.array(c, pa.string()) for c in texts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.bool_()), pa.nulls(len(at), pa.int64())], schema.names)
            if len(read.n) >= COUNTED:
                yield counted(read, key)
                read = _Read()
        if read.n:
            yield counted(read, key)

    return rows.select("_key", "feed", "_text").mapInArrow(run, schema)


#: Text columns of what a pass over the texts puts out.
_TEXTS = ("feed", "family", "ending", "reason", "kind", "shape", "word")


def cut_sections(sections: DataFrame, key: str = "section_key") -> DataFrame:
    """key, feed and reason of the sections whose text breaks off before its end.

    Reasons: sign (a mark of the cut follows), broken (half a character or escape), open (bracket, quote or element), number
    (the text ends within a number or abbreviation), sentence (no terminator where such lines have one), word (within a
    word), entry and row. Null and blank texts are not cut; a text of one line is its own last line. Copies of a section
    come out each. Whole texts are read, once. The order of rows does not matter, other columns are left aside.
    """
    text = F.rtrim("text", F.lit(BLANKS))
    rows = sections.select(F.col(key).alias("_key"), "feed", text.alias("_text")).where("_text <> ''")
    read = cut(_read(rows))
    suspects = read.where("what = 'last'").select("_key", "feed", "reason", "cut", "kind", "shape", "family", "ending", "word")

    def counts(what: str, *by: str) -> GroupedData:
        return read.where(F.col("what") == what).groupBy(*by)

    bare, ended = (F.sum(F.when(F.col("ending") == x, F.col("n")).otherwise(0)) for x in ("bare", "ended"))
    labels = counts("label", "family").agg((bare + ended).alias("labelled"), ended.alias("label_ended"))
    shapes = counts("shape", F.col("ending").alias("shape")).agg(F.lit(True).alias("whole"))
    endings = counts("end", "family", "ending").agg(F.sum("n").alias("usual"))
    families = endings.where("family NOT IN ('entry', 'row')").groupBy("family").agg(F.sum("usual").alias("lines"), F.count("*").alias("endings"))
    own = counts("family", "feed", "family").agg(bare.alias("own_bare"), (bare + ended).alias("own"))
    words = counts("word", F.col("ending").alias("word")).agg(F.lit(True).alias("known"))
    feeds = counts("running", "feed").agg(F.try_divide(bare, bare + ended).alias("bare"))
    # Entries and rows, and lines without a last word, have nothing to look up: their keys are spread, not left null.
    spread = F.concat(F.lit("\0"), F.xxhash64("_key").cast("string"))
    listed = F.col("kind").isin("entry", "row")
    asked = suspects.withColumns(
        {
            "_shape": F.when(listed, spread).otherwise(F.col("shape")),
            "_family": F.when(listed, spread).otherwise(F.col("family")),
            "_word": F.when(F.col("word") == "", spread).otherwise(F.col("word")),
            "_feed": F.coalesce("feed", F.lit("\0")),
        }
    )
    compared = (
        asked.join(shapes.withColumnRenamed("shape", "_shape"), "_shape", "left")
        .join(families.withColumnRenamed("family", "_family"), "_family", "left")
        .join(labels.withColumnRenamed("family", "_family"), "_family", "left")
        .join(own.select(F.coalesce("feed", F.lit("\0")).alias("_feed"), F.col("family").alias("_family"), "own", "own_bare"), ["_feed", "_family"], "left")
        .join(endings, ["family", "ending"], "left")
        .join(words.withColumnRenamed("word", "_word"), "_word", "left")
    )
    # Whether lines of the family, in this source or, where it has few, in all, go without a terminator.
    goes_without = F.when(F.col("own") >= OWN, F.col("own_bare") > 0).otherwise(F.col("lines").isNotNull())
    is_label = F.when(F.col("kind") == "label", (F.col("labelled") >= LABELLED) & (F.col("label_ended") == 0))
    strict = (F.col("lines") >= FAMILY) & (F.col("endings") <= FEW)
    reason = (
        F.when(F.col("cut"), F.col("reason"))
        .when(F.col("whole"), None)
        .when(F.col("reason").isin("sign", "open"), F.col("reason"))
        .when(listed, F.when(F.coalesce("usual", F.lit(0)) < USUAL, F.col("kind")))
        .when(F.col("usual").isNotNull(), None)
        .when(~F.coalesce(is_label, goes_without), "sentence")
        .when(strict, "sentence")
        .when((F.col("word") != "") & F.col("known").isNull(), "word")
    )
    found = cut(compared.select("_key", "feed", "shape", reason.alias("reason")).where("reason IS NOT NULL"))
    # Each source's own baseline, a row per feed; it never rests on the last lines, which are the suspects.
    same = F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("reason") == "sentence")
    sources = rows.select("feed").distinct().join(feeds.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left")
    sources = cut(sources.select(F.col("feed").alias("_feed"), "bare"))
    told = found.join(sources.where(F.col("bare") > WITHOUT), same, "left_anti")
    unknown = sources.where("bare IS NULL")
    if not found.join(unknown, same, "left_semi").isEmpty():
        every = rows.select(F.explode(F.split("_text", "\n")).alias("line")).select(F.trim("line").alias("line"))
        ended = every.where(F.right("line", F.lit(1)).isin(*".!?。！？'\"”’»)]")).mapInArrow(by_batch(_ended_shapes), "_shape string").distinct()
        checked = told.join(unknown, same, "left_semi").join(ended, F.col("shape") == F.col("_shape"), "left_anti")
        told = told.join(unknown, same, "left_anti").unionByName(checked)
    return told.select(F.col("_key").alias(key), "feed", "reason")


def _ended_shapes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Shapes of lines with a terminator, without it."""
    lines = [(line, m) for line in batch.column(0).to_pylist() if (m := _ENDED.search(line))]
    return pa.RecordBatch.from_arrays([pa.array([shape(line[: m.start()]) for line, m in lines], pa.string())], ["_shape"])


def cut_rates(sections: DataFrame, key: str = "section_key") -> DataFrame:
    """feed, sections, cut_sections and cut_share of every feed; sections counts all rows of the feed, null texts too.

    Rows with a null feed are counted under a null feed.
    """
    every = sections.groupBy("feed").agg(F.count("*").alias("sections"))
    cut = cut_sections(sections, key).groupBy("feed").agg(F.count("*").alias("cut_sections"))
    joined = every.join(cut.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left").drop("_feed")
    number = F.coalesce("cut_sections", F.lit(0))
    return joined.select("feed", "sections", number.alias("cut_sections"), (number / F.col("sections")).alias("cut_share"))


def cut_reasons(sections: DataFrame, key: str = "section_key") -> DataFrame:
    """feed, reason and cut_sections: how many sections of every feed are cut, by what shows it; a null feed is one."""
    return cut_sections(sections, key).groupBy("feed", "reason").agg(F.count("*").alias("cut_sections"))
