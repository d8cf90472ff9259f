"""Problem 2: one consistent form for text that looks the same but is spelt with different characters.

A batch's text is one array of code points. A lookup table gives each code point a class; only the few that need
anything are touched: dropped, replaced, or expanded at offsets from a prefix sum. Marks are then put in canonical
order and composed with their bases, pair by pair for the whole batch at once.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel.llm.arrowtext import SLICE, by_batch, codepoints, strings

# Letters of other scripts that look like a Latin letter, each row "letters: Latin letters".
LOOKALIKES = """
авеԁһіјӏоԛрѕсухԝѵүґ: abedhijloqpscyxwvyr
АВСԌЕНІЈКМОРԚЅТХУԜҮ: ABCGEHIJKMOPQSTXYWY
αιορνγυκχτ: aiopvyukxt
ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ: ABEZHIKMNOPTYX
օսհոյցզ: ouhnjgq
ՕՍՏԼ: OUSL
ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏙᏚᏞᏟᏢᏦᏴ: DRTiAJEWMHYGZbVSLCPKB
ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ: BPDTGKJCZFMNLSRVHWXYAEIOU
"""
# Pairs above that do not look alike at body-text size.
_NOT_ALIKE = "вұґакχτγκ".replace("а", "")
# Dashes, apostrophes and dots with the shape of another character.
SAME_SHAPE = {"‐": "-", "‑": "-", "ʼ": "’", "․": ".", "ⅼ": "l", "ǃ": "!", "ꓸ": "."}
# Fillers that show nothing although they are letters or marks by category.
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"

_KEEP, _DROP, _GAP, _EXPAND, _MARK = range(5)
_LIMIT = 0x110000
#: Code points that have a decomposition lie below the first number, or among the ideographs of the second range.
_LETTERS, _IDEOGRAPHS = 0x20000, range(0x2F800, 0x2FA20)
# Hangul: first syllable, first leading consonant, vowel and (less one) trailing consonant, and their numbers.
_SYLLABLE, _LEAD, _VOWEL, _TRAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
_LEADS, _VOWELS, _TRAILS = 19, 21, 28


@lru_cache(maxsize=1)
def _lookalike_map() -> dict[int, str]:
    out = {}
    for line in LOOKALIKES.strip().splitlines():
        there, here = line.split(": ")
        out |= {ord(a): b for a, b in zip(there, here, strict=True) if a not in _NOT_ALIKE}
    return out | {ord(a): b for a, b in SAME_SHAPE.items()}


def _expansion(ch: str, seen: int = 0) -> str:
    """What stands for one character: its canonical parts, width, font and ligature variants replaced."""
    parts = unicodedata.decomposition(ch)
    if 0x3131 <= ord(ch) < 0x318F:
        return ch  # letters that stand alone: taken apart, they would join into syllables
    if alike := _lookalike_map().get(ord(ch)):
        return alike
    if not parts or seen > 8:
        return ch
    kind, *rest = parts.split() if parts.startswith("<") else ("", *parts.split())
    text = "".join(chr(int(x, 16)) for x in rest)
    same_look = kind in ("<wide>", "<narrow>", "<font>", "<noBreak>", "")
    if same_look or kind == "<compat>" and not text.startswith(" ") and ch not in "ſ№℡ŉ":
        return "".join(_expansion(x, seen + 1) for x in text)
    return ch


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, offset of the expansion, its length, all expansions, combining class), by code point."""
    kind = np.zeros(_LIMIT, np.uint8)
    at, size, pool = np.zeros(_LIMIT, np.int32), np.zeros(_LIMIT, np.uint8), []
    rank = np.zeros(_LIMIT, np.uint8)
    for cp in chain(range(_LETTERS), _IDEOGRAPHS):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0xA000:
            continue  # surrogates; syllables, which the letters are joined to, and ideographs that are their own form
        ch = chr(cp)
        category = unicodedata.category(ch)
        if ch.isspace() or category in ("Zs", "Zl", "Zp"):
            kind[cp] = _GAP if ch != " " else _KEEP
        elif category in ("Cf", "Cc") or ch in FILLERS or 0xFE00 <= cp < 0xFE10:
            kind[cp] = _DROP
        else:
            rank[cp] = unicodedata.combining(ch)
            out = _expansion(ch)
            if out != ch:
                kind[cp], at[cp], size[cp] = _EXPAND, len(pool), len(out)
                pool += map(ord, out)
            elif rank[cp]:
                kind[cp] = _MARK
    kind[0xE0000:0xE0200] = _DROP
    return kind, at, size, np.array(pool or [0], np.uint32), rank


@lru_cache(maxsize=1)
def _compositions() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys base << 21 | mark and what they compose to."""
    pairs = {}
    for cp in range(_LETTERS):
        parts = unicodedata.decomposition(chr(cp))
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            base, mark = (int(x, 16) for x in parts.split())
            pairs[base << 21 | mark] = cp
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)


def _keep(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _order_marks(points: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> None:
    """Runs of marks in canonical order, in place: odd-even exchanges over all runs at once."""
    order = rank[points]
    inner = np.ones(len(points), bool)
    inner[offsets[:-1][offsets[:-1] < len(points)]] = False
    while True:
        swap = np.flatnonzero((order[1:] > 0) & (order[:-1] > order[1:]) & inner[1:])
        if not len(swap):
            return
        swap = swap[np.concatenate(([True], np.diff(swap) > 1))]
        points[swap], points[swap + 1] = points[swap + 1], points[swap].copy()
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()


def _compose(points: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases joined with their marks until nothing joins any more.

    In canonical order, a mark is kept from its base only by another mark of its own class right before it. One round
    joins, for every base, the first mark that it can take.
    """
    keys, made = _compositions()
    while len(points) > 1:
        order = rank[points]
        at = np.arange(len(points))
        base = order == 0
        base[offsets[:-1][offsets[:-1] < len(points)]] = True
        owner = np.maximum.accumulate(np.where(base, at, 0))
        marks = np.flatnonzero(~base)
        marks = marks[(owner[marks] == marks - 1) | (order[marks - 1] < order[marks])]
        if not len(marks):
            break
        key = points[owner[marks]].astype(np.int64) << 21 | points[marks].astype(np.int64)
        hit = np.searchsorted(keys, key)
        hit[hit == len(keys)] = 0
        ok = np.flatnonzero(keys[hit] == key)
        if not len(ok):
            break
        _, first = np.unique(owner[marks[ok]], return_index=True)
        ok = ok[first]
        points[owner[marks[ok]]] = made[hit[ok]]
        keep = np.ones(len(points), bool)
        keep[marks[ok]] = False
        points, offsets = _keep(points, offsets, keep)
    return points, offsets


def _join_hangul(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of Hangul joined to syllables by arithmetic: leading consonant and vowel, then the trailing consonant."""
    for first, size, second, count in ((_LEAD, _LEADS, _VOWEL, _VOWELS), (_SYLLABLE, _LEADS * _VOWELS * _TRAILS, _TRAIL + 1, _TRAILS - 1)):
        a, b = points[:-1].astype(np.int64) - first, points[1:].astype(np.int64) - second
        fits = (a >= 0) & (a < size) & (b >= 0) & (b < count)
        if first == _SYLLABLE:
            fits &= a % _TRAILS == 0  # an open syllable
        inner = np.ones(len(points), bool)
        inner[offsets[:-1][offsets[:-1] < len(points)]] = False
        at = np.flatnonzero(fits & inner[1:])
        if len(at):
            points = points.copy()
            points[at] = _SYLLABLE + (a[at] * _VOWELS + b[at]) * _TRAILS if first == _LEAD else points[at] + b[at] + 1
            keep = np.ones(len(points), bool)
            keep[at + 1] = False
            points, offsets = _keep(points, offsets, keep)
    return points, offsets


def consistent(column: pa.Array) -> pa.Array:
    """The consistent form of every row: nothing invisible, one space per gap, composed accents, one letter per shape."""
    points, offsets, valid = codepoints(column)
    kind_of, at, size, pool, rank = _tables()
    kind = kind_of[points]
    expand = kind == _EXPAND
    gap = kind == _GAP
    points = np.where(gap, np.uint32(32), points)
    length = np.ones(len(points), np.int64)
    length[kind == _DROP] = 0
    if expand.any():
        length[expand] = size[points[expand]]
    if expand.any() or (length == 0).any():
        start = np.concatenate(([0], np.cumsum(length)))
        out = np.repeat(points, length)
        for k in range(int(length.max(initial=1))):
            which = np.flatnonzero(expand & (length > k))
            out[start[which] + k] = pool[at[points[which]] + k]
        points, offsets = out, start[offsets]
    if (kind == _MARK).any() or expand.any():
        points = points.copy()
        _order_marks(points, offsets, rank)
        points, offsets = _compose(points, offsets, rank)
    if ((points >= _VOWEL) & (points < _TRAIL + _TRAILS)).any():
        points, offsets = _join_hangul(points, offsets)
    space = points == 32
    first = np.zeros(len(points), bool)
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    keep = ~(space & (first | np.concatenate(([False], space[:-1]))))
    points, offsets = _keep(points, offsets, keep)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    keep = np.ones(len(points), bool)
    keep[ends[points[ends] == 32]] = False
    return strings(*_keep(points, offsets, keep), valid)


def normalise_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the consistent form of each text column added: {column: name of its form}.

    Null stays null, an empty or invisible text becomes empty, texts may have any length, repeated rows stay repeated.
    An existing column with the name of a form is replaced; all other columns pass through. Raises ValueError for a
    column that df lacks. No shuffle: one pass in Arrow batches.
    """
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    kept = [f for f in df.schema.fields if f.name not in columns.values()]
    schema = T.StructType([*kept, *(T.StructField(name, T.StringType()) for name in columns.values())])
    names, pairs = [f.name for f in kept], list(columns.items())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms = [consistent(batch.column(batch.schema.get_field_index(c))) for c, _ in pairs]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(n)) for n in names), *forms], names + [n for _, n in pairs]
        )

    return df.mapInArrow(by_batch(run, SLICE), schema)


def respelt_quotes(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence_key of quotes that do not occur verbatim in their chunk, yet read like a passage of it.

    Rows with a null quote, chunk_id or text, and quotes that show nothing, are no cases. Where a chunk_id has several
    different texts, one verbatim occurrence in any of them rules a quote out. Repeats of a chunk are brought together
    by (chunk_id, hash of text) before the join; only pairs without a verbatim hit reach Python.
    """
    texts = (
        chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())
        .select("chunk_id", "text")
        .groupBy("chunk_id", F.xxhash64("text").alias("_h"))
        .agg(F.first("text").alias("text"))
    )
    pairs = (
        evidence.where(F.col("quote").isNotNull() & F.col("chunk_id").isNotNull())
        .select("evidence_key", "chunk_id", "quote")
        .join(texts, "chunk_id")
        .select("evidence_key", "quote", "text", F.contains("text", "quote").alias("verbatim"))
    )
    forms = normalise_text(pairs.where(~F.col("verbatim")).select("evidence_key", "quote", "text"), {"quote": "q", "text": "t"})
    same = forms.where((F.length("q") > 0) & F.contains("t", "q")).select("evidence_key", F.lit(False).alias("verbatim"))
    # A second text with a verbatim hit is possible only where a chunk_id has several texts.
    several = texts.groupBy("chunk_id").count().where("count > 1").select("chunk_id")
    ruled_out = (
        evidence.where(F.col("quote").isNotNull())
        .join(several, "chunk_id", "left_semi")
        .select("evidence_key", "chunk_id", "quote")
        .join(texts, "chunk_id")
        .where(F.contains("text", "quote"))
        .select("evidence_key")
    )
    return same.select("evidence_key").distinct().join(ruled_out, "evidence_key", "left_anti")
