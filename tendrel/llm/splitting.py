"""Problem 1: cut oversized texts into pieces under a limit, at natural boundaries, with an overlap.

The places where a text may be cut form one sorted array per kind of boundary (page, paragraph, line, sentence, clause,
word), found in one scan. A piece ends at the last boundary under the limit, found by binary search in the arrays from
the strongest kind to the weakest; the next piece steps back by the overlap. Where a stretch has no boundary at all,
the cut is hard. Sizes are prefix sums over the characters: of 1 each, where the sum is the offset itself, or of any
sizes that a function gives per character, as the tokens that begin there (`token_sizes`).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel.llm.arrowtext import by_batch

LIMIT, OVERLAP = 1000, 200
STRIPPED = " \t\r\n"
#: A boundary of a kind is taken if it leaves at least this share of the limit to the piece, else a weaker kind is tried.
FILLED = (0.55, 0.5, 0.45, 0.4, 0.25, 0.0)
_BREAK = re.compile(r"\f|\n[ \t\r]*\n+|\n|(?<=[.!?…。])[”’\"')\]]*[ \t]+|(?<=[,;:])[ \t]+|[ \t]+")
_PAGE, _PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _WORD = range(6)


def boundaries(text: str) -> list[list[int]]:
    """Sorted places to cut at, by kind; a place is behind the white space that marks it."""
    found: list[list[int]] = [[], [], [], [], [], []]
    for m in _BREAK.finditer(text):
        mark = m.group()
        if mark[0] == "\f":
            kind = _PAGE
        elif mark[0] == "\n":
            kind = _PARAGRAPH if mark.count("\n") > 1 else _LINE
        else:
            before = text[m.start() - 1] if m.start() else ""
            kind = _SENTENCE if before in ".!?…。" or mark[0] in "”’\"')]" else _CLAUSE if before in ",;:" else _WORD
        found[kind].append(m.end())
    return found


def token_sizes(encode: Callable[[str], list[int]], decode: Callable[[list[int]], list[bytes]]) -> Callable[[str], list[int]]:
    """Sizes in tokens of a tokenizer (its encoder, and the bytes of its tokens): a token counts where it begins."""

    def sizes(text: str) -> list[int]:
        out, starts = [0] * len(text), {}
        at = 0
        for k, c in enumerate(text):
            starts[at] = k
            at += len(c.encode("utf-8", "surrogatepass"))
        at = last = 0
        for token in decode(encode(text)):
            last = starts.get(at, last)  # a token that begins within a character counts with it
            out[last] += 1
            at += len(token)
        return out

    return sizes


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, sizes: Sequence[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut) of the pieces of a text; the kind of the last piece is `end`.

    A text within the limit is one piece. A piece is never larger than the limit, and each piece after the first starts
    `overlap` before its predecessor's end. sizes: one number per character, not negative, 1 each if left out; then the
    overlap is as much as fits, and only a single character that is larger than the limit by itself makes a larger piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit must hold")
    n = len(text)
    upto = range(n + 1) if sizes is None else [0, *accumulate(sizes)]
    if len(upto) != n + 1:
        raise ValueError("there must be one size per character")
    if upto[n] <= limit:
        return [(0, n, "end")] if n else []
    kinds = boundaries(text)
    names = ("page", "paragraph", "line", "sentence", "clause", "word")
    out: list[tuple[int, int, str]] = []
    start = 0
    while upto[n] - upto[start] > limit:
        last = max(bisect_right(upto, upto[start] + limit) - 1, start + 1)
        if last == n:
            break  # a single character is left
        cut, kind = last, "hard"
        for name, places, filled in zip(names, kinds, FILLED, strict=True):
            k = bisect_right(places, last) - 1
            # The piece must hold more than the overlap, or the next one would not move on.
            if k >= 0 and upto[places[k]] - upto[start] > max(overlap, int(filled * limit)):
                cut, kind = places[k], name
                break
        out.append((start, cut, kind))
        # Back by the overlap, or by less where a large character behind the cut would not fit beside it.
        start = bisect_left(upto, max(upto[cut] - overlap, upto[cut + 1] - limit), start + 1, cut)
    out.append((start, n, "end"))
    return out


def pages_of(text: str, pieces: list[tuple[int, int, str]], pages: list[int] | None) -> list[list[int] | None]:
    """The page numbers that each piece stems from: form feeds separate the pages, in the order of `pages`.

    Null pages stay null. Where the form feeds do not match the numbers, the pieces carry all numbers.
    """
    if pages is None:
        return [None] * len(pieces)
    breaks = [k for k, c in enumerate(text) if c == "\f"] if "\f" in text else []
    if len(breaks) != len(pages) - 1:
        return [list(pages)] * len(pieces)
    return [pages[bisect_left(breaks, a) : bisect_left(breaks, b - 1) + 1] for a, b, _ in pieces]


def split_texts(
    df: DataFrame,
    key: str = "chunk_key",
    text: str = "text",
    pages: str | None = "page_numbers",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    sizes: Callable[[str], Sequence[int]] | None = None,
) -> DataFrame:
    """The pieces of every text: key, piece_no (from 1), pieces (their number), piece, cut, start, page_numbers.

    Blanks at the ends of a text do not count and are left out. A null or blank text has no pieces; one within the limit
    is one piece, made without Python. Texts may be of any length, repeated rows are split each on its own, and columns
    other than the named ones are left aside whatever their names. Null page numbers stay null. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit must hold")
    numbers = df[pages].cast("array<int>") if pages else F.lit(None).cast("array<int>")
    rows = df.select(df[key].alias("_k"), F.btrim(df[text], F.lit(STRIPPED)).alias("_t"), numbers.alias("_p")).where("_t <> ''")
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("pieces", T.IntegerType()),
            T.StructField("piece", T.StringType()),
            T.StructField("cut", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
        ]
    )

    def pieces(keys: pa.Array, texts: list[str], numbers: list) -> Iterator[tuple]:
        for k, (value, own) in enumerate(zip(texts, numbers, strict=True)):
            cuts = spans(value, limit, overlap, sizes(value) if sizes else None)
            for no, ((a, b, kind), on) in enumerate(zip(cuts, pages_of(value, cuts, own), strict=True), 1):
                yield k, no, len(cuts), value[a:b], kind, a, on

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, *columns = zip(*pieces(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], schema.names
        )

    if sizes:
        return rows.mapInArrow(by_batch(run), schema)
    whole = rows.where(F.length("_t") <= limit).select(
        F.col("_k").alias(key),
        F.lit(1).alias("piece_no"),
        F.lit(1).alias("pieces"),
        F.col("_t").alias("piece"),
        F.lit("end").alias("cut"),
        F.lit(0).alias("start"),
        F.col("_p").alias("page_numbers"),
    )
    return whole.unionByName(rows.where(F.length("_t") > limit).mapInArrow(by_batch(run), schema))
