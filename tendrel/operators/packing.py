"""Sequential folds over ordered rows: sections into chunks, chunks into a context of limited size.

Sections are folded document by document: sorted by Spark and streamed to Python in batches, so that a document of any
length passes through a task with constant memory. A context is folded in rounds over the few next chunks of each bid.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel import catalog as C
from tendrel.session import cut

MAX_CHARS, MAX_EXCERPTS = 100_000, 120
#: What joins sections of one chunk: their texts, their names.
TEXT_GAP, NAME_GAP = "\n\n", " & "
#: Chunks that a task gathers before it passes them on.
GATHERED = 2_000
_BREAK = re.compile(r"[ \n]")


def split_spans(text: str, limit: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, reach: int = C.BREAK_REACH) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a text, of at most `limit` characters.

    The places behind blanks and line breaks are found once; a piece ends at the last of them that binary search finds
    within `reach` of its limit, else at the limit. The next piece begins `overlap` earlier, but moves on by one at least.
    """
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    places = [m.end() for m in _BREAK.finditer(text)] if len(text) > limit else []
    start = 0
    while len(text) - start > limit:
        full = start + limit
        nearest = places[k - 1] if (k := bisect_right(places, full)) else 0
        end = nearest if nearest > max(start + 1, full - reach) else full
        yield start, end
        start = max(start + 1, end - overlap)
    if text:
        yield start, len(text)


def split_text(text: str, limit: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, reach: int = C.BREAK_REACH) -> list[str]:
    """The pieces of a text (see `split_spans`) without white space at their ends."""
    return [text[a:b].strip() for a, b in split_spans(text, limit, overlap, reach)]


@dataclass(frozen=True)
class Section:
    name: str
    page: int | None
    text: str


def pack(sections: Iterable[Section], limit: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Iterator[list[Section]]:
    """The sections of a document in chunks: neighbours whose joined length fits the limit, and pieces of longer ones.

    A fold over lengths: only the sections of the open chunk are held, and their texts are joined by the caller.
    """
    held: list[Section] = []
    size = 0
    for section in sections:
        own = len(section.text)
        if held and size + len(TEXT_GAP) + own > limit:
            yield held
            held, size = [], 0
        if own > limit:
            pieces = split_text(section.text, limit, overlap)
            yield from ([replace(section, text=piece)] for piece in pieces if piece)
        elif own:
            size += own + (len(TEXT_GAP) if held else 0)
            held.append(section)
    if held:
        yield held


def _page(name: str) -> int | None:
    """The number of a section that is named as a page."""
    m = re.fullmatch(r"\s*page\s*(\d+)\s*", name, re.I)
    return int(m.group(1)) if m else None


def _by_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with every group in one task and in order; groups follow each other in the task's rows."""
    return df.repartition(F.col(group)).sortWithinPartitions(group, *order)


def pack_sections(sections: DataFrame, limit: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_seq (from 1), chunk_id, section_identifier, page_numbers (pdf only, else null), text.

    Sections come in order of section_seq, then section_key; of several ingests of one (doc_id, section_seq) all are
    packed. Null and blank texts are skipped, a null section name counts as "unknown".
    """
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    rows = sections.where("doc_id IS NOT NULL").select(
        "doc_id", "section_seq", "section_key", "source_format", F.coalesce("section_identifier", F.lit("unknown")).alias("name"), "text"
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", T.StringType()),
            T.StructField("chunk_seq", T.IntegerType()),
            T.StructField("chunk_id", T.StringType()),
            T.StructField("section_identifier", T.StringType()),
            T.StructField("page_numbers", T.ArrayType(T.IntegerType())),
            T.StructField("text", T.StringType()),
        ]
    )

    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Section]]:
        for batch in batches:
            for doc, fmt, name, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                yield doc, Section(name, _page(name) if fmt == "pdf" else None, (text or "").strip())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, rows in groupby(read(batches), key=itemgetter(0)):
            for seq, held in enumerate(pack((section for _, section in rows), limit, overlap), 1):
                names = NAME_GAP.join(dict.fromkeys(x.name for x in held))
                text = TEXT_GAP.join(x.text for x in held)
                pages = sorted({x.page for x in held if x.page is not None})
                yield doc, seq, hashlib.md5(f"{doc}_{names}_{text}".encode()).hexdigest(), names, pages or None, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = chunks(batches)
        while part := list(islice(made, GATHERED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema.names)

    return _by_group(rows, "doc_id", ["section_seq", "section_key"]).mapInArrow(run, schema)


def pack_context(chunks: DataFrame, budget: int = MAX_CHARS, most: int = MAX_EXCERPTS, overhead: int = 0) -> DataFrame:
    """bid_id, place, doc_id, chunk_key, used: the chunks of a bid that fit, in order of document, place and key.

    A chunk costs its characters and `overhead`, what an excerpt adds around it. A chunk that would exceed the budget is
    skipped and later smaller ones may still fit; at most `most` are kept. `used` is the cost in use after the chunk.
    Chunks without text take no part.

    What is left of a budget only shrinks, so a chunk larger than that can never fit again. Each round takes, for every
    bid that is not full, the next `most` chunks that are small enough - a top-k per bid, cut in each task before the
    shuffle - and folds those few in order. A round keeps at least one chunk of each bid that is left, so there are at
    most `most` rounds; most bids are done after the first, and later rounds read only the rows of those that are not. No
    task sees more than `most` rows of a bid, however many it has.
    """
    place, size = F.struct("doc_id", "chunk_seq", "chunk_key").alias("ord"), (F.length("text").cast("long") + overhead).alias("size")
    rows = cut(chunks.where("text <> '' AND bid_id IS NOT NULL").select("bid_id", place, size))
    folded_type = T.StructType(
        [
            T.StructField("bid_id", T.StringType()),
            T.StructField("no", T.IntegerType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("used", T.LongType()),
            T.StructField("taken", T.IntegerType()),
        ]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, used, taken = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, totals, counts = [], [], []
            for own, size, before, so_far in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if own != bid:
                    bid, used, taken = own, before, so_far
                fits = used + size <= budget and taken < most
                used, taken = (used + size, taken + 1) if fits else (used, taken)
                kept.append(fits)
                totals.append(used)
                counts.append(taken)
            columns = [pa.array(kept, pa.bool_()), pa.array(totals, pa.int64()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], folded_type.names)

    nowhere = F.lit(None).cast(rows.schema["ord"].dataType)
    state = rows.select("bid_id").distinct()
    state = state.select("bid_id", F.lit(0).cast("long").alias("before"), F.lit(0).alias("so_far"), nowhere.alias("after"))
    out = None
    while True:
        behind = F.col("after").isNull() | (F.col("ord") > F.col("after"))
        small = rows.join(state, "bid_id").where((F.col("size") <= budget - F.col("before")) & behind)
        number = F.row_number().over(Window.partitionBy("bid_id").orderBy("ord"))
        next_ones = cut(small.withColumn("no", number).where(F.col("no") <= most))
        ordered = _by_group(next_ones.select("bid_id", "no", "size", "before", "so_far"), "bid_id", ["no"])
        folded = cut(ordered.mapInArrow(fold, folded_type).join(next_ones.select("bid_id", "no", "ord"), ["bid_id", "no"]))
        part = folded.where("kept").select("bid_id", F.col("taken").alias("place"), "ord.doc_id", "ord.chunk_key", "used")
        out = part if out is None else out.unionByName(part)
        state = (
            folded.groupBy("bid_id")
            .agg(F.max("used").alias("before"), F.max("taken").alias("so_far"), F.max("ord").alias("after"), F.count("*").alias("seen"))
            .where((F.col("seen") == most) & (F.col("so_far") < most) & (F.col("before") < budget))
            .drop("seen")
        )
        state = cut(state)
        if state.isEmpty():
            return out
        rows = cut(rows.join(state.select("bid_id"), "bid_id", "left_semi"))


def trimmed(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """bid_id and chunk_key of the chunks with text that `packed` left out."""
    rows = chunks.where("text <> '' AND bid_id IS NOT NULL").select("bid_id", "chunk_key")
    return rows.join(packed.select("bid_id", "chunk_key"), ["bid_id", "chunk_key"], "left_anti").select("bid_id", "chunk_key")
