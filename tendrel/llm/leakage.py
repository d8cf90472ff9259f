"""Problem 6: find evaluation passages in a corpus, report the items that leaked, and remove them.

Words are maximal runs of letters and digits, compared without case. The items' n-grams are a set of hashes; a document
becomes an array of word numbers, in which a word that no item holds is 0 and breaks every window. Only windows without
a break are hashed, a whole Arrow batch at once, and looked up in the set; hits are verified word by word.

The set travels to the executors in blocks of whole items, each of at most BLOCK_WORDS words, so what is broadcast is
bounded whatever the number of items: a small set is one block and one pass over the corpus, a larger one takes a pass
for every block (a stated query set against all rows, in blocks). The result does not depend on the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tendrel.llm.arrowtext import SLICE, by_batch
from tendrel.session import cut

N = 12
#: The most words of items whose n-grams are sent to every executor at once (about 60 bytes a word); an item is never
#: divided, so a single longer one is a block of its own.
BLOCK_WORDS = 2_000_000
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a text, without case. Folding is by word where it changes the length, so that words stay whole."""
    folded = text.casefold()
    return _WORDS.findall(folded) if len(folded) == len(text) else [w.casefold() for w in _WORDS.findall(text)]


def spread(values: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over the whole range (the finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive numbers: a polynomial over the scattered numbers, by n shifted additions."""
    m = len(numbers) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = spread(numbers)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + x[k : k + m]
    return spread(out)


class ItemIndex:
    """The n-grams of a bounded set of items: sorted hashes and, for each, the places they stand at."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, self.ids = n, [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        self.texts = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        hashes = [window_hashes(t, n) for t in self.texts]
        owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        every = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]

    def hits(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, first word) of every window of the texts that is an n-gram of an item, verified; each once."""
        if not len(self.hashes):
            return []
        get, numbers, sizes = self.number.get, [], []
        for text in texts:
            own = [get(w, 0) for w in words(text)]
            own.append(0)  # no window spans two texts
            numbers += own
            sizes.append(len(own))
        flat = np.array(numbers, np.int64)
        known = flat > 0
        run = np.concatenate(([0], np.cumsum(known)))
        starts = np.flatnonzero(run[self.n :] - run[: -self.n] == self.n) if len(flat) >= self.n else np.zeros(0, np.int64)
        if not len(starts):
            return []
        x = spread(flat)
        hashed = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                hashed = hashed * _BASE + x[starts + k]
        hashed = spread(hashed)
        lo, hi = np.searchsorted(self.hashes, hashed, "left"), np.searchsorted(self.hashes, hashed, "right")
        first = np.concatenate(([0], np.cumsum(sizes)))
        out: dict[tuple[int, int, int], None] = {}
        for k in np.flatnonzero(hi > lo).tolist():
            at = int(starts[k])
            text = int(np.searchsorted(first, at, "right")) - 1
            for e in range(int(lo[k]), int(hi[k])):
                item, place = int(self.owner[e]), int(self.place[e])
                if np.array_equal(self.texts[item][place : place + self.n], flat[at : at + self.n]):
                    out[text, item, at - int(first[text])] = None
        return list(out)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(df[key].alias("_k"), df[text].alias("_t")).where("_t IS NOT NULL")


def item_blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[tuple[list[tuple], bool]]:
    """(block, whether it is the only one) of items (id, text); the driver holds one block and one partition at a time."""
    block: list[tuple] = []
    size, made = 0, 0
    for key, text in items.toLocalIterator():
        # Words are at least one character and a gap apart, so half the characters bounds their number.
        own = len(text) // 2 + 1
        if block and size + own > most:
            made += 1
            yield block, False
            block, size = [], 0
        block.append((key, text))
        size += own
    if block or not made:
        yield block, made == 0


def _by_blocks(rows: DataFrame, items: DataFrame, n: int, most: int, schema: T.StructType, made: Callable) -> list[DataFrame]:
    """made(index, batch) over all rows, for every block of items: a part each.

    A single block stays a lazy plan. Of several, each part is written before the next block is broadcast.
    """
    parts: list[DataFrame] = []
    for block, alone in item_blocks(items, most):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        index: list[ItemIndex] = []

        def run(batch: pa.RecordBatch, shared=shared, index=index) -> pa.RecordBatch | None:
            if not index:
                index.append(ItemIndex(shared.value, n))
            return made(index[0], batch)

        part = rows.mapInArrow(by_batch(run, SLICE), schema)
        if alone:
            return [part]
        parts.append(cut(part))
        shared.destroy()
    return parts


def found_leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    n: int = N,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """key, item_key, windows (how many windows of n words are shared), first_word (where the first starts, from 0).

    One row per document row and item row that share at least n consecutive words: repeated documents and repeated items
    come out each, whether their keys are equal or not. Null and blank texts, items and documents of fewer than n words
    have none. Other columns are left aside. The items go to every executor in blocks of at most `block_words` words, of
    one item at least; the corpus is read once for every block and nothing is shuffled.
    """
    rows, of = _texts(documents, key, text), _texts(items, item_key, text)
    kind = of.schema["_k"].dataType
    schema = T.StructType([T.StructField(key, rows.schema["_k"].dataType), T.StructField(item_key, kind)])
    schema = schema.add("windows", T.IntegerType()).add("first_word", T.IntegerType())

    def made(index: ItemIndex, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, at in index.hits(batch.column(1).to_pylist()):
            count, low = found.get((text, item), (0, at))
            found[text, item] = (count + 1, min(low, at))
        if not found:
            return None
        ids = pa.array([index.ids[i] for _, i in found], to_arrow_type(kind))
        counts, lows = zip(*found.values(), strict=True)
        columns = [batch.column(0).take(pa.array([t for t, _ in found])), ids, pa.array(counts, pa.int32()), pa.array(lows, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return reduce(DataFrame.unionByName, _by_blocks(rows, of, n, block_words, schema, made))


def without_windows(text: str, starts: Iterable[int], n: int) -> str:
    """The text without the words of the windows that start at these words, and what stands between them."""
    places = [m.span() for m in _WORDS.finditer(text)]
    marked: list[tuple[int, int]] = []
    for at in sorted(set(starts)):
        a, b = places[at][0], places[at + n - 1][1]
        if marked and a <= marked[-1][1]:
            marked[-1] = (marked[-1][0], max(b, marked[-1][1]))
        else:
            marked.append((a, b))
    out, last = [], 0
    for a, b in marked:
        out.append(text[last:a])
        last = b
    return "".join([*out, text[last:]])


def without_leaks(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    n: int = N,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """key, cleaned and removed_chars of the documents that hold passages of items: the text without these passages.

    Clean documents do not come out, nor do null texts; what `found_leaks` says of odd rows and of blocks holds here. The
    windows that several blocks find in one document are brought together by (key, hash of the text): rows with equal key
    and text are found alike by every block, so they are as many as any one block says.
    """
    rows = _texts(documents, key, text)
    found = T.StructType([T.StructField("_k", rows.schema["_k"].dataType), T.StructField("_t", T.StringType())])
    found = found.add("_at", T.ArrayType(T.IntegerType()))

    def made(index: ItemIndex, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        starts: dict[int, list[int]] = {}
        for own, _, at in index.hits(batch.column(1).to_pylist()):
            starts.setdefault(own, []).append(at)
        if not starts:
            return None
        hit = pa.array(list(starts))
        columns = [batch.column(0).take(hit), batch.column(1).take(hit).cast(pa.string()), pa.array(starts.values(), pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, found.names)

    parts = _by_blocks(rows, _texts(items, item_key, text), n, block_words, found, made)
    hits = parts[0]
    if len(parts) > 1:
        same = ["_k", F.sha2("_t", 256).alias("_h")]
        once = [p.groupBy(*same).agg(F.any_value("_t").alias("_t"), F.any_value("_at").alias("_at"), F.count("*").alias("_n")) for p in parts]
        every = reduce(DataFrame.unionByName, once).groupBy("_k", "_h")
        every = every.agg(F.any_value("_t").alias("_t"), F.array_distinct(F.flatten(F.collect_list("_at"))).alias("_at"), F.max("_n").alias("_n"))
        hits = every.select("_k", "_t", "_at", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_k", "_t", "_at")
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("cleaned", T.StringType())])
    schema = schema.add("removed_chars", T.IntegerType())

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        cleaned = [without_windows(t, at, n) for t, at in zip(texts, batch.column(2).to_pylist(), strict=True)]
        removed = [len(t) - len(c) for t, c in zip(texts, cleaned, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string()), pa.array(removed, pa.int32())], schema.names)

    return hits.mapInArrow(by_batch(clean, SLICE), schema)
