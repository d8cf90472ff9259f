"""Retrieval: BM25 per bid, hashed embeddings, rank fusion, field search and literal search.

Statistics are those of the whole bid, whatever a search filters later. They come from one aggregation of (bid, token)
counts; postings are never written: literal search makes them where the chunks of a bid meet its queries, field search turns
every chunk into its counts of the few tokens of the catalogue. All queries of all bids run as one plan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tendrel import catalog as C
from tendrel.functions import text as X
from tendrel.session import cut

#: Scores are compared to this many decimals, so that the order of summation can't decide a rank.
EXACT = 9
#: Rows of a group that one task ranks.
WHOLE = 200_000
#: Chunks of a bid that one task of literal search scores.
PART = 50_000
MODULUS, STEP = 2000, 17
_GAP = re.compile(r"[^\w]+")


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of every key by an order, all columns kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def corpus_of(chunks: DataFrame) -> DataFrame:
    """Chunks that can be indexed: with text and id, one per (bid_id, chunk_id), the first by chunk_key; with `words`."""
    rows = first_by(chunks.where("text <> '' AND chunk_id IS NOT NULL AND bid_id IS NOT NULL"), ["bid_id", "chunk_id"], "chunk_key")
    return rows.withColumn("words", X.tokens(F.col("text")))


def term_counts(words: Column) -> Column:
    """array<struct<token, tf>> of an array of words: runs of equal ones in sorted order, within the row."""
    ordered = F.sort_array(words)

    def counted(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())

        def runs(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))

        return F.get(F.transform(F.array(starts), runs), F.lit(0))

    return F.get(F.transform(F.array(ordered), counted), F.lit(0))


def token_weights(corpus: DataFrame, asked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(bid_id, token, idf) of asked tokens and (bid_id, avg_len, chunks) of every bid.

    asked restricts a table with bid_id and token to the tokens that a search needs. A negative weight (a token in more than
    half of a bid's chunks) is replaced by a quarter of the mean weight of all tokens of the bid. A chunk without words
    counts among the bid's chunks.
    """
    bids = corpus.groupBy("bid_id").agg(F.count("*").alias("chunks"), F.avg(F.size("words")).alias("avg_len"))
    spread = corpus.select("bid_id", F.explode(F.array_distinct("words")).alias("token")).groupBy("bid_id", "token").agg(F.count("*").alias("df"))
    raw = F.log(F.col("chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # Tokens of a bid that are in equally many chunks weigh alike, so the mean needs only how many there are of each.
    alike = spread.groupBy("bid_id", "df").agg(F.count("*").alias("tokens")).join(bids, "bid_id")
    mean = alike.groupBy("bid_id").agg((F.sum(raw * F.col("tokens")) / F.sum("tokens")).alias("mean"))
    of_bid = bids.join(mean, "bid_id", "left")
    weighed = asked(spread).join(of_bid, "bid_id")
    idf = F.when(raw < 0, C.BM25_EPSILON * F.col("mean")).otherwise(raw)
    return weighed.select("bid_id", "token", idf.alias("idf")), bids


def ranked(df: DataFrame, group: list[str], score: str, tie: str, out: str, largest: int | None = None, whole: int = WHOLE) -> DataFrame:
    """df with the rank (from 1) of every row in its group, by falling score, then rising tie.

    Where no group has more than `whole` rows - the caller's bound `largest` says so, or they are counted - a window per
    group gives the ranks. Else a group of any size is ranked by many tasks: rows are sorted over all tasks by group,
    score and tie, each task numbers its stretch of a group, and the stretches' lengths are summed up. That order is
    total, so many equal or close scores are spread like any others. Both ways give the same ranks.
    """
    exact = F.round(score, EXACT)
    if largest is None:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if largest <= whole:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(exact.desc(), tie)))
    order = [*[F.col(g) for g in group], exact.desc(), F.col(tie)]
    stretches = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*stretches.schema.fields, T.StructField("_no", T.LongType())])
    at = [stretches.columns.index(g) for g in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            numbers = []
            for own in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                count = count + 1 if own == last else 1
                last = own
                numbers.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], schema.names)

    numbered = cut(stretches.mapInArrow(number, schema))
    counts = numbered.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_group{k}" for k in range(len(group))]
    starts = counts.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)]
    placed = numbered.join(starts, [*same, F.col("_part") == F.col("_of")])
    return placed.select(*df.columns, (F.col("_before") + F.col("_no")).cast("int").alias(out))


def top(df: DataFrame, group: list[str], score: str, tie: str, k: int, out: str = "rank") -> DataFrame:
    """The first k rows of every group; Spark cuts groups to k in each task before anything is shuffled."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(F.round(score, EXACT).desc(), tie))
    return df.withColumn(out, number).where(F.col(out) <= k)


@lru_cache(maxsize=200_000)
def _residue(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest(), 16) % MODULUS


@lru_cache(maxsize=4)
def _components(dim: int) -> np.ndarray:
    """The embedding of every residue, times 1,000: whole numbers, so that sums are exact in any order."""
    return ((np.arange(MODULUS)[:, None] + STEP * np.arange(dim)[None, :]) % MODULUS - MODULUS // 2).astype(np.int32)


def embed(words: list[str] | None, dim: int = C.EMBEDDING_DIM) -> np.ndarray:
    """The sum of the words' hashed vectors, not normalised; a text without words counts as the word "empty"."""
    return _components(dim)[[_residue(w) for w in words or ["empty"]]].sum(0, dtype=np.int64)


def embeddings(rows: DataFrame, key: str, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """key and vector (whole numbers: the sum of hashed word vectors times 1,000) of rows with a column words."""
    schema = T.StructType([rows.schema[key], T.StructField("vector", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.concatenate([embed(w, dim) for w in batch.column(1).to_pylist()])
                offsets = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], schema.names)

    return rows.select(key, "words").mapInArrow(run, schema)


def _best(plain: pa.Array, avg_len: float, idf: np.ndarray, tokens: pa.Array, asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and scores > 0 of the k best texts for every query; of equal scores the first rows.

    plain: the words of every text with one blank between; asked: the numbers of a query's tokens, and how often it has each.
    """
    words = pc.split_pattern(plain, " ")
    size = pc.list_value_length(words).to_numpy() - pc.equal(plain, "").to_numpy(zero_copy_only=False)
    code = pc.index_in(words.flatten(), value_set=tokens)
    known = code.is_valid()
    token = code.filter(known).to_numpy().astype(np.int64)
    place, tf = np.unique(token * len(plain) + pc.list_parent_indices(words).filter(known).to_numpy(), return_counts=True)
    token, row = np.divmod(place, len(plain))
    gain = idf[token] * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * size[row] / avg_len))
    starts = np.searchsorted(token, np.arange(len(tokens) + 1))
    out = []
    for own, times in asked:
        score = np.zeros(len(plain))
        for t, n in zip(own.tolist(), times.tolist(), strict=True):
            score[row[starts[t] : starts[t + 1]]] += n * gain[starts[t] : starts[t + 1]]
        # What rounding can bring to the level of the last of k is at most one unit below it.
        least = np.partition(score, -k)[-k] - 2 * 10.0**-EXACT if len(score) > k else 0
        near = np.flatnonzero((score >= least) & (score > 0))
        exact = score[near].round(EXACT)
        first = np.argsort(-exact, kind="stable")[:k]
        first = near[first[exact[first] > 0]]
        out.append((first, score[first]))
    return out


def literal_search(chunks: DataFrame, queries: DataFrame, query: str, k: int = 5, part: int = PART) -> DataFrame:
    """query, bid_id, rank, chunk_id, score: the k best chunks of its bid for every query text (columns query, bid_id, text).

    The words of a chunk are shuffled once, by bid, and bids of more than `part` chunks in parts of about that size; only bids
    that are asked for are looked at further. From there come the weights, by one shuffle of a part's counts, and the
    scores: a part meets all queries of its bid and keeps the k best of each, so neither postings nor scores are shuffled.
    """
    words = queries.select(query, "bid_id", F.explode(term_counts(X.tokens(F.col("text")))).alias("_word"))
    asked = words.select(query, "bid_id", "_word.token", F.col("_word.tf").alias("times"))
    # At most one row for every `part` chunks.
    large = chunks.where("bid_id IS NOT NULL").groupBy("bid_id").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts")).where("_parts > 1")

    def parted(df: DataFrame, own: Callable[[Column], Column]) -> DataFrame:
        return df.join(F.broadcast(large), "bid_id", "left").withColumn("_part", own(F.coalesce("_parts", F.lit(1)))).drop("_parts")

    def everywhere(df: DataFrame) -> DataFrame:
        return parted(df, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))

    rows = parted(chunks.where("text <> '' AND chunk_id IS NOT NULL AND bid_id IS NOT NULL"), lambda n: F.pmod(F.xxhash64("chunk_id"), n).cast("int"))
    rows = rows.select("bid_id", "_part", "chunk_id", "chunk_key", F.array_join(X.tokens(F.col("text")), " ").alias("plain"))
    rows = rows.join(everywhere(queries.select("bid_id").distinct()).hint("shuffle_hash"), ["bid_id", "_part"], "left_semi")
    corpus = first_by(rows, ["bid_id", "_part", "chunk_id"], F.col("chunk_key").asc_nulls_last()).drop("chunk_key")
    sought = asked.select("bid_id", "token").distinct()
    own = F.filter(F.split("plain", " "), lambda x: x != "")
    weights, bids = token_weights(corpus.select("bid_id", own.alias("words")), lambda df: df.join(sought, ["bid_id", "token"], "left_semi"))
    weighed = everywhere(asked.join(weights, ["bid_id", "token"]).join(bids.select("bid_id", "avg_len"), "bid_id"))
    schema = T.StructType([queries.schema[query], T.StructField("bid_id", T.StringType()), chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    columns = to_arrow_schema(schema)

    def score(key: tuple, texts: pa.Table, of: pa.Table) -> pa.Table:
        if not texts.num_rows or not of.num_rows:
            return columns.empty_table()
        texts = texts.sort_by("chunk_id")
        asking = of.column(query).combine_chunks().dictionary_encode("encode")
        tokens = of.column("token").combine_chunks().dictionary_encode()
        token, times = tokens.indices.to_numpy(), of.column("times").to_numpy()
        idf = np.zeros(len(tokens.dictionary))
        idf[token] = of.column("idf").to_numpy()
        order = np.argsort(asking.indices.to_numpy(), kind="stable")
        ends = np.flatnonzero(np.diff(asking.indices.to_numpy()[order])) + 1
        each = [(token[x], times[x]) for x in np.split(order, ends)]
        plain, known = texts.column("plain").cast(pa.large_string()).combine_chunks(), tokens.dictionary.cast(pa.large_string())
        found = _best(plain, of.column("avg_len")[0].as_py(), idf, known, each, k)
        first = np.concatenate([x for x, _ in found])
        asker = asking.dictionary.take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found])))
        ids = texts.column("chunk_id").take(pa.array(first))
        return pa.table([asker, pa.repeat(key[0], len(first)), ids, np.concatenate([x for _, x in found])], schema=columns)

    group = ["bid_id", "_part"]
    scores = corpus.groupBy(*group).cogroup(weighed.groupBy(*group)).applyInArrow(score, schema)
    return top(scores, [query], "score", "chunk_id", k).select(query, "bid_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def documents_named(documents: DataFrame, name: str) -> DataFrame:
    """bid_id and doc_id of the documents (with metadata.source_filename) whose id or file name is `name`."""
    return documents.where((F.col("doc_id") == name) | (F.col("metadata.source_filename") == name)).select("bid_id", "doc_id").distinct()


#: The lists of a field that are not one of an alias: by meaning, and by the section's name.
SEMANTIC, LABEL = -1, -2


@dataclass(frozen=True)
class Catalogue:
    """The catalogue as arrays: tokens, aliases by token, the question of every field as a vector."""

    tokens: tuple[str, ...]
    #: (field, number within the field, lowered alias) of every alias.
    aliases: tuple[tuple[int, int, str], ...]
    #: How often every token occurs in every alias.
    times: np.ndarray
    questions: np.ndarray

    @staticmethod
    def words(text: str) -> list[str]:
        return _GAP.sub(" ", text.lower()).split()

    @classmethod
    def of(cls, fields: list[C.Field], dim: int) -> Catalogue:
        aliases = tuple((f.position - 1, k, a.lower()) for f in fields for k, a in enumerate(f.aliases))
        tokens = tuple(sorted({w for *_, a in aliases for w in cls.words(a)}))
        times = np.array([[cls.words(a).count(t) for t in tokens] for *_, a in aliases], np.float64)
        return cls(tokens, aliases, times, np.stack([embed(cls.words(f.question), dim) for f in fields]).astype(np.float64))

    def named(self, section: str) -> list[int]:
        """Fields of which an alias holds, or is held by, the name of a section."""
        return sorted({f for f, _, a in self.aliases if a in section or section in a}) if len(section) >= 3 else []


def _profiles(corpus: DataFrame, catalogue: Catalogue, dim: int) -> DataFrame:
    """bid_id, chunk_id, doc_id, len, tf (of the catalogue's tokens), similarity and label (by field) of every chunk."""
    columns = [corpus.schema[c] for c in ("bid_id", "chunk_id", "doc_id")]
    schema = T.StructType([*columns, T.StructField("len", T.IntegerType()), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    schema = schema.add("similarity", T.ArrayType(T.DoubleType())).add("labels", T.ArrayType(T.IntegerType()))
    index = {t: k for k, t in enumerate(catalogue.tokens)}
    norms = np.sqrt((catalogue.questions**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lru_cache(100_000)(catalogue.named)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(3).to_pylist()
            tf = np.zeros((len(words), len(index)), np.int32)
            for k, own in enumerate(words):
                for w in own:
                    if (at := index.get(w)) is not None:
                        tf[k, at] += 1
            vectors = np.stack([embed(w, dim) for w in words]).astype(np.float64)
            both = np.sqrt((vectors**2).sum(1))[:, None] * norms[None, :]
            similar = np.divide(vectors @ catalogue.questions.T, both, out=np.zeros_like(both), where=both > 0)
            labels = [named(x) if x else [] for x in batch.column(4).to_pylist()]
            sizes = pa.array([len(w) for w in words], pa.int32())
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.array(x.ravel()[:1]).type)) for x in (tf, similar)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, *arrays, pa.array(labels, pa.list_(pa.int32()))], schema.names)

    section = F.when(F.col("source_format") == "html", F.lower(F.trim("section_identifier")))
    return corpus.select("bid_id", "chunk_id", "doc_id", "words", section).mapInArrow(run, schema)


def _scores(profiles: DataFrame, catalogue: Catalogue) -> DataFrame:
    """bid_id, chunk_id, doc_id, field, list and score > 0: every list that a chunk stands in, from profiles with idf and avg_len."""
    columns = [profiles.schema[c] for c in ("bid_id", "chunk_id", "doc_id")]
    schema = T.StructType([*columns, T.StructField("field", T.IntegerType()), T.StructField("list", T.IntegerType()), T.StructField("score", T.DoubleType())])
    of_alias = np.array([f for f, *_ in catalogue.aliases], np.int32), np.array([k for _, k, _ in catalogue.aliases], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, idf, tf, similar = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (7, 8, 4, 5))
            norm = tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * batch.column(3).to_numpy()[:, None] / size)
            gain = np.divide(idf * tf * (C.BM25_K1 + 1), norm, out=np.zeros(tf.shape), where=tf > 0)
            lexical = (gain @ catalogue.times.T).round(EXACT + 3)
            parts = []
            row, alias = np.nonzero(lexical.round(EXACT) > 0)
            parts.append((row, of_alias[0][alias], of_alias[1][alias], lexical[row, alias]))
            row, field = np.nonzero(similar > 0)
            parts.append((row, field.astype(np.int32), np.full(len(row), SEMANTIC, np.int32), similar[row, field]))
            labels = batch.column(6)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(labels).to_numpy(zero_copy_only=False))
            parts.append((row, labels.flatten().to_numpy(zero_copy_only=False), np.full(len(row), LABEL, np.int32), np.ones(len(row))))
            row, field, number, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys = [batch.column(k).take(pa.array(row)) for k in range(3)]
            values = [pa.array(field, pa.int32()), pa.array(number, pa.int32()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*keys, *values], schema.names)

    columns = ["bid_id", "chunk_id", "doc_id", "len", "tf", "similarity", "labels", F.array("avg_len"), "idf"]
    return profiles.select(*columns).mapInArrow(run, schema)


def field_search(chunks: DataFrame, top_k: int = C.TOP_K, floor: int = C.LEXICAL_FLOOR, per_document: bool = False, whole: int = WHOLE, only: DataFrame | None = None) -> DataFrame:
    """The chunks of every bid for each of the 20 fields.

    bid_id, field_name, overall_rank, chunk_id, fused_score, lexical_rank, semantic_rank, label_hit, floor_inserted.
    Lexical ranks fuse one BM25 list per alias; the final ranks fuse the lexical, the semantic and the label list. The
    first `floor` lexical chunks come along even where they miss the first `top_k`. With `per_document` every document is
    searched on its own and doc_id comes out as well; the statistics stay those of the bid. So they do with `only`
    (bid_id, doc_id, see `documents_named`): then chunks of these documents alone are ranked.

    Every chunk first becomes its counts of the catalogue's tokens, its similarity to every question and its labels; with
    the bid's weights that gives all lists it stands in. One table of (group, list, chunk) is then shuffled by group once:
    the ranks of all lists are one window over it, and a chunk's ranks are brought together within the group. Groups of
    more than `whole` chunks are ranked over many tasks instead (see `ranked`).
    """
    group = ["bid_id", "doc_id", "field"] if per_document else ["bid_id", "field"]
    catalogue = Catalogue.of(C.fields(), C.EMBEDDING_DIM)
    corpus = cut(corpus_of(chunks).select("bid_id", "chunk_id", "doc_id", "source_format", "section_identifier", "words"))
    weights, bids = token_weights(corpus, lambda df: df.where(F.col("token").isin(*catalogue.tokens)))
    known = F.map_from_entries(F.collect_list(F.struct("token", "idf")))
    tokens = F.array(*map(F.lit, catalogue.tokens))
    of_bid = bids.join(weights.groupBy("bid_id").agg(known.alias("known")), "bid_id", "left")
    idf = F.transform(tokens, lambda t: F.coalesce(F.element_at("known", t), F.lit(0.0)))
    of_bid = of_bid.select("bid_id", "avg_len", "chunks", F.coalesce(idf, F.array_repeat(F.lit(0.0), len(catalogue.tokens))).alias("idf"))
    largest = bids.agg(F.max("chunks")).first()[0] or 0
    profiles = _profiles(corpus, catalogue, C.EMBEDDING_DIM).join(of_bid.drop("chunks"), "bid_id")
    lists = _scores(profiles, catalogue)
    if only is not None:
        lists = lists.join(only.select("bid_id", "doc_id").distinct(), ["bid_id", "doc_id"], "left_semi")
    # A window, and a grouping by chunk, need no other partitioning than that of the group.
    lists = lists.repartition(*group) if largest <= whole else cut(lists)
    places = ranked(lists, [*group, "list"], "score", "chunk_id", "rank", largest, whole)
    gain = 1.0 / (C.RRF_K + F.col("rank"))
    keys = [*group, "chunk_id"]
    merged = places.groupBy(*keys).agg(
        F.round(F.sum(F.when(F.col("list") >= 0, gain)), 12).alias("lexical"),
        F.max(F.when(F.col("list") == SEMANTIC, F.col("rank"))).alias("semantic_rank"),
        F.max(F.when(F.col("list") == LABEL, F.col("rank"))).alias("label_rank"),
    )

    def placed(df: DataFrame, score: str, out: str) -> DataFrame:
        return ranked(df if largest <= whole else cut(df), group, score, "chunk_id", out, largest, whole)

    # Chunks without a lexical score come last, and have no lexical rank.
    merged = placed(merged.withColumn("_lexical", F.coalesce("lexical", F.lit(0.0))), "_lexical", "_rank")
    merged = merged.withColumn("lexical_rank", F.when(F.col("lexical").isNotNull(), F.col("_rank")))
    fused = sum((F.coalesce(1.0 / (C.RRF_K + F.col(r)), F.lit(0.0)) for r in ("lexical_rank", "semantic_rank", "label_rank")), F.lit(0.0))
    final = placed(merged.drop("_lexical", "_rank").withColumn("fused", F.round(fused, 12)), "fused", "final_rank")
    kept = final.where((F.col("final_rank") <= top_k) | (F.col("lexical_rank") <= floor))
    first = F.when(F.col("final_rank") <= top_k, F.col("final_rank")).otherwise(F.lit(top_k) + F.col("lexical_rank"))
    names = F.array(*[F.lit(f.name) for f in C.fields()])
    return kept.withColumn("overall_rank", F.row_number().over(Window.partitionBy(*group).orderBy(first))).select(
        *group[:-1],
        F.get(names, F.col("field")).alias("field_name"),
        "overall_rank",
        "chunk_id",
        F.round("fused", 9).alias("fused_score"),
        "lexical_rank",
        "semantic_rank",
        F.col("label_rank").isNotNull().alias("label_hit"),
        (F.col("final_rank") > top_k).alias("floor_inserted"),
    )
