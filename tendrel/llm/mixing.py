"""Problem 7: mix sources to target shares of all tokens, with a capped number of repeats.

Let s be a source's target share, t its tokens and r its cap. The mix can hold at most T = min(t * r / s) tokens in all
and reach the shares; every document of a source is then expected e = s * T / t times, which is at most r. Systematic
sampling draws exactly that: documents stand in a row, each adds e to a running sum that starts at a random offset, and
a document comes out once per whole number that the sum crosses. So it comes out floor(e) or ceil(e) times.

Within a source the documents stand in order of their size, so every stretch of sizes gets its share of the copies and
the reached token shares lie close to the targets. The running sum is e times the place in that order. Places come from
counts of small groups (source, size, slice of the key's hash): the counts are summed up over the groups, and within a
group, which is bounded by the slicing, rows are numbered. No task ever holds a whole source.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel.llm.arrowtext import by_batch
from tendrel.session import cut

#: Folder of the public tokenizers' files, and the vocabulary that sizes are measured in.
TOKENIZERS = os.environ.get("TENDREL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's public tokenizer splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SEED = 7
#: Documents of a group that are numbered within one task.
GROUP = 50_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str) -> list[int]:
    """The number of tokens of every text; special tokens' strings are ordinary text."""
    encoding = _encoding(path)
    return [len(encoding.encode_ordinary(t)) for t in texts]


def token_counts(documents: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, source and tokens of every document with a source; a null text has no tokens. One pass, no shuffle."""
    path = f"{folder}/{vocabulary}"
    rows = documents.where(F.col("source").isNotNull()).select(F.col(key), "source", F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([documents.schema[key], documents.schema["source"], T.StructField("tokens", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = pa.array(count_tokens(batch.column(2).to_pylist(), path), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], schema.names)

    return rows.mapInArrow(by_batch(run), schema)


def plan_mix(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """source, documents, source_tokens, target_share, max_repeats and expected (copies of each document).

    Sources without a target, a target of null or 0, or without tokens take no part. Where the targets of the sources
    that are there do not sum to 1, their proportions hold. `counts` is aggregated before anything moves; what is left is
    one row per source.
    """
    size = counts.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("source_tokens"))
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats")
    there = size.join(wanted, "source").where("source_tokens > 0")
    # One row per source of the targets, so a window without partitions holds a short list.
    total = F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("target_share")).over(Window.partitionBy(F.lit(1)))
    return there.withColumn("_total", total).select(
        "source",
        "documents",
        "source_tokens",
        "target_share",
        "max_repeats",
        F.least(F.col("target_share") * F.col("_total") / F.col("source_tokens"), F.col("max_repeats").cast("double")).alias("expected"),
    )


def draw(counts: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """key, source, tokens and copies (0 or more) of every document of a planned source.

    The result depends on keys, sizes and seed only, not on the order or partitioning of the rows. Rows with equal keys
    count each; ties of size are ordered by the hash of the key, then the key.
    """
    slices = F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(GROUP))).cast("int")
    # The plan has one row per source of the targets, a short list; its size is Spark's to check for a broadcast.
    rows = counts.join(plan.select("source", "expected", slices.alias("_slices")), "source").select(
        key,
        "source",
        "tokens",
        "expected",
        # Sizes in steps of an eighth of an octave: a few hundred at most.
        F.floor(F.log2(F.col("tokens") + 1) * 8).cast("int").alias("_size"),
        F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.col("_slices")).cast("int").alias("_slice"),
    )
    groups = rows.groupBy("source", "_size", "_slice").count()
    # Sums in two levels, so that no window holds more than the sizes of a source or the slices of a size.
    sizes = groups.groupBy("source", "_size").agg(F.sum("count").alias("count"))
    up_to = Window.rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("count").over(up_to.partitionBy("source").orderBy("_size")), F.lit(0))
    of_sizes = sizes.select("source", "_size", smaller.alias("_of_sizes"))
    of_slices = F.coalesce(F.sum("count").over(up_to.partitionBy("source", "_size").orderBy("_slice")), F.lit(0))
    starts = groups.select("source", "_size", "_slice", of_slices.alias("_of_slices")).join(of_sizes, ["source", "_size"])
    starts = starts.select("source", "_size", "_slice", (F.col("_of_sizes") + F.col("_of_slices")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("source", "_size", "_slice").orderBy("tokens", F.xxhash64(F.col(key)), F.col(key)))
    placed = rows.withColumn("_no", within).join(starts, ["source", "_size", "_slice"])
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    place = F.col("_before") + F.col("_no")
    copies = F.floor(offset + place * F.col("expected")) - F.floor(offset + (place - 1) * F.col("expected"))
    return placed.select(key, "source", "tokens", copies.cast("int").alias("copies"))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    seed: int = SEED,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """key, source, tokens and copies of every document in the mix (copies >= 1).

    Documents with a null source take no part; blank texts have no tokens and come along with their source's share.
    Texts are tokenized once: the counts are written to the checkpoint folder before they are used twice.
    """
    counts = cut(token_counts(documents, key, folder, vocabulary))
    return draw(counts, plan_mix(counts, targets), key, seed).where("copies > 0")


def mix_shares(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    seed: int = SEED,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """source, target_share, reached_share, mixed_tokens, used_documents, most_copies and max_repeats per source."""
    counts = cut(token_counts(documents, key, folder, vocabulary))
    plan = plan_mix(counts, targets)
    drawn = draw(counts, plan, key, seed)
    reached = drawn.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"),
        F.count_if(F.col("copies") > 0).alias("used_documents"),
        F.max("copies").alias("most_copies"),
    )
    # One row per source, so a window without partitions holds a short list.
    share = F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return reached.join(plan.select("source", "target_share", "max_repeats"), "source").select(
        "source", "target_share", share.alias("reached_share"), "mixed_tokens", "used_documents", "most_copies", "max_repeats"
    )
