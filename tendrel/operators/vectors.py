"""Exact nearest vectors by cosine, block against block.

Queries and rows are packed into blocks of bounded size. Every block of rows meets every block of queries - a stated
query set against all rows - in one matrix product, of which only the k best of each query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block: 4,096 vectors of 768 doubles are 25 MB.
BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Blocks of up to `size` rows: their keys, their vectors as bytes of doubles, and the dimension."""
    names = ["ids", "data", "dim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1))
            for dim in pc.unique(lengths).to_pylist():
                same = batch.filter(pc.equal(lengths, dim))
                for at in range(0, same.num_rows, size):
                    part = same.slice(at, size)
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                    data = pa.array([flat.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids, data, pa.array([dim], pa.int32())], names)

    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    rows = df.where(F.col(key).isNotNull() & whole).select(F.col(key).cast("long"), vector)
    return rows.mapInArrow(run, "ids array<bigint>, data binary, dim int")


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """key, rank, near_id, similarity: the k rows nearest to every query by cosine, itself left out.

    Ties (to nine decimals) are ordered by id. Rows with a null or empty vector or a null in it take no part; vectors of
    another dimension than the query's are not compared with it; a zero vector is similar to none (0). Rows with equal ids
    are compared each. Exact: the recall is 1.
    """
    a, b = _blocks(queries, key, vector, block), _blocks(rows, key, vector, block)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("near_id", T.LongType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, d_ids, d_data, dim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, d = (np.frombuffer(x).reshape(-1, dim) for x in (q_data, d_data))
                size = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((d**2).sum(1))[None, :]
                s = np.divide(q @ d.T, size, out=np.zeros_like(size), where=size > 0).round(9)
                q_ids, d_ids = np.array(q_ids), np.array(d_ids)
                s[q_ids[:, None] == d_ids[None, :]] = -np.inf
                for i in range(len(q_ids)):
                    # All that reach the k-th best score, and only those are ordered: ties at the border are kept.
                    border = np.partition(s[i], len(s[i]) - k)[len(s[i]) - k] if k < len(s[i]) else -np.inf
                    near = np.flatnonzero((s[i] >= border) & np.isfinite(s[i]))
                    best = near[np.lexsort((d_ids[near], -s[i][near]))[:k]]
                    columns = [np.full(len(best), q_ids[i]), d_ids[best], s[i][best]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.names)

    asked = a.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("dim").alias("q_dim"))
    # Blocks of a stated query set against blocks of all rows: few of either, and never single rows.
    pairs = b.repartition(spread(rows)).crossJoin(asked).where("dim = q_dim")
    best = pairs.select("q_ids", "q_data", "ids", "data", "dim").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("s").desc(), "near_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "near_id", F.round("s", 6).alias("similarity"))


def spread(df: DataFrame) -> int:
    """Tasks for work that is heavy for its bytes: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
