"""Results as JSON files: one per bid, and one document for all bids of a run.

Files are written by the tasks into a folder that all of them share, each under a temporary name that is then replaced, so
a task that runs twice leaves the same file. Nothing but the document for all bids passes through the driver, and that as
a stream.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel import catalog as C
from tendrel.session import cut


def _pretty(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def _replace(path: Path, text: str) -> None:
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)


def write_by_bid(rows: DataFrame, json_text: str, folder: str, suffix: str) -> DataFrame:
    """Writes the JSON text of every bid to `<bid_id><suffix>` in a folder, indented; gives bid_id and path of each.

    rows: bid_id and the column `json_text`, a row per bid. Rows with a null in either are left out. Characters that cannot
    stand in a file name are percent-encoded, so different bids never share a file.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for bid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = Path(folder) / (quote(bid, safe="") + suffix)
                _replace(path, _pretty(json.loads(text)))
                paths.append(str(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["bid_id", "path"])

    kept = rows.where(F.col("bid_id").isNotNull() & F.col(json_text).isNotNull()).select(F.col("bid_id").cast("string"), json_text)
    return cut(kept.mapInArrow(run, "bid_id string, path string"))


def write_aggregate(flat: DataFrame, json_text: str, path: str) -> int:
    """Writes one document of all bids, in order of bid_id: the labels as `schema`, and `bids` of bid_id and fields.

    Bids are sorted by Spark and streamed through the driver, which holds one partition at a time. Gives their number.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part, count = target.with_name(f".{target.name}.part"), 0
    with part.open("w", encoding="utf-8") as f:
        f.write('{\n  "schema": ' + json.dumps([x.label for x in C.fields()], ensure_ascii=False) + ',\n  "bids": [')
        for row in flat.where("bid_id IS NOT NULL").select("bid_id", json_text).orderBy("bid_id").toLocalIterator():
            entry = json.dumps({"bid_id": row[0], "fields": json.loads(row[1])}, ensure_ascii=False)
            f.write(("," if count else "") + "\n    " + entry)
            count += 1
        f.write("\n  ]\n}\n")
    part.replace(target)
    return count


def answered(bids: DataFrame, calls: DataFrame) -> DataFrame:
    """bids without those of whose calls (columns bid_id and status) every one ended as provider_error.

    A bid without calls stays: its empty record is a result, that of a failed provider is none.
    """
    failed = calls.groupBy("bid_id").agg(F.bool_and(F.col("status") == "provider_error").alias("_failed")).where("_failed")
    return bids.join(failed.select("bid_id"), "bid_id", "left_anti")
