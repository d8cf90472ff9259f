"""Incremental ingest: new files become sections as they arrive, late repeats are left out. An extension of the batch path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tendrel.sources import files


def new_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The stream of files under `folder`/<bid>/, as `files.scan` gives them, with arrived_at.

    That is the time at which the file is taken in, as files may be copied in with any modification time.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    # The source forgets and skips files a week older than the newest, unless told otherwise; so it keeps the paths of all.
    options = {"maxFilesPerTrigger": per_trigger, "maxFileAge": "36500d"}
    raw = spark.readStream.format("binaryFile").schema(schema).options(**options).load(f"{folder}/*")
    parts = F.split("path", "/")
    kind = F.when(F.lower("path").endswith(".pdf"), "pdf").when(F.lower("path").rlike(r"\.html?$"), "html")
    return raw.select(
        F.element_at(parts, -2).alias("bid_id"),
        F.element_at(parts, -1).alias("filename"),
        F.substring(F.sha1("content"), 1, 12).alias("doc_id"),
        kind.alias("kind"),
        "content",
        F.current_timestamp().alias("arrived_at"),
    ).where("kind IS NOT NULL")


def ingest(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    repeats_within: str = "1 day",
    available_now: bool = True,
    reader: Callable[[bytes], list[str | files.PdfPage]] = files.mupdf_pages,
) -> StreamingQuery:
    """Appends the sections of new files, as `files.parse` gives them, to the Parquet table `out`.

    The same content of a bid that comes again within `repeats_within`, under any name, is left out (state is bounded by
    the watermark); a file with new content never is.
    The checkpoint folder makes every file count once, also after a restart. With `available_now` the query ends when
    all files that are there have been read.
    """
    once = new_files(spark, folder).withWatermark("arrived_at", repeats_within).dropDuplicatesWithinWatermark(["bid_id", "doc_id", "kind"])
    writer = files.parse(once, reader).writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
