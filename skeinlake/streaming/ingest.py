"""Incremental ingestion with Structured Streaming: new files are parsed and chunked once, across restarts.

The file source's checkpoint is the manifest of what was loaded, so nothing else has to be kept. Each micro-batch goes out under its
own number; a batch that is run again after a failure replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinlake.operators.chunking import chunk_documents
from skeinlake.sources.files import parse_files


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New files below a folder as binary rows; temporary files are left out."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit("~$")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, max_chunk_size: int = 4096, available_now: bool = True) -> StreamingQuery:
    """Write ``out/chunks`` and ``out/errors``, one folder a batch. ``available_now`` ends after what is there."""

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_files(batch).persist()
        good = parsed.where("error IS NULL").select("path", "file", "pages")
        chunks = chunk_documents(good, max_chunk_size, "path", "pages")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        parsed.where("error IS NOT NULL").select("path", "file", "error").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        parsed.unpersist()

    writer = file_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events): activity sessions of an event stream or table, late rows up to the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
