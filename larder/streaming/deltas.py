"""Incremental application of deltas: file by file behind a watermark, and as a stream with the same end state."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources import sinks as K
from larder.sources.files import SourceError
from larder.streaming.manifest import ManifestTable

#: What a file that is missing, cut off or malformed raises when it is read; other errors are errors of the program.
UNREADABLE = (PySparkException, Py4JJavaError, SourceError, OSError)


def apply_files(stored: DataFrame, files: list[tuple[int, str]], read: Callable[[str], DataFrame], watermark: int | None, key: str = "code", rev: str = "rev") -> tuple[DataFrame, int | None]:
    """Merge the files after the watermark in time order; stop at the first that can't be read.

    A file is read whole before anything of it counts, and its rows are committed with its time, so a file that breaks
    late leaves state and watermark of the one before. Returns the state and the watermark of the last file applied.
    """
    spark = stored.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    table = ManifestTable(spark, K.workspace(spark, "deltas"), schema, key, rev)
    table.apply(stored, -1 if watermark is None else watermark)
    for timestamp, path in sorted(files):
        if watermark is not None and timestamp <= watermark:
            continue
        try:
            incoming = K.write_table(read(path), K.workspace(spark, "delta"))
        except UNREADABLE:
            break
        table.apply(incoming, timestamp)
        watermark = timestamp
    return table.read(), watermark


def stream_merge(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, key: str, rev: str, buckets: int = 16) -> DataFrame:
    """Merge every new file of source into the table and give its state.

    Each micro-batch is one commit under its own number, so one that runs again after a failure changes nothing twice.
    Without new files the state is what it was.
    """
    held = ManifestTable(spark, table, schema, key, rev, buckets)
    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
        .writeStream.foreachBatch(lambda batch, number: held.apply(batch, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return held.read()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; with a stream, windows close when the watermark has passed."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
