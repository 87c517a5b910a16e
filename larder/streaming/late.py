"""Late data in a stream: rows within the watermark come in by revision, rows beyond it are counted apart.

Each key's newest revision is state with an event-time timer: a key that has been idle for ``idle`` is forgotten. What
leaves the stream are changes, and the table behind it is guarded by revision as well, so forgetting loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for no revision within the stream, where a null would turn integers into floats.
NONE = -(1 << 63)


class _Guard(StatefulProcessor):
    """State: (newest revision, when the key is forgotten in milliseconds). Parameters bear the names by which Spark passes them."""

    def __init__(self, idle_ms: int):
        self._idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "rev long, forget long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        seen, late, newest, last = 0, 0, None, mark
        for some in rows:
            kept = some[some["at_ms"] >= mark]
            late += len(some) - len(kept)
            seen += len(kept)
            if len(kept):
                last = max(last, int(kept["at_ms"].max()))
                revs = kept["rev"][kept["rev"] != NONE]
                if len(revs):
                    newest = int(revs.max()) if newest is None else max(newest, int(revs.max()))
        held = self._held.get() if self._held.exists() else None
        known, forget = held or (None, None)
        if seen:
            if forget is not None:
                self._handle.deleteTimer(forget)
            until = max(last + self._idle, forget or 0)
            self._handle.registerTimer(until)
            self._held.update((newest if known is None else known if newest is None else max(known, newest), until))
        changed = newest is not None and (known is None or newest > known)
        yield pd.DataFrame({"key": [key[0]], "rev": pd.array([newest if changed else None], "Int64"), "merged": [seen], "late": [late]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._held.clear()
        return iter([])

    def close(self) -> None:
        pass


def guarded_changes(rows: DataFrame, key: str, rev: str, ts: str, late: str, idle_ms: int) -> DataFrame:
    """Of a stream of rows: (key, rev, merged, late), one for each key that a micro-batch brings.

    rev is the key's new revision where it has grown, else null. A row is late if its time, in milliseconds, is below
    the watermark, which is the latest time of earlier micro-batches less ``late``; late rows change no state. key and
    rev are integers; rows without a key or a time are left out.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    # As plain milliseconds, else Spark drops late rows uncounted.
    plain = known.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(rev).cast("long"), F.lit(NONE)).alias("rev"), F.unix_millis(ts).alias("at_ms"))
    return plain.groupBy("key").transformWithStateInPandas(statefulProcessor=_Guard(idle_ms), outputStructType="key long, rev long, merged long, late long", outputMode="Update", timeMode="EventTime")


def arrive(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, rev: str, ts: str, late: str = "1 hour", idle_ms: int = 86_400_000) -> None:
    """Take in what has arrived in source since the last call as one micro-batch; changes are appended to out under the batch's number."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        changes = guarded_changes(spark.readStream.schema(schema).parquet(source), key, rev, ts, late, idle_ms)
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(key, rev, merged, late) over all batches."""
    changes = spark.read.schema("key long, rev long, merged long, late long, batch long").parquet(out)
    return changes.groupBy("key").agg(F.max("rev").alias("rev"), F.sum("merged").alias("merged"), F.sum("late").alias("late"))
