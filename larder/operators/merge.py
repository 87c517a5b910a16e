"""Upserts as joins: revision-guarded merge, keyed overwrite, and the run journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(frame: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    return frame.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def merge_by_revision(stored: DataFrame, incoming: DataFrame, key: str = "code", rev: str = "rev", position: str | None = None) -> DataFrame:
    """stored with incoming rows whose revision is newer or equal; a null revision never replaces a known one.

    Several incoming rows of one key: the largest revision, then the last position, comes to the merge. A stored null
    revision is replaced by anything.
    """
    order = [F.desc_nulls_last(rev), *([F.desc(position)] if position else []), *[F.desc(c) for c in incoming.columns if c not in (key, rev, position)]]
    fresh = newest(incoming, [key], *order).select(stored.columns)
    both = stored.select(key, F.struct(*stored.columns).alias("s")).join(fresh.select(key, F.struct(*stored.columns).alias("n")), key, "full_outer")
    wins = F.col("s").isNull() | (F.col("n").isNotNull() & (F.col(f"s.{rev}").isNull() | F.coalesce(F.col(f"n.{rev}") >= F.col(f"s.{rev}"), F.lit(False))))
    return both.select(F.when(wins, F.col("n")).otherwise(F.col("s")).alias("r")).select("r.*")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored overwritten by incoming rows of the same key; of several, the one with the largest order."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.select(stored.columns).withColumn("__new", F.lit(1)))
    return newest(both, keys, F.desc("__new"), F.desc(order)).drop("__new")


def update_by_key(stored: DataFrame, values: DataFrame, keys: list[str], column: str) -> DataFrame:
    """stored with column replaced where values has the key."""
    new = values.select(*keys, F.col(column).alias("__value"), F.lit(True).alias("__hit"))
    return stored.join(new, keys, "left").withColumn(column, F.when(F.col("__hit"), F.col("__value")).otherwise(F.col(column))).select(stored.columns)


def journal(counts: DataFrame, stage: str, status: str, **params: Column) -> DataFrame:
    """A journal row of a run from its counts (seen, written, skipped), which stay where they are; params as strings."""
    pairs = [x for name, value in params.items() for x in (F.lit(name), value.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return counts.select(
        F.lit(stage).alias("stage"), F.lit(status).alias("status"), *[F.col(c).cast("long").alias(f"items_{c}") for c in ("seen", "written", "skipped")], made.alias("params"), F.current_timestamp().alias("started_at")
    )


def last_watermark(runs: DataFrame) -> DataFrame:
    """watermark of the newest completed delta run; a row with null if there is none."""
    done = runs.where((F.col("stage") == "ingest") & (F.col("status") == "completed") & (F.col("params")["mode"] == "delta"))
    return done.agg(F.max_by(F.col("params")["watermark"], "started_at").cast("long").alias("watermark"))


def quarantine(frame: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with the name of the first check they fail."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = frame.withColumn("failed", failed)
    return marked.where("failed is null").drop("failed"), marked.where("failed is not null")
