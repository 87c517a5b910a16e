"""Global ranks and order statistics without gathering a group: range partitions, counts, offsets.

Rows are dealt out by ranges of the order and written, so that later steps agree on the ranges. Each range is ranked by
itself; what lies below it comes from the counts of ranges, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.sinks import workspace, write_table


def _ranges(frame: DataFrame, by: list[str], order: list[str], weight: Column) -> tuple[DataFrame, DataFrame]:
    """frame with __range, and (by, __range, __below): the weight of a group's earlier ranges."""
    dealt = frame.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    dealt = write_table(dealt, workspace(frame.sparkSession, "ranges"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, "__range").agg(F.sum(weight).alias("__rows"))
    return dealt, counts.withColumn("__below", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).drop("__rows")


def _beside(frame: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """frame joined to other on keys, where nulls equal nulls."""
    named = other.toDF(*[f"__{c}" if c in keys else c for c in other.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return frame.join(named, on, how).drop(*[f"__{k}" for k in keys])


def global_rank(frame: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """frame with its rows' ranks in that order, from 1, nulls first; which of equal rows comes first is open."""
    dealt, below = _ranges(frame, [], order, F.lit(1))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__nth", within).join(below, "__range").withColumn(name, (F.col("__below") + F.col("__nth")).cast("long")).drop("__range", "__nth", "__below")


def order_statistics(frame: DataFrame, by: list[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """One row per group: by, and by name the value at a rank from 1, told from the group's number of values ``n``.

    Nulls don't count; a group without values has no row. Equal values are counted before anything is ordered.
    """
    counted = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__times"))
    dealt, below = _ranges(counted, by, ["__value"], F.col("__times"))
    sizes = dealt.groupBy(*by).agg(F.sum("__times").alias("n"))
    within = F.sum("__times").over(Window.partitionBy(*by, "__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0))
    placed = _beside(_beside(dealt.withColumn("__to", within), below, [*by, "__range"]), sizes, by)
    upto = F.col("__below") + F.col("__to")
    held = lambda rank: (rank <= upto) & (rank > upto - F.col("__times"))
    return placed.groupBy(*by).agg(*[F.max(F.when(held(rank), F.col("__value"))).alias(name) for name, rank in ranks.items()])


def lower_middle() -> Column:
    return F.floor((F.col("n") + 1) / 2)


def upper_middle() -> Column:
    """sorted[n // 2]."""
    return F.floor(F.col("n") / 2) + 1


def at_share(share: float) -> Column:
    """sorted[min(int(share * n), n - 1)]."""
    return F.least(F.floor(F.col("n") * share), F.col("n") - 1) + 1


def medians(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of each group, null where a group has no values: the mean of its two middle values."""
    middle = order_statistics(frame, by, value, {"__a": lower_middle(), "__b": upper_middle()})
    found = middle.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias("median"))
    return _beside(frame.select(*by).distinct(), found, by, "left")
