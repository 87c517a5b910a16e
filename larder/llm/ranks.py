"""Ranks within classes of which one may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A class is ranked in parts of about so many rows, each by a task.
PART = 200_000


def class_ranks(rows: DataFrame, by: str, turn: str, order: list[str], part: int = PART) -> DataFrame:
    """rows with rank, from 0 within each class of by, gapless; rows must be a written table with few classes.

    A large class is dealt into parts by a hash of its order columns, so a row's rank depends on what rows there are,
    not on how they lie in files. Rows equal in all of order share a part and have a range of ranks together; where
    they alone are more than a part, they are parts of their own, dealt by turn, which numbers the rows. Ranks follow
    order within a part.
    """
    parts = rows.groupBy(by).agg(F.ceil(F.count("*") / part).cast("long").alias("__parts"))  # a row per class
    dealt = rows.join(F.broadcast(parts), by).withColumn("__equal", F.xxhash64(*order)).withColumn("__part", F.pmod("__equal", "__parts"))
    # Only a part of more than twice its size can hold such rows: fewer than rows / part of them, over all classes.
    full = dealt.groupBy(by, "__part").agg(F.count("*").alias("__n")).where(F.col("__n") > 2 * part).select(by, "__part")
    crowds = dealt.join(F.broadcast(full), [by, "__part"], "left_semi").groupBy(by, "__equal").agg(F.count("*").alias("__n")).where(F.col("__n") > part)
    crowds = crowds.select(by, "__equal", F.col("__equal").alias("__crowd"), F.ceil(F.col("__n") / part).cast("long").alias("__turns"))
    dealt = dealt.join(F.broadcast(crowds), [by, "__equal"], "left").withColumn("__turn", F.pmod(turn, F.coalesce("__turns", F.lit(1))))
    keys = ["__part", "__crowd", "__turn"]
    dealt = dealt.withColumn("__key", F.struct(*keys)).drop(*keys, "__parts", "__equal", "__turns")
    earlier = Window.partitionBy(by).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.groupBy(by, "__key").agg(F.count("*").alias("__n")).select(by, "__key", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__below"))
    nth = F.row_number().over(Window.partitionBy(by, "__key").orderBy(*order)) - 1
    return dealt.withColumn("__nth", nth).join(below, [by, "__key"]).withColumn("rank", F.col("__below") + F.col("__nth")).drop("__key", "__nth", "__below")
