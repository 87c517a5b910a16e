"""The corpus filter, its statistics, and small predicates used throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import strip
from larder.schemas import CATEGORIES, LANGUAGES


def corpus_predicate(languages: tuple[str, ...] = LANGUAGES, categories: tuple[str, ...] = CATEGORIES, min_length: int = 10, scanned: bool = True) -> Column:
    """Not obsolete, no quality errors, a long enough text in a wanted language, a wanted category, ever scanned."""
    texts = F.map_filter(F.col("ingredients_text"), lambda k, v: k.isin(*languages) & (F.length(strip(v)) >= min_length))
    keep = ~F.coalesce(F.col("obsolete"), F.lit(False)) & (F.coalesce(F.size("data_quality_errors"), F.lit(0)) <= 0)
    keep &= F.coalesce(F.size(texts), F.lit(0)) > 0
    keep &= F.coalesce(F.arrays_overlap("categories_tags", F.array(*map(F.lit, categories))), F.lit(False))
    return keep & (F.coalesce("unique_scans_n", F.lit(0)) > 0) if scanned else keep


def stratum(unknown: Column) -> Column:
    """``unknown`` above 0, ``control`` at 0 or null; a negative count is in neither."""
    return F.when(unknown > 0, "unknown").when(F.coalesce(unknown, F.lit(0)) == 0, "control")


def selection_stats(raw: DataFrame, keep: Column) -> DataFrame:
    """One row: total, matched, matched with unknown ingredients, per grade or without label."""
    return raw.agg(F.count("*").alias("total"), F.count_if(keep).alias("matched"), F.count_if(keep & (F.col("unknown_ingredients_n") > 0)).alias("unknown"), *[F.count_if(keep & (F.col("nutriscore_grade") == g)).alias(f"grade_{g}") for g in "abcde"])


def texts_by_language(raw: DataFrame, keep: Column) -> DataFrame:
    """Products per language of their texts; one with several counts for each."""
    return raw.where(keep).select(F.explode(F.map_keys("ingredients_text")).alias("lang")).groupBy("lang").count()


def drop_rare_classes(frame: DataFrame, target: str, least: int = 100) -> DataFrame:
    rare = frame.groupBy(target).count().where(F.col("count") < least).select(target)
    return frame.where(F.col(target).isNotNull()).join(rare, target, "left_anti")


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def changed(now: DataFrame, known: DataFrame, key: str = "code", value: str = "profile_hash") -> DataFrame:
    """Rows that are new, or whose value differs from the known one."""
    old = known.select(key, F.col(value).alias("__old"))
    return now.join(old, key, "left").where(~F.col(value).eqNullSafe(F.col("__old"))).drop("__old")
