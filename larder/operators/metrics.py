"""Scores of predictions against gold: sets, counts, classes, retrieval, citations, agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.numbers import f1, median, ratio


def set_counts(gold: Column, predicted: Column) -> dict[str, Column]:
    """True and false positives and false negatives of one row's sets; null is the empty set."""
    none = F.array().cast("array<string>")
    g, p = F.array_distinct(F.coalesce(gold, none)), F.array_distinct(F.coalesce(predicted, none))
    return {"tp": F.size(F.array_intersect(g, p)), "fp": F.size(F.array_except(p, g)), "fn": F.size(F.array_except(g, p))}


def micro_prf(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 over rows, of each group; 0 / 0 is 0."""
    counted = rows.withColumns(set_counts(F.col(gold), F.col(predicted)))
    sums = counted.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def joined_predictions(gold: DataFrame, predictions: DataFrame, key: str = "code", position: str = "position") -> DataFrame:
    """Every gold row with its prediction; a later duplicate wins, predictions outside gold are left out."""
    last = predictions.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))).where("__nth = 1").drop("__nth", position)
    return gold.join(last, key, "left")


def count_score(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Exact share, mean absolute error, rows missed wholly, rows whose gold is 0; a missing prediction counts 0."""
    p = F.coalesce(predicted, F.lit(0))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.avg((F.col(gold) == p).cast("double")), F.lit(0.0)).alias("exact"),
        F.coalesce(F.avg(F.abs(F.col(gold) - p).cast("double")), F.lit(0.0)).alias("mae"),
        F.count_if((F.col(gold) > 0) & (p == 0)).alias("missed_all"),
        F.count_if(F.col(gold) == 0).alias("gold_zero"),
    )


def with_total(rows: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Aggregates of every group and, with a null group, of everything, in one pass."""
    return rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(*aggregates)


def latency(rows: DataFrame, column: str = "latency_s") -> DataFrame:
    """Median latency of rows that took any time."""
    return rows.where(F.col(column) > 0).agg(median(F.col(column)).alias("median_s"))


def classes(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label of truth or prediction: tp, fp, fn, precision, recall, f1."""
    pairs = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).count()
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("count")).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col("t") == F.col("p"), 0).otherwise(F.col("count")).alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("s")).select("s.*")
    sums = sides.where("label is not null").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_f1(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Unweighted mean of F1 over the labels of truth and prediction."""
    return classes(rows, truth, predicted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A row for each pair of labels, pairs that never occur with 0. The label set is bounded by the classes."""
    pairs = rows.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    labels = pairs.select(F.explode(F.array("truth", "predicted")).alias("label")).where("label is not null").distinct().agg(F.array_sort(F.collect_list("label")).alias("labels"))
    grid = labels.select(F.explode("labels").alias("truth"), "labels").select("truth", F.explode("labels").alias("predicted"))
    return grid.join(pairs, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def majority(frame: DataFrame, target: str) -> DataFrame:
    """Most frequent class and its share, ties by label; an empty frame gives no row."""
    per = frame.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "label").limit(1)
    return top.crossJoin(F.broadcast(per.agg(F.sum("n").alias("total")))).select("label", (F.col("n") / F.col("total")).alias("share"))  # one row


def retrieval_scores(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: recall = |expected and found| / |expected|, precision = the same over what was found."""
    found = hits.groupBy("query").agg(F.collect_set("code").alias("found"))
    both = expected.join(found, "query", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect("expected", "found"))
    return both.select("query", ratio(hit, F.size("expected")).alias("recall"), ratio(hit, F.size("found")).alias("precision"))


def grounding(answers: DataFrame) -> DataFrame:
    """answers with cited, invented (cited, but no source) and grounded share; answers has cited and sources arrays."""
    out = answers.withColumn("invented", F.array_except("cited", "sources"))
    return out.withColumn("grounded_share", ratio(F.size("cited") - F.size("invented"), F.size("cited")))


def repeated_calls(steps: Column) -> Column:
    """Calls less distinct calls; a step is (action, arguments), arguments a map whose order doesn't matter."""
    calls = F.transform(steps, lambda s: F.concat_ws("|", s["action"], F.array_join(F.transform(F.array_sort(F.map_entries(s["arguments"])), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")))
    return F.size(calls) - F.size(F.array_distinct(calls))


def agent_report(runs: DataFrame, outside: str = "out_of_scope") -> DataFrame:
    """Share of right first tools (without out-of-scope questions), answers reached, repeats, mean steps and tokens."""
    right = F.element_at(F.col("steps.action"), 1) == F.col("expects_tool")
    inside = F.col("kind") != outside
    return runs.agg(
        F.count("*").alias("runs"),
        ratio(F.count_if(inside & F.coalesce(F.when(F.size("steps") > 0, right), F.lit(False))), F.count_if(inside)).alias("right_tool"),
        ratio(F.count_if(F.col("stop_reason") == "answer"), F.count("*")).alias("answered"),
        F.coalesce(F.sum(repeated_calls(F.col("steps"))), F.lit(0)).alias("repeats"),
        F.coalesce(F.avg(F.size("steps")), F.lit(0.0)).alias("mean_steps"),
        F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("mean_tokens"),
    )


#: Gold is labelled by hand; above so many codes a fingerprint is refused, as its digest is one task's work.
MAX_GOLD = 1_000_000


def fingerprint(gold: DataFrame, key: str = "code") -> DataFrame:
    """(products, digest): first 12 hex digits of the SHA-256 of the sorted codes, one a line. At most MAX_GOLD codes."""
    codes = gold.select(F.col(key).cast("string").alias("code"))
    if (n := codes.limit(MAX_GOLD + 1).count()) > MAX_GOLD:
        raise ValueError(f"{n} codes or more; gold has at most {MAX_GOLD}")
    return codes.agg(F.count("*").alias("products"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("code")), "\n"), 256), 1, 12).alias("digest"))
