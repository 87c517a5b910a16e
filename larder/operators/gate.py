"""The quality gate: current metrics of every system against a stored baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.metrics import fingerprint as gold_fingerprint
from larder.sources.sinks import write_json

#: Largest drop of a metric, in points, that still passes.
MAX_DROP = 3.0
METRICS = ("f1_ingredients", "f1_typed", "sugar_accuracy")


def snapshot(metrics: DataFrame) -> DataFrame:
    """(system, metric, value): metrics rounded to four places, half to even."""
    pairs = ", ".join(f"'{m}', bround(cast({m} as decimal(20,10)), 4)" for m in METRICS)
    return metrics.select("system", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, value)")).withColumn("value", F.col("value").cast("double"))


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline metrics with the current value, drop in points and verdict: pass, drop or missing (the system is gone)."""
    both = baseline.withColumnRenamed("value", "was").join(current.withColumnRenamed("value", "now"), ["system", "metric"], "left")
    drop = (F.col("was") - F.col("now")) * 100
    return both.withColumn("drop", drop).withColumn("verdict", F.when(F.col("now").isNull(), "missing").when(F.col("drop") > MAX_DROP, "drop").otherwise("pass"))


def run_gate(gold: int, predictions: int, baseline: DataFrame | None, current: DataFrame, fingerprint: str, baseline_fingerprint: str | None) -> tuple[str, list[str]]:
    """(outcome, reasons): skip without gold, predictions or baseline; stale if gold changed; regress or pass.

    A handful of systems times three metrics is collected.
    """
    for what, there in (("gold", gold), ("predictions", predictions), ("baseline", baseline is not None)):
        if not there:
            return "skip", [f"no {what}"]
    if fingerprint != baseline_fingerprint:
        return "stale", ["gold has changed since the baseline"]
    bad = compare(baseline, current).where("verdict <> 'pass'").orderBy("system", "metric").collect()
    return ("regress", [f"{r['system']} {r['metric']}: {r['verdict']}" for r in bad]) if bad else ("pass", [])


BASELINE = "system string, metric string, value double, products long, digest string"


def write_baseline(metrics: DataFrame, gold: DataFrame, path: str, key: str = "code") -> DataFrame:
    """The baseline that later gates hold systems against: their snapshot beside gold's fingerprint, written whole; returns what was written.

    It is only ever written by asking for it, as one that followed the metrics would guard nothing. Without gold or
    without predictions there is nothing to hold to, which is an error and leaves an older baseline as it is.
    """
    rows = snapshot(metrics)
    for what, frame in (("gold", gold), ("predictions", rows)):
        if frame.isEmpty():
            raise ValueError(f"no {what}: nothing to write a baseline from")
    return write_json(rows.crossJoin(F.broadcast(gold_fingerprint(gold, key))).select("system", "metric", "value", "products", "digest"), path)  # one row


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(baseline metrics, fingerprint of the gold they were measured on)."""
    held = spark.read.schema(BASELINE).json(path)
    first = held.select("digest").first()
    return held.select("system", "metric", "value"), first["digest"] if first else None
