"""Sinks: tables and record files below the session's shared folder, written whole and read back typed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import shared_folder


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/larder-core/{name}-{uuid.uuid4().hex}"


def write_table(frame: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Parquet, partitioned by columns if named; returns what was written."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_json(frame: DataFrame, path: str, append: bool = False) -> DataFrame:
    """JSON lines, overwritten or appended to; null fields are written too, so that a reread is whole."""
    frame.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
    return frame.sparkSession.read.schema(frame.schema).json(path)


def score_name(system: str) -> str:
    """A system's name as a file name."""
    return system.replace(":", "_").replace("/", "_")


def markdown(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One row, report: a small table as Markdown, whole and in that order; an empty one has its head alone."""
    columns = [c for c, _ in rows.dtypes]
    cell = lambda c, kind: F.coalesce(F.format_string("%.4f", c) if kind in ("double", "float") else F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, kind) for c, kind in rows.dtypes]), F.lit(" |\n"))
    lines = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("line"))))
    head = f"# {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.agg(lines.alias("lines")).select(F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("report"))


def _without_password(piece):
    """What stands before an @: its last word, if that is ``scheme://user:password``, loses the password."""
    word = F.regexp_extract(piece, r"\S*$", 0)
    scheme = F.locate("://", word)
    info = F.when(scheme > 0, F.substring(word, scheme + 3, F.length(word)))
    user = F.substring_index(info, ":", 1)
    named = (F.length(user) > 0) & ~user.contains("/") & (F.length(info) > F.length(user) + 1)
    kept = F.substring(piece, F.lit(1), F.length(piece) - F.length(info) + F.length(user))
    return F.when(named, F.concat(kept, F.lit(":***"))).otherwise(piece)


def redact(text, secrets: list[str]):
    """Secrets, and passwords within connection strings, as ***."""
    for secret in filter(None, secrets):
        text = F.replace(text, F.lit(secret), F.lit("***"))
    pieces = F.split(text, "@")
    return F.array_join(F.transform(pieces, lambda piece, k: F.when(k < F.size(pieces) - 1, _without_password(piece)).otherwise(piece)), "@")
