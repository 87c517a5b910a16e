"""Exact duplicates by content sort: range partitions of normalised text, external sort, neighbour comparison.

Spark samples the splitters of the range partitions and sorts each partition with spilling. The range key is bounded
(a prefix, a hash, the row's rank within its text), so splitters stay small, and the rank splits a text that a third
of all rows hold over many partitions. Runs that continue in the next partition are stitched by comparing their
whole texts: two rows a partition. Different texts that share head and hashes, 96 bits, would have to meet at a
partition's edge for a run to be missed there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

#: Deleted before comparison: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
_OUT = "doc_id long, pid int, run long, first boolean, keep_id long, group_size long, n_cp long, text_sha256 string, edge string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pid", pa.int32()), ("run", pa.int64()), ("first", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_cp", pa.int64()), ("text_sha256", pa.string()), ("edge", pa.string())])


def normalised(text_col: str = "text"):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each with the keeper and size of its run of equal texts."""
    pid, run, ids, text, n_cp, rows = TaskContext.get().partitionId(), 0, [], None, 0, []

    def close(last: bool) -> None:
        edge = text if run == 0 or last else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows.extend((i, pid, run, k == 0, ids[0], len(ids), n_cp, sha, edge if k == 0 else None) for k, i in enumerate(ids))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        rows.clear()
        return out

    for batch in batches:
        for i, now, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "norm", "n_cp")), strict=True):
            if now != text:
                if text is not None:
                    close(False)
                    run += 1
                    if len(rows) > 20_000:
                        yield flush()
                ids, text, n_cp = [], now, n
            ids.append(i)
    if text is not None:
        close(True)
        yield flush()


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; null is the empty text,
    and empty texts equal each other. Of equal texts the row with the most code points in the original stays, then
    the smallest id (null ids last). Rows that repeat id and text are a group like any other: exactly one of them is
    kept. Other columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "content-sort")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"))
    rows = rows.withColumns({"head": F.substring("norm", 1, 16), "hash": F.xxhash64("norm"), "hash2": F.hash("norm")})
    order = [F.desc("n_cp"), F.asc_nulls_last("doc_id")]
    dealt = rows.repartitionByRange("head", "hash", "hash2", *order).sortWithinPartitions("head", "hash", "hash2", "norm", *order)
    found = scratch.put(dealt.select("doc_id", "norm", "n_cp").mapInArrow(_runs, _OUT), "runs")

    # A run at a partition's edge may go on in the next one: two rows a partition, compared as whole texts.
    edges = found.where("edge is not null").groupBy("edge").agg(F.min(F.struct(-F.col("n_cp"), F.col("keep_id").isNull().alias("no_id"), "keep_id", "pid", "run")).alias("best"), F.sum("group_size").alias("whole"), F.collect_list(F.struct("pid", "run")).alias("parts"))
    stitched = edges.where(F.size("parts") > 1).select(F.explode("parts").alias("part"), "best", "whole").select("part.pid", "part.run", F.col("best.keep_id").alias("best_id"), "whole", ((F.col("best.pid") == F.col("part.pid")) & (F.col("best.run") == F.col("part.run"))).alias("leads"))
    out = found.join(stitched, ["pid", "run"], "left")  # at most two rows a partition are stitched
    return out.select(F.col("doc_id").alias(id_col), F.when(F.col("whole").isNull(), F.col("keep_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("whole", "group_size").alias("group_size"), (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"), "text_sha256")
