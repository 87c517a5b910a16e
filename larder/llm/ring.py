"""Shards by a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

Every shard owns virtual nodes on a ring of 65,536 places; a row goes to the next node clockwise. A shard takes no
more rows than its bound; what overflows continues clockwise to the next shards that have room. The bounds add up to
the rows, so counts end at most one apart, while every row that fits stays with the shard its key names.

Rows between two nodes (an arc) share their whole way round the ring, so overflow is planned on the counts of arcs:
``shards * replicas`` numbers, however many rows there are.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.ranks import class_ranks
from larder.llm.scratch import Scratch

PLACES = 1 << 16


def arcs(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, clockwise; of nodes on one place the lowest shard stays."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(replicas):
            taken.setdefault(int.from_bytes(hashlib.sha256(f"{shard}:{k}".encode()).digest()[:8], "big") % PLACES, shard)
    return sorted(taken.items())


def bounds(home: list[int], rows: int) -> list[int]:
    """Rows that each shard may take: a division without rest, the rest to those that most rows name."""
    least, rest = divmod(rows, len(home))
    more = set(sorted(range(len(home)), key=lambda s: (-home[s], s))[:rest])
    return [least + (s in more) for s in range(len(home))]


def overflow(nodes: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from rank, to rank, shard, first slot) that place every arc's rows within the bounds."""
    home = [0] * shards
    for (_, shard), n in zip(nodes, counts, strict=True):
        home[shard] += n
    room, used, left = bounds(home, sum(counts)), [0] * shards, [0] * len(nodes)
    ways = []
    for k in range(len(nodes)):
        ways.append(list(dict.fromkeys(nodes[(k + j) % len(nodes)][1] for j in range(len(nodes)))))
    pieces = []
    for step in range(shards):
        for arc, way in enumerate(ways):
            if step < len(way) and (take := min(counts[arc] - left[arc], room[way[step]] - used[way[step]])) > 0:
                pieces.append((arc, left[arc], left[arc] + take, way[step], used[way[step]]))
                left[arc] += take
                used[way[step]] += take
    return pieces


def _ring(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """(place, arc, home_shard) of all PLACES: the next node clockwise, made by Spark from the nodes' hashes as ``arcs`` does."""
    names = spark.range(shards * replicas).select((F.col("id") / replicas).cast("int").alias("shard"), (F.col("id") % replicas).alias("k"))
    digest = F.sha2(F.concat_ws(":", F.col("shard").cast("string"), F.col("k").cast("string")), 256)
    nodes = names.select("shard", F.conv(F.substring(digest, 13, 4), 16, 10).cast("int").alias("place")).groupBy("place").agg(F.min("shard").alias("shard"))
    nodes = nodes.withColumn("arc", F.row_number().over(Window.orderBy("place")) - 1)  # shards * replicas rows
    first = nodes.groupBy().agg(F.min_by("shard", "place").alias("first_shard"))
    at = spark.range(PLACES).select(F.col("id").cast("int").alias("place")).join(nodes, "place", "left")
    ahead = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)  # PLACES rows, always
    next_node = F.last(F.when(F.col("arc").isNotNull(), F.struct("arc", "shard")), ignorenulls=True).over(ahead)
    return at.select("place", next_node.alias("n")).crossJoin(first).select("place", F.coalesce("n.arc", F.lit(0)).alias("arc"), F.coalesce("n.shard", "first_shard").alias("home_shard"))  # one row


def ring_shards(docs: DataFrame, shards: int = 40, replicas: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 the unsigned CRC-32 of those bytes. law is
    ``rows``: counts of shards are at most one apart. home_shard is where the ring alone would put the row; slot
    counts a shard's rows from 0 without gaps; grown_shard is null under this law. A null id is a key like any other,
    placed by its text; rows that repeat an id share a home and are told apart by rank alone, however many they are;
    null texts are empty. Other columns of docs are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ring")
    nodes = arcs(shards, replicas)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumn("place", F.pmod("key", F.lit(PLACES)).cast("int")).join(F.broadcast(_ring(spark, shards, replicas)), "place")
    rows = scratch.put(rows.drop("place").withColumn("turn", F.monotonically_increasing_id()), "rows")

    counted = dict(rows.groupBy("arc").count().collect())  # at most shards * replicas
    pieces = overflow(nodes, [counted.get(k, 0) for k in range(len(nodes))], shards)
    kind = "array<struct<arc:int,lo:bigint,hi:bigint,to:int,slot0:bigint>>"
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(("arc", "lo", "hi", "to", "slot0"), p, strict=True)) for p in pieces])), kind)).alias("p")).select("p.*")
    # A piece ends with an arc or with a shard, or passes a full shard by: at most shards * (arcs + shards) rows.
    placed = class_ranks(rows, "arc", "turn", ["key", "doc_id", "size", "text_crc32"]).join(F.broadcast(plan), "arc").where("rank >= lo and rank < hi")
    return placed.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").alias("shard"), (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
