"""Packing documents into sequences: best-fit decreasing over token counts.

A document's ids, ended by an end id, are cut into full windows and a rest. Rests are placed longest first, each into
the open sequence with the least room that still takes it; a segment tree indexed by remaining capacity finds that
sequence. Best fit only looks at lengths, and there are no more lengths than a window has tokens, so the placement is
planned for whole classes of equal length at once: the plan's size depends on the window, not on the documents.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.ranks import class_ranks
from larder.llm.scratch import Scratch


class RoomTree:
    """How many open sequences have each remaining capacity; finds the least capacity of at least some size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = self.leaves + least
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, first sequence, items a sequence, offset there) that place every item.

    lengths maps a length to its number of items; items of one length are told apart by rank.
    """
    tree, open_by_room = RoomTree(capacity), [deque() for _ in range(capacity + 1)]
    plan, sequences = [], 0

    def fill(length: int, rank: int, left: int, first: int, n: int, room: int) -> tuple[int, int]:
        """Put items into sequences first .. first + n - 1, all with that room; gives the rank after and sequences used."""
        each = room // length
        whole, rest = min(n, left // each), 0
        if whole:
            plan.append((length, rank, rank + whole * each, first, each, capacity - room))
            keep(first, whole, room - each * length)
        if whole < n and (rest := left - whole * each):
            plan.append((length, rank + whole * each, rank + whole * each + rest, first + whole, rest, capacity - room))
            keep(first + whole, 1, room - rest * length)
        return rank + whole * each + rest, whole + bool(rest)

    def keep(first: int, n: int, room: int) -> None:
        open_by_room[room].append((first, n))
        tree.add(room, n)

    for length in sorted(lengths, reverse=True):
        rank, total = 0, lengths[length]
        while rank < total:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                n = -(-(total - rank) // each)
                rank, used = fill(length, rank, total - rank, sequences, n, capacity)
                sequences += n
                continue
            first, n = open_by_room[room].popleft()
            tree.add(room, -n)
            rank, used = fill(length, rank, total - rank, first, n, room)
            if used < n:
                open_by_room[room].appendleft((first + used, n - used))
                tree.add(room, n - used)
    return plan


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE whose vocabulary the file of ranks holds; gives the ids of tokenizers' JSON of the same name."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode.encode_to_numpy(text or "", allowed_special="all"), [end_id]).astype("<u4")
                for s in range(0, len(ids), capacity):
                    piece = ids[s : s + capacity]
                    out.append((i, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)) + ((piece.astype(np.int32),) if with_ids else ()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids with with_ids.

    tokenizer_path names a file of byte-level BPE ranks. A document is its ids and then end_id; a null or empty text
    is end_id alone. Every id lies in exactly one piece: full windows, each a sequence of its own, and a rest. Offsets
    in a sequence are gapless from 0; ids_crc32 is the CRC-32 of the piece's ids as little-endian unsigned 32 bits.
    Rows that repeat an id, and null ids, are documents of their own. Other columns of docs are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = scratch.put(texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema).withColumn("turn", F.monotonically_increasing_id()), "pieces")

    # At most capacity counts, however many documents there are; the plan's size depends on them alone.
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(lengths, capacity)
    placed = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)], "length int, lo long, hi long, first long, each long, base long")

    slim = pieces.select("turn", "id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)
    ranked = class_ranks(slim, "length", "turn", ["id", "start", "ids_crc32"])
    out = ranked.join(F.broadcast(placed), "length").where("rank >= lo and rank < hi")
    nth = F.col("rank") - F.col("lo")
    return out.select(F.col("id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"), *["ids"] * with_ids)
