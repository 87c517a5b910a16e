"""An approximate vector index: a trained coarse quantiser, posting lists by centroid, and signatures that prune them.

Every vector lies in the list of its nearest centroid, and carries a signature, the signs of its products with fixed
random directions. A search asks for the lists whose centroids are nearest to the query; of their members only those
whose signature differs from the query's in few enough bits are compared by their vectors. How many lists (``probes``)
and how many bits (``cut``) are the two dials between speed and recall. With embeddings that cluster a few lists do;
vectors without structure need most of them, and there the signatures do the pruning.

``search_filtered`` never comes short: queries that lack hits under the filter, and they alone, ask further lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources import sinks as K

#: Queries of a block; a search has at least CELLS cells a block, and more where one would hold over CELL vectors.
BLOCK, CELLS, CELL = 4096, 16, 1 << 18
#: The quantiser is sent to every task, so both it and the sample it is fitted on are bounded.
MAX_LISTS, MAX_SAMPLE_BYTES = 1024, 64 << 20
_ASKED = "query long, vector array<float>, signature binary, lists array<int>"


@dataclass(frozen=True)
class Quantiser:
    """centroids (list, place) and directions (place, bit) of unit length; cut: the most bits by which signatures may differ."""

    centroids: np.ndarray
    directions: np.ndarray
    cut: int

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.directions > 0, axis=1)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; all vectors have the same number of places."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(whole), -1)
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-30)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each signature of a and each of b."""
    wide = lambda x: np.ascontiguousarray(x).view(np.uint64)
    return np.bitwise_count(wide(a)[:, None, :] ^ wide(b)[None, :, :]).sum(axis=2, dtype=np.int32)


def train(vectors: DataFrame, lists: int | None = None, keep: float = 0.08, bits: int = 512, per_list: int = 64, rounds: int = 12, id_col: str = "vec_id", vector_col: str = "embedding") -> Quantiser:
    """Spherical k-means on a bounded sample; cut is set so that about ``keep`` of random pairs pass it.

    The sample is those of lowest hash of their id, per_list a list and at most MAX_SAMPLE_BYTES of them, so it is the
    same whenever it is drawn. lists defaults to twice the square root of the rows, from 16 to MAX_LISTS. bits is a
    multiple of 64. Null vectors are left out; without vectors there is one list that is never asked.
    """
    known = vectors.where(F.col(vector_col).isNotNull())
    n, width = known.agg(F.count("*"), F.max(F.size(vector_col))).first()
    if not n:
        return Quantiser(np.zeros((1, 1), np.float32), np.zeros((1, bits), np.float32), 0)
    lists = min(MAX_LISTS, max(16, round(2 * n**0.5)) if lists is None else lists, n)
    most = min(per_list * lists, MAX_SAMPLE_BYTES // (8 * width))
    share = min(1.0, 1.3 * most / n)  # a filter before the sort, so that few rows are sorted
    drawn = known.select(F.col(vector_col).alias("v"), F.xxhash64(F.col(id_col)).alias("h")).where(F.pmod("h", F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    sample = np.array([r["v"] for r in drawn.orderBy("h").limit(most).collect()], np.float32)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True) + 1e-30
    lists = min(lists, len(sample))
    random = np.random.default_rng(17)
    centroids = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = np.bincount(nearest, minlength=lists) == 0
        sums[empty] = sample[random.integers(len(sample), size=int(empty.sum()))]
        centroids = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-30)
    directions = random.normal(size=(width, bits)).astype(np.float32)
    model = Quantiser(centroids.astype(np.float32), directions, bits)
    some = model.signatures(sample[random.permutation(len(sample))[:2000]])
    apart = _differing(some[::2], some[1::2])
    return Quantiser(model.centroids, directions, int(np.quantile(apart, keep)))


def build(vectors: DataFrame, model: Quantiser, path: str, id_col: str = "vec_id", vector_col: str = "embedding", columns: tuple[str, ...] = ()) -> DataFrame:
    """The index (id, list, signature, vector, *columns) written to path in the order of lists, so that files and row groups hold few lists each.

    Null vectors are left out. Ids may repeat; columns are kept for filters.
    """
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(batch.column("vector"))
                own = np.argmax(unit @ sent.value.centroids.T, axis=1).astype(np.int32)
                signed = pa.array([s.tobytes() for s in sent.value.signatures(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), signed], names=[*batch.schema.names, "list", "signature"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(run, f"{kinds}, list int, signature binary")
    return K.write_table(placed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list"), path)


def asking(queries: DataFrame, model: Quantiser) -> DataFrame:
    """Queries (query, embedding) with their signature and all lists, nearest first; null vectors ask nothing."""
    sent = queries.sparkSession.sparkContext.broadcast(model)
    rows = queries.where("embedding is not null").select(F.col("query").cast("long").alias("query"), F.col("embedding").cast("array<float>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(batch.column("vector"))
                order = np.argsort(-(unit @ sent.value.centroids.T), axis=1, kind="stable").astype(np.int32)
                signed = pa.array([s.tobytes() for s in sent.value.signatures(unit)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, signed, pa.array(list(order), pa.list_(pa.int32()))], names=["query", "vector", "signature", "lists"])

    return rows.mapInArrow(run, _ASKED)


class _Cell:
    """The queries of one cell, and the k nearest that its vectors have shown so far; vectors pass by in batches."""

    def __init__(self, k: int, cut: int | None, skip_self: bool, n_lists: int) -> None:
        self.k, self.cut, self.skip_self, self.n_lists = k, cut, skip_self, n_lists
        self.waiting: list[pa.RecordBatch] = []  # queries, which all come before the first vector
        self.ids = np.zeros(0, np.int64)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # (query's row, id, similarity)
        self.held = 0

    def _ready(self) -> None:
        queries, self.waiting = pa.Table.from_batches(self.waiting), []
        self.ids, self.unit, self.signed = queries.column("id").to_numpy(), _unit(queries.column("vector")), _signed(queries.column("signature"))
        lists = queries.column("lists").combine_chunks()
        self.asks = np.zeros((len(self.ids), self.n_lists), bool)
        self.asks[np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        self.compared = np.zeros(len(self.ids), np.int64)

    def take(self, rows: pa.RecordBatch) -> None:
        """Rows of the cell: queries first, then vectors by list."""
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        n = int(asks.sum())
        if n:
            self.waiting.append(rows.slice(0, n))
        rows = rows.slice(n)
        if not rows.num_rows:
            return
        if self.waiting:
            self._ready()
        if not len(self.ids):
            return
        ids, unit, signed, lists = rows.column("id").to_numpy(), _unit(rows.column("vector")), _signed(rows.column("signature")), rows.column("list").to_numpy()
        for begin, end in _runs(lists):
            wanted = np.flatnonzero(self.asks[:, lists[begin]])
            if len(wanted):
                for some in np.array_split(wanted, max(1, len(wanted) * (end - begin) // 1_000_000)):
                    self._meet(some, ids[begin:end], unit[begin:end], signed[begin:end])

    def _meet(self, some: np.ndarray, ids: np.ndarray, unit: np.ndarray, signed: np.ndarray) -> None:
        able = _differing(self.signed[some], signed) <= self.cut if self.cut is not None else np.ones((len(some), len(ids)), bool)
        if self.skip_self:
            able &= self.ids[some][:, None] != ids[None, :]
        row, near = np.nonzero(able)
        self.compared[some] += np.bincount(row, minlength=len(some))
        self.found.append((some[row], ids[near], np.einsum("ij,ij->i", self.unit[some][row], unit[near], dtype=np.float64)))
        self.held += len(row)
        if self.held > 500_000 + 2 * self.k * len(self.ids):
            self._keep_best()

    def _keep_best(self) -> None:
        row, ids, sims = (np.concatenate(part) for part in zip(*self.found, strict=True))
        order = np.lexsort((ids, -sims, row))
        row, ids, sims = row[order], ids[order], sims[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.found, self.held = [(row[best], ids[best], sims[best])], int(best.sum())

    def best(self) -> pa.RecordBatch:
        """(query, id, similarity, compared), compared at a query's first row alone."""
        self._keep_best()
        row, ids, sims = self.found[0]
        first = np.arange(len(row)) == np.searchsorted(row, row)
        compared = np.where(first, self.compared[row], 0) if len(row) else row
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((self.ids[row], pa.int64()), (ids, pa.int64()), (sims, pa.float64()), (compared, pa.int64()))], names=["query", "id", "similarity", "compared"])


def _signed(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of rows with equal keys."""
    new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return list(zip([0, *new.tolist()], [*new.tolist(), len(keys[0])], strict=True))


def _meet(index: DataFrame, asked: DataFrame, k: int, cut: int | None, skip_self: bool) -> DataFrame:
    """(query, id, similarity, compared) of the k nearest of each query in each cell; asked holds (query, vector, signature, lists).

    A cell is a block of queries and several lists; its task reads the queries, then the vectors as they pass by, and
    gives one list of k hits a query, so what comes out grows with the queries and not with the lists. A list of more
    than a cell's share of the vectors is dealt over several cells by its ids. Counts of lists, at most MAX_LISTS, and
    of queries are taken first.
    """
    spark = index.sparkSession
    sizes = dict(index.groupBy("list").count().collect())  # a row a list
    n, blocks = sum(sizes.values()), asked.count() // BLOCK + 1
    cells = max(CELLS, -(-n // CELL))
    n_lists = max(sizes, default=0) + 1
    parts = F.array(*[F.lit(-(-sizes.get(i, 0) * cells // max(n, 1))) for i in range(n_lists)])
    part = lambda i: F.coalesce(F.get(parts, i), F.lit(0))
    held = F.filter("lists", lambda i: part(i) > 0)
    of_list = lambda i: F.transform(F.sequence(F.lit(0), part(i) - 1), lambda j: F.pmod(i + j, F.lit(cells)))
    left = asked.select("query", "vector", "signature", held.alias("lists")).select(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("x"), F.explode(F.array_distinct(F.flatten(F.transform("lists", of_list)))).alias("y"), F.lit(True).alias("asks"), F.lit(None).cast("int").alias("list"), F.col("query").alias("id"), "vector", "signature", "lists")
    own = F.pmod(F.col("list") + F.pmod(F.xxhash64("id"), part(F.col("list"))), F.lit(cells)).cast("int")
    right = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"), own.alias("y"), F.lit(False).alias("asks"), "list", "id", "vector", "signature", F.lit(None).cast("array<int>").alias("lists"))
    order = ["x", "y", F.desc("asks"), "list"]
    met = left.unionByName(right).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "y").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, name = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            for begin, end in _runs(x, y):
                if (x[begin], y[begin]) != name:
                    if cell:
                        yield cell.best()
                    cell, name = _Cell(k, cut, skip_self, n_lists), (x[begin], y[begin])
                cell.take(batch.slice(begin, end - begin))
        if cell:
            yield cell.best()

    return met.mapInArrow(run, "query long, id long, similarity double, compared long")


def _best(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query")
    place = F.row_number().over(own.orderBy(F.desc("similarity"), "id"))
    return found.withColumns({"rank": place, "compared": F.sum("compared").over(own)}).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, model: Quantiser, k: int, probes: int, skip_self: bool = True) -> DataFrame:
    """(query, id, similarity, rank, compared) of about the k nearest of each query; compared: vectors that it was compared with.

    queries (query, embedding) is a stated set with ids of its own. A query finds less than k only where its lists hold
    less within the cut.
    """
    asked = asking(queries, model).withColumn("lists", F.slice("lists", 1, probes))
    return _best(_meet(index, asked, k, model.cut, skip_self), k)


def search_filtered(index: DataFrame, queries: DataFrame, model: Quantiser, k: int, wanted: Column, probes: int = 4, skip_self: bool = True) -> DataFrame:
    """(query, id, similarity, rank, compared, rounds) among the vectors that are wanted: k of them, or all there are.

    The filter comes before the search. Each round doubles the lists asked, for those queries alone that lack hits; after
    the last list there is nothing left to find. Signatures don't prune here: what the filter leaves is compared.
    """
    spark = index.sparkSession
    able = index.where(wanted)
    asked = K.write_table(asking(queries, model), K.workspace(spark, "asked"))
    found, open_, first, last, number = None, asked, 0, min(probes, model.lists), 1
    while True:
        here = open_.withColumn("lists", F.slice("lists", first + 1, last - first))
        met = _meet(able, here, k, None, skip_self).withColumn("round", F.lit(number))
        met = met if found is None else found.unionByName(met)
        rows = _best(met, k).withColumn("rounds", F.max("round").over(Window.partitionBy("query")))
        found = K.write_table(rows.select("query", "id", "similarity", F.when(F.col("rank") == 1, F.col("compared")).otherwise(F.lit(0)).alias("compared"), F.col("rounds").alias("round")), K.workspace(spark, "found"))
        whole = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
        open_ = K.write_table(open_.join(whole, "query", "left_anti"), K.workspace(spark, "open"))
        if last >= model.lists or open_.isEmpty():
            return _best(found, k).withColumnRenamed("round", "rounds")
        first, last, number = last, min(2 * last, model.lists), number + 1
