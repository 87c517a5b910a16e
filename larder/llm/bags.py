"""Ranked lexical search by bag deduplication: equal bags of words are scored once.

Documents are restricted to the words that items ask for. Those with the same term frequencies and the same length
figure m score alike for every item, so they form a class: a hash deals them out and the whole vectors decide. Classes
are scored against the items in blocks of matrices, and the best classes are expanded to their documents by ascending
id. A class can never give more than ``k`` documents to an item, so its ``k`` smallest ids say all there is to say.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

#: Words of the items that are searched for at a time; their vocabulary goes to every task (about 100 bytes a word).
ITEM_WORDS = 400_000
#: Classes, and items, whose scores are in memory at once.
CLASSES, ITEMS = 256, 256
#: A-Z to small letters, digits and everything beyond ASCII as they are, the rest to spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_FOLD).split()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(terms(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])


def _bags(vocabulary):
    """Rows (id, n, tids, tfs): the number of terms, and term frequencies within the vocabulary by ascending term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, ns, tids, tfs = [], [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(terms(text))
                bag = sorted((known[t], tf) for t, tf in counts.items() if t in known)
                ids.append(i)
                ns.append(sum(counts.values()))
                tids.append([t for t, _ in bag])
                tfs.append([tf for _, tf in bag])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, ns, tids, tfs), kinds, strict=True)], names=["id", "n", "tids", "tfs"])

    return run


class Asked:
    """Items as sorted postings: for each term the items that ask for it, with weight times repeats."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        asked = [(t, k, int(weights[t]) * r) for k, own in enumerate(items) for t, r in Counter(own).items()]
        self.n = len(items)
        self.term, self.item, self.weight = (np.array(c, np.int64) for c in zip(*sorted(asked), strict=True))

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first item, terms that its block asks for, weights by term and item), ITEMS items at a time."""
        for first in range(0, self.n, ITEMS):
            own = (self.item >= first) & (self.item < first + ITEMS)
            used, row = np.unique(self.term[own], return_inverse=True)
            matrix = np.zeros((len(used) + 1, min(ITEMS, self.n - first)), np.int64)  # the last row is of other terms
            matrix[row, self.item[own] - first] = self.weight[own]
            yield first, used, matrix


def _scores(tids: np.ndarray, parts: np.ndarray, starts: np.ndarray, used: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums of weight times part, by class (starts, none empty) and item."""
    at = np.minimum(np.searchsorted(used, tids), len(used) - 1)
    at = np.where(used[at] == tids, at, len(used))
    return np.add.reduceat(matrix[at] * parts[:, None], starts, axis=0)


def _ranked(asked, k: int):
    """Rows (item, score, no_id, id): the task's k best documents of every item, ties by ascending id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Asked = asked.value
        best: list[list[tuple]] = [[] for _ in range(items.n)]
        for batch in batches:
            for at in range(0, batch.num_rows, CLASSES):
                some = batch.slice(at, CLASSES)
                lists, m = some.column("tids"), some.column("m").to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                tids, tf = lists.flatten().to_numpy(), some.column("tfs").flatten().to_numpy().astype(np.int64)
                parts = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, size))
                starts, members = np.cumsum(size) - size, some.column("members")
                for first, used, matrix in items.blocks():
                    scores = _scores(tids, parts, starts, used, matrix)
                    for j in range(scores.shape[1]):
                        held = best[first + j]
                        least = max(1, held[-1][0] * -1) if len(held) == k else 1
                        able = np.flatnonzero(scores[:, j] >= least)
                        if len(able) > k:  # beyond the k best scores, ties aside, no class can matter
                            cut = np.partition(scores[able, j], len(able) - k)[len(able) - k]
                            able = able[scores[able, j] >= cut]
                        if len(able):
                            new = [(-int(scores[c, j]), x["no_id"], x["id"] or 0) for c in able for x in members[int(c)].as_py()]
                            best[first + j] = heapq.nsmallest(k, held + new)
        rows = [(item, -s, no_id, None if no_id else i) for item, held in enumerate(best) for s, no_id, i in held]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["item", "score", "no_id", "id"])

    return run


def _search(scratch: Scratch, docs: DataFrame, items: list[Row], k: int) -> DataFrame:
    """Rows (item: place in items, rank, id, score) of one block of items, all with terms."""
    spark = docs.sparkSession
    own = [terms(r["text"]) for r in items]
    vocabulary = {t: n for n, t in enumerate(sorted({t for ts in own for t in ts}))}
    sent = spark.sparkContext.broadcast(vocabulary)
    bags = scratch.put(docs.mapInArrow(_bags(sent), "id long, n long, tids array<int>, tfs array<int>").where("n > 0"), "bags")
    total = bags.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = dict(bags.select(F.explode("tids").alias("t")).groupBy("t").count().collect())  # a number for each term of the items
    weights = np.array([math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)

    # Classes: dealt out by a hash, told apart by whole vectors and m; of their members the k smallest ids.
    m = F.expr(f"100 - 25 + ((25 * n * {total['N']}L) div {max(1, total['L'])}L)")
    found = bags.where(F.size("tids") > 0).select("id", F.col("id").isNull().alias("no_id"), m.alias("m"), "tids", "tfs").withColumn("hash", F.xxhash64("tids", "tfs", "m"))
    vector = ["hash", "m", "tids", "tfs"]
    first = F.row_number().over(Window.partitionBy(*vector).orderBy("no_id", "id"))
    members = found.withColumn("nth", first).where(F.col("nth") <= k)
    classes = scratch.put(members.groupBy(*vector).agg(F.sort_array(F.collect_list(F.struct("no_id", "id"))).alias("members")).drop("hash"), "classes")
    scratch.drop(bags)

    asked = spark.sparkContext.broadcast(Asked([[vocabulary[t] for t in ts] for ts in own], weights))
    ranked = classes.mapInArrow(_ranked(asked, k), "item int, score long, no_id boolean, id long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 20, item_words: int = ITEM_WORDS) -> DataFrame:
    """Rows (item_col, rank, id_col, score): each item's k best documents with a score above 0, ties by ascending id.

    Terms are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased, over whole texts.
    With N documents that have terms, L terms in all, n of one document, df documents with a term and tf of it in one:
    weight w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + (25 n N) div L, and a score sums
    w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, in 64-bit integers.

    Null and empty texts have no terms: such documents are found by no item and count for nothing, such items find
    nothing. Each row is a document, and each row of items an item, of its own, also under a repeated id; null ids come
    after all others of equal score. Other columns are ignored, whatever their names; an empty table on either side
    gives no rows. Items are searched for in blocks of about item_words words or one item, so that what is sent to the
    tasks stays small however many there are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bags")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = scratch.put(asked.mapInArrow(_lengths, f"item_id {kind}, text string, n long").where("n > 0"), "items")
    blocks = -(-(asked.agg(F.sum("n")).first()[0] or 0) // item_words)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    out = []
    for b in range(blocks):
        own = asked.where(block == b).select("item_id", "text").collect()  # about item_words words
        if own:
            names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(own)], f"item int, {item_col} {kind}")
            out.append(scratch.put(_search(scratch, texts, own, k).join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score"), "ranked"))
    if not out:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
