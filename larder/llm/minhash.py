"""Near-duplicate documents: banded MinHash candidates, Odd-sketch verification, exact confirmation.

A document's set holds its distinct shingles of consecutive words. MinHash samples are banded; documents that
share a band key are candidates. The same samples are folded into an Odd sketch, a bitmap of parities: the XOR of
two sketches keeps only the samples that differ, so its population count estimates high similarities precisely
without touching the sets. What the sketch leaves is confirmed on the full sets.

No bucket is written out as pairs. Equal word sequences are one class, and only classes go on. Members are tried
against the smallest and largest member of their buckets, and sketches that agree make families. Of buckets that hold
several families the members are dealt out in blocks of bounded size, and only families that meet come out of a task.
Within a family each class is confirmed against its most similar centre, which joins most of it into components; what
is left to tell is whether *different* components of one family are linked. Their members' sets are dealt out in
blocks too, pairs of blocks are compared by matrix products inside a task, and only links that join two components
come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.scratch import Scratch
from larder.llm.words import chunked, digest, grams, mix, stream, words_of

SKETCH_BITS = 512
_LONGS = SKETCH_BITS // 64


def shingle_sets(texts: list[bytes], n: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Sorted distinct shingle hashes of each text, and a digest of its whole word sequence.

    With fewer than n words the whole sequence is the one shingle; without words the set is empty.
    """
    words = words_of(texts, lower=True)
    all_grams = grams(words.hashes, n)
    sets, digests = [], []
    for i in range(len(texts)):
        lo, hi = words.first[i], words.first[i + 1]
        whole = digest(words.hashes[lo:hi])
        digests.append(whole)
        if hi == lo:
            sets.append(np.zeros(0, np.uint64))
        elif hi - lo < n:
            sets.append(np.array([whole[0]], np.int64).astype(np.uint64))
        else:
            sets.append(np.unique(all_grams[lo : hi - n + 1]))
    return sets, digests


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and Odd sketches (texts x 8 longs) of non-empty sets."""
    k = bands * rows
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    items = np.concatenate(sets)
    slope, shift = stream(5, k) | np.uint64(1), stream(6, k)
    least = np.empty((len(sets), k), np.uint64)
    for j in range(k):
        least[:, j] = np.minimum.reduceat(items * slope[j] + shift[j], starts)
    factors = stream(7, rows) | np.uint64(1)
    keys = mix((least.reshape(len(sets), bands, rows) * factors).sum(axis=2, dtype=np.uint64) + stream(8, bands))
    bit = mix(least + stream(9, k)) >> np.uint64(64 - int(math.log2(SKETCH_BITS)))
    flag, place = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    sketch = np.stack([np.bitwise_xor.reduce(np.where(place == w, flag, np.uint64(0)), axis=1) for w in range(_LONGS)], axis=1)
    return keys.view(np.int64), sketch.view(np.int64)


def sketch_similarity(differing: float, samples: int) -> float:
    """Similarity that a count of differing sketch bits stands for."""
    share = min(1 - 2 * differing / SKETCH_BITS, 1)
    return 1 - math.log(max(share, 1e-9)) / math.log(1 - 2 / SKETCH_BITS) / (2 * samples)


def most_differing(similarity: float, samples: int, sigmas: float = 6.0) -> int:
    """Differing bits that a pair of that similarity exceeds only by a deviation of so many sigmas."""
    items = 2 * samples * (1 - similarity)
    keep = (1 - 2 / SKETCH_BITS) ** items
    drawn = keep * 2 * math.sqrt(samples * similarity * (1 - similarity))
    folded = math.sqrt(SKETCH_BITS * (1 - keep * keep)) / 2
    return min(SKETCH_BITS, math.ceil(SKETCH_BITS * (1 - keep) / 2 + sigmas * math.hypot(drawn, folded)))


def _features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunked(zip(*(batch.column(c).to_pylist() for c in ("id", "text", "th")), strict=True), 1):
                sets, digests = shingle_sets([(text or "").encode() for _, text, _ in some], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sketch = signatures([sets[i] for i in full], bands, rows) if full else (np.zeros((0, bands), np.int64), np.zeros((0, _LONGS), np.int64))
                row = dict(zip(full, range(len(full)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in some], pa.int64()),
                        pa.array([th for _, _, th in some], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([sketch[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([keys[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    names=["id", "th", "n_shingles", "c0", "c1", "sketch", "bands"],
                )

    return docs.mapInArrow(run, "id long, th long, n_shingles long, c0 long, c1 long, sketch array<long>, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunked(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), 1):
                sets, _ = shingle_sets([(text or "").encode() for _, text in some], n)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.where(F.lit(100) * both >= F.lit(percent) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _differing(x: str, y: str):
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(_LONGS)])


def _candidates(pairs: DataFrame, known: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b, far) that size and sketch allow; known has (node, n_shingles, sketch)."""
    side = lambda k: known.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized & (_differing("sa", "sb") <= most)).select("a", "b", _differing("sa", "sb").alias("far"))


#: A block of a family holds about so many members, or so many shingles if that is less.
BLOCK_MEMBERS, BLOCK_SHINGLES = 128, 200_000
#: A bucket of several families and of at most SMALL_BUCKET members is tried row by row, a larger one in blocks of BUCKET_BLOCK.
SMALL_BUCKET, BUCKET_BLOCK = 32, 2048


def _alike(n: np.ndarray, sketch: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Which pairs of members size and sketch allow."""
    far = np.zeros((len(n), len(n)), np.int32)
    for w in range(_LONGS):
        far += np.bitwise_count(sketch[:, None, w] ^ sketch[None, :, w])
    return (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)) & (far <= most)


def _joined(first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Of links between labels, those that are needed to join what all of them join."""
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    found = []
    for x, y in np.unique(np.stack([first, second], axis=1), axis=0).tolist():
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((max(a, b), min(a, b)))
    return found


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _met_families(apart: DataFrame, percent: int, most: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of families of which two members in one bucket are alike; apart has (key, node, family, n_shingles, sketch, held).

    held is the bucket's number of members. Small buckets meet by a join; the members of others are dealt out in
    blocks, each pair of a bucket's blocks is a task's work, and what it gives is a forest over its families.
    """
    few = apart.where(F.col("held") <= SMALL_BUCKET)
    side = lambda k: few.select("key", F.col("family").alias(f"f{k}"), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = side("a").join(side("b"), "key").where((F.col("fa") < F.col("fb")) & sized & (_differing("sa", "sb") <= most)).select(F.col("fb").alias("a"), F.col("fa").alias("b"))

    blocks = F.ceil(F.col("held") / BUCKET_BLOCK).cast("int")
    dealt = apart.where(F.col("held") > SMALL_BUCKET).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "family", "n_shingles", "sketch")

    def run(group: pa.Table) -> pa.Table:
        family, n = (group.column(c).to_numpy() for c in ("family", "n_shingles"))
        flat = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _LONGS)
        found: list[tuple[int, int]] = []
        for lo in range(0, len(n), 512):  # a strip of rows against all
            part = slice(lo, lo + 512)
            far = np.zeros((len(n[part]), len(n)), np.int32)
            for w in range(_LONGS):
                far += np.bitwise_count(flat[part, None, w] ^ flat[None, :, w])
            open_pairs = (family[part, None] < family[None, :]) & (far <= most)
            open_pairs &= 100 * np.minimum.outer(n[part], n) >= percent * np.maximum.outer(n[part], n)
            i, j = np.nonzero(open_pairs)
            found += _joined(family[part][i], family[j])
        return _links(_joined(*np.array(found, np.int64).reshape(-1, 2).T) if found else [])

    return near.unionByName(dealt.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")).distinct()


def _block_links(members: DataFrame, sets: DataFrame, percent: int, most: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join different roots of one family; members has (node, family, root, n_shingles, sketch).

    A root with a block's worth of members has blocks of its own, and blocks of one root are not compared. The others
    share mixed blocks.
    """
    per_root = members.groupBy("family", "root").agg(F.count("*").alias("n"))
    parted = per_root.groupBy("family").agg(F.count("*").alias("roots")).where("roots > 1").select("family")
    per_root = per_root.join(parted, "family", "left_semi").withColumn("own", F.when(F.col("n") >= BLOCK_MEMBERS, F.col("root")).otherwise(F.lit(-1)))
    open_members = members.join(per_root.select("family", "root", "own"), ["family", "root"])
    sizes = open_members.groupBy("family", "own").agg(F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = scratch.put(sizes, "sizes")
    block = sizes.select("family", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x, y = block.toDF("family", "ox", "x"), block.toDF("family", "oy", "y")
    ordered = (F.col("ox") < F.col("oy")) | ((F.col("ox") == -1) & (F.col("oy") == -1) & (F.col("x") <= F.col("y")))
    met = scratch.put(x.join(y, "family").where(ordered).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = met.select("family", F.col("ox").alias("own"), F.col("x").alias("block"), "pair").union(met.select("family", F.col("oy").alias("own"), F.col("y").alias("block"), "pair")).distinct()
    dealt = open_members.join(sizes, ["family", "own"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sides, ["family", "own", "block"])
    dealt = dealt.select("pair", "node", "root", "n_shingles", "sketch").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        root, n = (group.column(c).to_numpy() for c in ("root", "n_shingles"))
        sketch = np.array(group.column("sketch").to_pylist(), np.int64).view(np.uint64)
        open_pairs = _alike(n, sketch, percent, most) & (root[:, None] < root[None, :])
        used = np.flatnonzero(open_pairs.any(axis=0) | open_pairs.any(axis=1))
        if not len(used):
            return _links([])
        lists = group.column("shingles").take(pa.array(used)).combine_chunks()
        items, where = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(used)), n[used])
        twice = np.bincount(where, minlength=len(items)) > 1
        place = np.cumsum(twice) - 1
        row, where = row[twice[where]], place[where[twice[where]]]
        common = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(where, kind="stable")
        row, where = row[order], where[order]
        for lo in range(0, int(twice.sum()), 4096):
            at, to = np.searchsorted(where, [lo, lo + 4096])
            held = np.zeros((len(used), 4096), np.float32)
            held[row[at:to], where[at:to] - lo] = 1
            common += held @ held.T
        both, total = common.astype(np.int64), n[used][:, None] + n[used][None, :]
        i, j = np.nonzero(open_pairs[np.ix_(used, used)] & (100 * both >= percent * (total - both)))
        return _links(_joined(root[used[i]], root[used[j]]))

    return dealt.groupBy("pair").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept, text_hash (xxhash64 of the text), leads.

    Documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B|. component_id is the smallest id that links reach,
    kept marks the rows that have it as their own. leads marks one text of each component, among those that have the
    smallest id: rows that don't lead can go, and no wording that is near nothing else is lost. With 32 bands of 4
    samples a linked pair shares no band with a probability of 5e-8 at 0.8 and less above; it then still joins through
    any other member.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null and empty texts have no shingles and are linked with
    nothing, not even each other; they lead. Texts of any length are read whole. Every row is a document of its own, so
    rows that repeat an id with different texts may be in different components; rows that repeat id and text get equal
    rows. A row with a null id stays alone (component_id null, kept and leads true). Other columns of docs are ignored,
    whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    features = scratch.put(_features(texts, shingle_words, bands, rows), "features")
    most = most_differing(percent / 100, bands * rows)

    # Equal word sequences are one class, which its smallest id and text stand for. Nodes are numbers in that order.
    linked = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    first = features.where(linked).groupBy("c0", "c1").agg(F.min(F.struct("id", "th")).alias("r")).select(F.col("r.id").alias("rep"), F.col("r.th").alias("rep_th"), "c0", "c1")
    order = ["rep", "c0", "c1"]
    classes = scratch.put(first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")
    one = classes.select(F.col("rep").alias("id"), F.col("rep_th").alias("th"), "c0", "c1", "node")
    reps = features.join(one, ["id", "th", "c0", "c1"]).dropDuplicates(["node"])
    banded = scratch.put(reps.select("node", F.explode("bands").alias("key")), "bands")
    known = scratch.put(reps.select("node", "id", "th", "n_shingles", "sketch"), "known")
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("held")).where("low < high")
    banded = scratch.put(banded.join(scratch.put(shared, "ends"), "key"), "shared")  # two plain tables, so that a very common key's join can be split
    stars = banded.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    stars = scratch.put(_candidates(stars, known, percent, most), "stars")
    families = components(stars, scratch)

    # Members of one bucket whose sketches agree although their centres' don't.
    placed = banded.join(families.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "held", F.coalesce("root", "node").alias("family"))
    mixed = placed.groupBy("key").agg(F.min("family").alias("x"), F.max("family").alias("y")).where("x < y").select("key")
    apart = scratch.put(placed.join(mixed, "key", "left_semi").join(known.select("node", "n_shingles", "sketch"), "node"), "apart")
    across = scratch.put(_met_families(apart, percent, most, scratch), "across")
    families = components(families.select(F.col("id").alias("a"), F.col("root").alias("b")).union(across), scratch)
    everyone = families.select(F.col("id").alias("node"), F.col("root").alias("family")).union(families.select("root", "root")).distinct()
    everyone = scratch.put(everyone.join(known, "node"), "families")
    scratch.drop(banded, apart, known)

    # The most similar centre first, then blocks of what is still apart.
    # By shuffle at every size, as members grow with the documents; copies under one id leave in the same place.
    sets = texts.hint("merge").join(everyone.select("node", "id", "th"), ["id", "th"]).dropDuplicates(["id", "th", "node"]).select("node", "text")
    sets = scratch.put(_sets(sets, shingle_words), "sets")
    best = stars.groupBy("a").agg(F.min(F.struct("far", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = components(_confirmed(best, sets, percent), scratch)
    members = everyone.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"), "n_shingles", "sketch")
    links = _block_links(scratch.put(members, "members"), sets, percent, most, scratch)
    roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(links), scratch)
    scratch.drop(sets, stars)

    own = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = own.join(classes.select(F.col("node").alias("root"), F.col("rep").alias("component_id")), "root")
    named = named.select("c0", "c1", "component_id", F.when(F.col("node") == F.col("root"), F.col("rep_th")).alias("lead_th"))
    out = features.select("id", "th", "n_shingles", *[F.when(linked, F.col(c)).alias(c) for c in ("c0", "c1")]).join(named, ["c0", "c1"], "left")
    component = F.when(F.col("c0").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    leads = F.col("c0").isNull() | (kept & F.coalesce(F.col("th") == F.col("lead_th"), F.lit(False)))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"), F.col("th").alias("text_hash"), leads.alias("leads"))
