"""Benchmark decontamination by winnowing: fingerprints of items and documents meet, hits are extended word by word.

A run of ``length`` words is named by the least hash of its k-grams, k being half of it: equal runs have equal names,
so no shared run is ever missed, and neighbouring runs mostly share their name, so a text keeps about two names in
seven words. Only names that an item has go on. Around each of them the runs that bear it are compared with the items'
runs as whole words, so a document is never blamed for a hash. DataFrame functions only.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

#: Between words lies everything in ASCII that is neither digit nor small letter, once A-Z are folded.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPOTS = "array<struct<name:bigint,at:int,stop:int,length:int>>"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z, and nothing else, are lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # all ASCII: lower() does the same and is quicker
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(folded, GAP), "")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))  # a second parameter of f would be taken for a place


def names(hashes: Column, length: int) -> Column:
    """The name of each run of length words: the least hash of the k-grams in it, k = length / 2 rounded up."""
    k = (length + 1) // 2
    width, n = length - k + 1, F.size(hashes)
    grams = hashes if k == 1 else F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + d) for d in range(k)]))
    least = lambda g: F.transform(F.sequence(F.lit(0), n - length), lambda j: F.least(*[F.get(g, j + d) for d in range(width)]))
    return F.when(n >= length, grams if width == 1 else _bound(grams, least)).otherwise(F.array().cast("array<bigint>"))


def _spots(hashes: Column, length: int) -> Column:
    """Stretches [at, stop) of runs under one name."""

    def stretches(named: Column) -> Column:
        n = F.size(named)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(named, j) != F.get(named, j - 1)))
        cut = lambda s: F.transform(s, lambda j, k: F.struct(F.get(named, j).alias("name"), j.alias("at"), F.coalesce(F.get(s, k + 1), n).alias("stop"), F.lit(length).alias("length")))
        return F.when(n > 0, _bound(starts, cut)).otherwise(F.array().cast(_SPOTS))

    return _bound(names(hashes, length), stretches)


def _covered(spans: Column) -> Column:
    """Words within at least one of the spans (at, length)."""
    first = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        stop = s["at"] + s["length"]
        return F.struct(F.greatest(acc["stop"], stop).alias("stop"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["stop"], s["at"]))).alias("n"))

    return F.aggregate(F.sort_array(spans), first, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, spans, items (sorted as strings), n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or the whole of an item with fewer. Words of a document inside
    any occurrence of a window are hit; spans are those occurrences (at, length), in words. items_sha256 is of the
    items' ids joined by commas.

    Null and empty texts have no words; an item without words has no window, a null item id is no name in items but
    its windows hit. Rows that repeat an id, items that repeat an id or a text, and null document ids are fine: each
    row is judged by its own text, and equal texts are judged once. Other columns are ignored, whatever their names; an
    empty table on either side gives rows without hits, or no rows. Texts are read whole. An item's short length asks
    for names of that length in every document; there are at most ``window`` lengths.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "winnowing")
    wanted = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    wanted = scratch.put(wanted.withColumn("length", F.least(F.size("words"), F.lit(window))), "items")
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect())  # at most window
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    # Of the items: the names under which runs may be theirs, and the runs themselves with the set of items that hold them.
    keyed = [_bound(hashed(F.col("words")), lambda h, n=n: F.when(F.col("length") == n, names(h, n))) for n in lengths]
    prints = scratch.put(wanted.select(F.explode(F.coalesce(*keyed)).alias("name")).distinct(), "prints") if lengths else None
    runs = wanted.select("item", F.explode(_bound(F.col("words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - F.col("length")), lambda j: F.array_join(F.slice(w, j + 1, F.col("length")), " ")))).alias("run"))
    held = runs.groupBy("run").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("holders", F.sha2(F.array_join("items", ","), 256))
    held = scratch.put(held, "runs")

    # Of the documents: names, by stretches. A text is told by its digest.
    found = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _bound(hashed(w), lambda h: F.concat(*[_spots(h, n) for n in lengths]) if lengths else F.array().cast(_SPOTS)).alias("spots"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    scanned = scratch.put(texts.select("id", "key", _bound(words(F.col("text")), found).alias("f")).select("id", "key", "f.n_words", "f.spots"), "scanned")
    if not lengths:
        prints = spark.createDataFrame([], "name bigint")

    # Stretches whose name an item has, each text once; then their runs, word for word.
    shared = scanned.select("key", F.explode("spots").alias("s")).select("key", "s.*").join(prints, "name", "left_semi")
    shared = scratch.put(shared.groupBy("key").agg(F.collect_set(F.struct("at", "stop", "length")).alias("spots")), "shared")
    # Copies go before the shuffle, and texts are shuffled at every size: what is shared grows with the documents.
    once = texts.select("key", "text").dropDuplicates(["key"]).join(shared.hint("merge"), "key")
    extended = lambda w: F.flatten(F.transform("spots", lambda s: F.transform(F.sequence(s["at"], s["stop"] - 1), lambda j: F.struct(j.alias("at"), s["length"].alias("length"), F.array_join(F.slice(w, j + 1, s["length"]), " ").alias("run")))))
    tried = once.select("key", F.explode(_bound(words(F.col("text")), extended)).alias("r")).select("key", "r.at", "r.length", "r.run")
    hits = tried.join(held.select("run", "holders"), "run").groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.sort_array(F.collect_set("holders")).alias("holders"))
    hits = scratch.put(hits.select("key", F.sort_array("spans").alias("spans"), _covered(F.col("spans")).alias("n_hit"), "holders", F.sha2(F.array_join("holders", ","), 256).alias("which")), "hits")

    # Documents that hit the same sets of items share one union of them.
    unions = hits.groupBy("which").agg(F.first("holders").alias("holders")).select("which", F.explode("holders").alias("holders"))
    unions = unions.join(held.groupBy("holders").agg(F.first("items").alias("items")), "holders").select("which", F.explode("items").alias("item"))
    unions = unions.groupBy("which").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = hits.join(unions, "which", "left").select("key", "spans", "n_hit", "items")
    nobody = F.array().cast("array<string>")
    return (
        scanned.select("id", "key", "n_words")
        .join(hits, "key", "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<at:int,length:int>>")).alias("spans"), F.coalesce("items", nobody).alias("items"))
        .withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0})
    )
