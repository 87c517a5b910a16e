"""Removal of repeated passages: runs of words that already start in an earlier document.

Suffix automata of reference shards give matching statistics; every maximal span above the length threshold goes.

``remove_reference_spans`` is the plain form: bounded reference texts become automata that are broadcast. Against a
whole corpus the reference is everything with a smaller id, which no broadcast can hold, so there
(``remove_repeats``) the shards are dealt out instead: the windows of a document are named by their least word
gram, equal windows have equal names, and each name is a shard of its own that holds the different passages under
it. A document's passage only ever meets the automaton of its own shards, which alone says where its windows start first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.automaton import SuffixAutomaton
from larder.llm.scratch import Scratch
from larder.llm.words import chunked, digest, grams, mix, words_of

#: Words of the grams that name a window; where too many passages share a name, longer grams name them anew.
GRAM, LONG_GRAM = 16, 40


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def named_runs(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one name: names, first windows, lengths (at most window - gram + 1)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    width = window - gram + 1
    name = _slide(grams(hashes, gram), width)
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    length = np.diff(np.append(start, len(name)))
    if length.max() > width:  # texts that repeat themselves
        cut = [np.arange(s, s + n, width) for s, n in zip(start, length, strict=True)]
        start = np.concatenate(cut)
        length = np.diff(np.append(start, len(name)))
    return name[start].view(np.int64), start.astype(np.int32), length.astype(np.int32)


def sha256_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunked(zip(*(batch.column(k).to_pylist() for k in ("id", "text", "th")), strict=True), 1):
                texts = [(t or "").encode() for _, t, _ in some]
                words = words_of(texts)
                own = [words.hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
                digests, runs = [digest(x) for x in own], [named_runs(x, window, gram) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in some], pa.int64()),
                        pa.array([th for _, _, th in some], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([sha256_of(t.split()) for t in texts], pa.string()),
                        pa.array([r[0] for r in runs], pa.list_(pa.int64())),
                        pa.array([r[1] for r in runs], pa.list_(pa.int32())),
                        pa.array([r[2] for r in runs], pa.list_(pa.int32())),
                    ],
                    names=["id", "th", "c0", "c1", "n_words", "whole_sha256", "names", "starts", "lengths"],
                )

    return run


def _passages(window: int, long_gram: int):
    """Rows (key, passage, id, th, starts, n) of a document's shared runs; a passage that it repeats is one row.

    A run's level says how its key is made: 0 its name, 1 the names of longer grams in it, 2 each window by itself.
    """

    def fingerprint(whole: np.ndarray) -> int:
        """Of the windows' hashes in order, so of all words of a passage."""
        return int(mix(whole.view(np.uint64) * np.arange(3, 2 * len(whole) + 3, 2, dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("id", "text", "th", "runs")), strict=True)
            for some in chunked(rows, 1):
                words = words_of([(t or "").encode() for _, t, _, _ in some])
                out: list[tuple] = []
                for k, (i, _, th, runs) in enumerate(some):
                    own = words.hashes[words.first[k] : words.first[k + 1]]
                    whole = grams(own, window).view(np.int64)
                    held: dict[tuple, list[int]] = {}
                    for r in runs:
                        n, level = r["n"], r["level"]
                        for s in r["starts"]:
                            if level == 0:
                                held.setdefault((r["name"], fingerprint(whole[s : s + n]), n), []).append(s)
                            elif level == 1:
                                for name, d, m in zip(*(x.tolist() for x in named_runs(own[s : s + n + window - 1], window, long_gram)), strict=True):
                                    held.setdefault((name, fingerprint(whole[s + d : s + d + m]), m), []).append(s + d)
                            else:
                                for d, h in enumerate(whole[s : s + n].tolist()):
                                    held.setdefault((h, h, 1), []).append(s + d)
                    out += [(key, passage, i, th, starts, n) for (key, passage, n), starts in held.items()]
                if out:
                    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "passage", "id", "th", "starts", "n"])

    return run


def _wording(window: int):
    """Rows (key, passage, first_id, words) with the word hashes of passages that some document holds for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("text", "held")), strict=True)
            for some in chunked(rows, 0):
                words = words_of([(t or "").encode() for t, _ in some])
                out = []
                for k, (_, held) in enumerate(some):
                    own = words.hashes[words.first[k] : words.first[k + 1]].view(np.int64)
                    out += [(p["key"], p["passage"], p["first_id"], own[p["start"] : p["start"] + p["n"] + window - 1]) for p in held]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=["key", "passage", "first_id", "words"])

    return run


def _judged(window: int):
    """For rows sorted by key: each shard's automaton, and for every window of its passages the first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in ("key", "passage", "first_id", "words")), strict=True))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=["key", "passage", "firsts"])
            out.clear()
            return made

        for key, shard in groupby(rows, key=lambda r: r[0]):
            shard = list(shard)  # bounded: a name with more passages is crowded
            automaton = SuffixAutomaton()
            for _, _, first, words in shard:
                automaton.add(words, first)
            automaton.finish()
            for _, passage, _, words in shard:
                out.append((key, passage, list(automaton.owners(words, window))[window - 1 :]))
            if len(out) > 5000:
                yield flush()
        if out:
            yield flush()

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, th, text, found in zip(*(batch.column(k).to_pylist() for k in ("id", "th", "text", "found")), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for f in found:
                    for d, first in enumerate(f["firsts"]):
                        if first < i:
                            for s in f["starts"]:
                                gone[s + d] += 1
                                gone[s + d + window] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = [w for w, k in zip(words, keep, strict=True) if k]
                out.append((i, th, len(words) - len(kept), sha256_of(kept), b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)], names=["id", "th", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, crowd: int = 3000, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_sha256, and kept_text of documents that lost words.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Every word goes that is covered by ``window`` consecutive words which
    also start in a document with a smaller id; windows are judged on the input, not on what is left. kept_text is
    null where nothing was removed (the text stays as it is) and null throughout without with_text.

    Null and empty texts have no words. Texts are read whole. Rows that share an id never remove from each other; a
    null id is neither reference nor judged. Other columns of docs are ignored, whatever their names; an empty table
    gives an empty result. Names
    of more than ``crowd`` runs are told apart by longer grams, and at last window by window, which is exact as well.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    gram = min(GRAM, window)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    scanned = scratch.put(texts.mapInArrow(_scan(window, gram), "id long, th long, c0 long, c1 long, n_words long, whole_sha256 string, names array<long>, starts array<int>, lengths array<int>"), "scan")

    # Of equal word sequences only the smallest id can be a reference or lose less than everything.
    long = scanned.where(F.col("id").isNotNull() & (F.col("n_words") >= window)).dropDuplicates(["id", "th"])
    rep = long.groupBy("c0", "c1").agg(F.min("id").alias("rep"))
    long = long.join(rep.withColumnRenamed("rep", "id"), ["id", "c0", "c1"], "left_semi")
    runs = long.select("id", "th", F.explode(F.arrays_zip("names", "starts", "lengths")).alias("r"))
    runs = scratch.put(runs.select("id", "th", F.col("r.names").alias("name"), F.col("r.starts").alias("start"), F.col("r.lengths").alias("n")), "runs")
    shared = runs.groupBy("name").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("times")).where("x < y").select("name", (F.col("times") > crowd).cast("int").alias("level"))
    shared = scratch.put(shared, "shared")  # two plain tables, so that a very common name's join can be split
    mine = runs.join(shared, "name").groupBy("id", "th").agg(F.collect_list(F.struct("name", F.array("start").alias("starts"), "n", "level")).alias("runs"))
    candidates = scratch.put(texts.join(mine, ["id", "th"]).dropDuplicates(["id", "th"]), "candidates")
    scratch.drop(runs)

    keyed = "key long, passage long, id long, th long, starts array<int>, n int"
    passages = scratch.put(candidates.select("id", "text", "th", "runs").mapInArrow(_passages(window, max(gram, min(LONG_GRAM, window))), keyed), "passages")

    # Names under which too many different passages are left: window by window.
    variants = passages.groupBy("key", "passage").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("passages")).where(F.col("passages") > crowd).select("key")
    crowded = scratch.put(passages.join(variants, "key"), "crowded")
    again = crowded.groupBy("id", "th").agg(F.collect_list(F.struct(F.col("key").alias("name"), "starts", "n", F.lit(2).alias("level"))).alias("runs"))
    windows = candidates.select("id", "text", "th").join(again, ["id", "th"]).mapInArrow(_passages(window, gram), keyed)
    passages = scratch.put(passages.join(crowded.select("key").distinct(), "key", "left_anti").union(windows), "passages")
    firsts = passages.groupBy("key", "passage").agg(F.min(F.struct("id", "th", F.array_min("starts").alias("start"))).alias("x"), F.first("n").alias("n"))
    firsts = scratch.put(firsts.select("key", "passage", F.col("x.id").alias("first_id"), F.col("x.th").alias("th"), F.col("x.start").alias("start"), "n"), "firsts")
    asked = firsts.groupBy(F.col("first_id").alias("id"), "th").agg(F.collect_list(F.struct("key", "passage", "first_id", "start", "n")).alias("held"))
    wording = candidates.select("id", "th", "text").join(asked, ["id", "th"]).select("text", "held").mapInArrow(_wording(window), "key long, passage long, first_id long, words array<long>")
    judged = scratch.put(wording.repartition("key").sortWithinPartitions("key", "first_id", "passage").mapInArrow(_judged(window), "key long, passage long, firsts array<long>"), "judged")

    losing = passages.join(judged, ["key", "passage"]).where(F.exists("firsts", lambda f: f < F.col("id")))
    found = losing.groupBy("id", "th").agg(F.collect_list(F.struct("starts", "firsts")).alias("found"))
    cut = candidates.select("id", "th", "text").join(found, ["id", "th"]).mapInArrow(_cut(window), "id long, th long, n_removed long, kept_sha256 string, kept_text string")
    cut = scratch.put(cut if with_text else cut.withColumn("kept_text", F.lit(None).cast("string")), "cut")
    scratch.drop(candidates, passages)

    out = scanned.select("id", "th", "c0", "c1", "n_words", "whole_sha256").join(rep, ["c0", "c1"], "left").join(cut, ["id", "th"], "left")
    copy = F.col("rep").isNotNull() & (F.col("rep") < F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(sha256_of([]))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("") if with_text else F.lit(None).cast("string")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def reference_automata(references: DataFrame, text_col: str = "text", shard_words: int = 20_000, most_words: int = 200_000) -> list[SuffixAutomaton]:
    """Automata of reference texts, each of at most shard_words words or one text.

    References of more than most_words words are refused: what is broadcast must stay small. A word takes about two
    states of 300 bytes, so the bound stands for some 120 MB. Null texts are skipped.
    """
    texts = references.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    n = texts.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if n > most_words:
        raise ValueError(f"{n} reference words; at most {most_words} may be broadcast, see remove_repeats")
    shards, words = [SuffixAutomaton()], 0
    for (text,) in texts.toLocalIterator():
        own = words_of([text.encode()]).hashes.tolist()
        if words and words + len(own) > shard_words:
            shards.append(SuffixAutomaton())
            words = 0
        shards[-1].add(own, 0)
        words += len(own)
    return [s.finish() for s in shards]


def remove_reference_spans(docs: DataFrame, references: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text, without spans of window or more reference words.

    Documents stream through broadcast automata of the reference shards. Null and empty texts have no words; repeated
    and null ids keep their own rows; other columns are ignored; empty tables on either side are fine.
    """
    shards = docs.sparkSession.sparkContext.broadcast([(a.edges, a.link, a.length, a.first) for a in reference_automata(references)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for parts in shards.value:
            automaton = SuffixAutomaton()
            automaton.edges, automaton.link, automaton.length, automaton.first = parts
            automata.append(automaton)
        for batch in batches:
            out = []
            for i, text in zip(*(batch.column(k).to_pylist() for k in ("id", "text")), strict=True):
                raw = (text or "").encode()
                words, hashes = raw.split(), words_of([raw]).hashes.tolist()
                gone = np.zeros(len(words), bool)
                for automaton in automata:
                    for at, owner in enumerate(automaton.owners(hashes, window)):
                        if owner is not None:
                            gone[at - window + 1 : at + 1] = True
                out.append((i, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=["id", "n_words", "n_removed", "kept_text"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
