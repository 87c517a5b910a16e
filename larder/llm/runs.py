"""Detection of periodic runs: stretches of words that repeat a root over and over.

Every run has a Lyndon root: a place where the longest Lyndon word, in the order of the words' numbers or in the
reverse order, is as long as the period. These candidates come from the ranks of suffixes, the next smaller and the
next greater one; each is extended to the right by the longest common extension in the suffix tree of the words, and
to the left by that in the tree of their reversal.

Trees are only built where a run can lie. In a run of period q and at least 4q words, each word but those of the last
q recurs within q words, which is at most a third of that stretch. So words that recur too late for the stretch that
they stand in are taken out, until nothing changes; of prose nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.suffix_tree import SuffixTree
from larder.llm.words import chunked


def _next(values: np.ndarray, greater: bool) -> np.ndarray:
    """For each place the next one with a smaller (greater) value; the length where there is none."""
    found, waiting = [len(values)] * len(values), []
    own = (-values if greater else values).tolist()
    for i, v in enumerate(own):
        while waiting and own[waiting[-1]] > v:
            found[waiting.pop()] = i
        waiting.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray, least: int = 6, powers: int = 4) -> np.ndarray:
    """Rows (start, length, period): all runs of max(least, powers * period) symbols or more, powers at least 3.

    A run is a stretch with its smallest period that can't be extended on either side.
    """
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none
    tree = SuffixTree(symbols.tolist())
    places = np.arange(n)
    pairs = [(places, _next(tree.rank, greater)[:n]) for greater in (False, True)]
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    inside = j < n
    i, j = i[inside], j[inside]
    right = tree.common(i, j)
    # The first root of a long run has at least powers - 2 periods after it.
    able = right >= (powers - 2) * (j - i)
    i, j, right = i[able], j[able], right[able]
    if not len(i):
        return none
    mirror = SuffixTree(symbols[::-1].tolist())
    left = np.where(i > 0, mirror.common(n - i, n - j), 0)
    period = j - i
    found = np.stack([i - left, period + left + right, period], axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(least, powers * period)], axis=0)


def stretches(codes: np.ndarray, first: np.ndarray, least: int = 6, powers: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the places where runs can begin, in texts that lie one after the other (first: their starts).

    codes are equal where words are. In a run of period q of at least ``powers`` periods all words but the last q recur
    within q, which is at most the stretch by powers - 1.
    """
    n = len(codes)
    text = np.zeros(n + 1, np.int64)
    np.add.at(text, first[1:-1], 1)
    text = np.cumsum(text)[:n]
    order = np.argsort(codes, kind="stable")
    a, b = order[:-1], order[1:]
    recurs = (codes[a] == codes[b]) & (text[a] == text[b])
    gap = np.zeros(n, np.int64)
    gap[a[recurs]] = (b - a)[recurs]
    alive = np.flatnonzero(gap)
    while True:
        edge = np.flatnonzero(np.concatenate([[True], np.diff(alive) != 1])) if len(alive) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(alive)))
        whole = np.repeat(size, size)
        keep = (gap[alive] * (powers - 1) <= whole) & (whole >= least - 1)
        if keep.all():
            return alive[edge], alive[edge] + size
        alive = alive[keep]


def _found(least: int, powers: int):
    """Rows (id, n_words, runs, collapsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunked(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True), 1):
                texts = [(t or "").encode().split() for _, t in some]
                first = np.cumsum([0, *map(len, texts)])
                seen: dict[bytes, int] = {}
                codes = np.array([seen.setdefault(w, len(seen)) for words in texts for w in words], np.int64)
                found: list[list] = [[] for _ in texts]
                gone = np.zeros(len(codes) + 1, np.int64)
                for start, stop in zip(*(x.tolist() for x in stretches(codes, first, least, powers)), strict=True):
                    own = int(np.searchsorted(first, start, side="right")) - 1
                    end = min(int(first[own + 1]), stop + (stop - start) // (powers - 1))
                    symbols = np.unique(codes[start:end], return_inverse=True)[1] + 1
                    for s, length, period in runs_of(symbols, least, powers).tolist():
                        if s < stop - start:  # one that begins later is another stretch's, maybe cut off here
                            found[own].append((start + s - int(first[own]), length, period))
                            gone[start + s + period] += 1
                            gone[start + s + length] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                collapsed = []
                for k, words in enumerate(texts):
                    mine = keep[first[k] : first[k + 1]]
                    collapsed.append(b" ".join(words if mine.all() else [w for w, kept in zip(words, mine, strict=True) if kept]).decode())
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                columns = [pa.array([i for i, _ in some], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, powers: int = 4) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (start, length, period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, numbered from 0. A run is a stretch with smallest period q of at
    least max(least, powers * q) words that no neighbouring word extends; runs come by start, then period. collapsed
    is the text without the words that some run holds after its first q, joined by single spaces. powers is at least 3.

    Null and empty texts have no words, no runs and an empty collapsed text. Texts are read whole, each by itself, so
    repeated and null ids keep their own rows and a lost executor costs only its texts; memory grows with the longest
    stretch that may be periodic (about 1.5 kB a word) and not with the table. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    if powers < 3:
        raise ValueError("powers must be at least 3")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_found(least, powers), "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
