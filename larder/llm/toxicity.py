"""Toxicity from subword bags: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams, so unseen misspellings share most of it. A
bag is a run of a few words; its mean vector goes through a softmax over {clean, toxic}. Labels are of documents, so
training alternates: each toxic document stands by its most toxic bags, each clean one by all its bags. A document
scores by its two most toxic bags, through a logistic scale fitted on the training documents and set to the share
of toxic ones among all that are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.words import chunked, powers, stream

BITS, DIMENSIONS, SIZES, BAG, MIN_WORDS, DECAY = 18, 2, (3, 4, 5), 4, 3, 3e-6
#: A text scores by so many of its most toxic bags; a toxic text stands by this share of its bags in training.
TOP_BAGS, SHARE = 2, 0.06
#: Bounds of the sample that the classifier is fitted on: documents by label.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """embeddings: n-gram buckets x dimensions; weights: dimensions x {clean, toxic}; scale and shift of the logit."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    shift: float


class Bags(NamedTuple):
    """Distinct words (keys) laid out as <word> (value, start of each), the distinct word of each word, each bag's start and text."""

    keys: np.ndarray
    laid: np.ndarray
    starts: np.ndarray
    member: np.ndarray
    first: np.ndarray
    text: np.ndarray


def _letters() -> np.ndarray:
    table = np.ones(1 << 16, bool)
    table[:0xC0] = False
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    return table


_IS_LETTER = _letters()
_VALUE = stream(31, 1 << 16)


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def bags_of(texts: list[str]) -> Bags:
    """Bags of at most BAG words; a text without words has none. Words are runs of letters and digits, lower-cased."""
    data = "\n".join(t.lower().replace("\n", " ") for t in texts) + "\n"
    points = np.frombuffer(data.encode("utf-32-le", "replace"), np.uint32)
    held = _IS_LETTER[np.minimum(points, 0xFFFF)]  # beyond the table all are letters
    turn = np.flatnonzero(held[1:] != held[:-1]) + 1
    turn = np.concatenate([[0], turn]) if held[0] else turn
    starts, ends = turn[0::2], turn[1::2]
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Bags(np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty, empty, empty, empty)
    text_of = np.searchsorted(np.flatnonzero(points == 10), starts)
    value = _VALUE[points & 0xFFFF] + points

    # Distinct words by a polynomial hash; their letters laid out as <word>.
    power = powers(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(value * power[0][: len(points)], out=total[1:])
    key = (total[ends] - total[starts]) * power[1][starts] + (ends - starts).astype(np.uint64)
    keys, one, member = np.unique(key, return_index=True, return_inverse=True)
    size = ends[one] - starts[one] + 2
    edge = np.cumsum(size)
    laid = np.empty(edge[-1], np.uint64)
    laid[edge - size], laid[edge - 1] = _VALUE[1], _VALUE[2]
    laid[_flat(edge - size + 1, size - 2)] = value[_flat(starts[one], size - 2)]
    new_text = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    nth = np.arange(len(starts)) - np.flatnonzero(new_text)[np.cumsum(new_text) - 1]
    first = np.flatnonzero(new_text | (nth % BAG == 0))
    return Bags(keys, laid, edge - size, member, first, text_of[first])


def merged(parts: list[tuple[int, Bags]]) -> Bags:
    """One set of bags from parts, each with its number of texts; equal words of several parts become one."""
    keys, one, inverse = np.unique(np.concatenate([p.keys for _, p in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([np.diff(np.append(p.starts, len(p.laid))) for _, p in parts])
    offsets = lambda lengths: np.cumsum([0, *lengths])[:-1]
    starts = np.concatenate([p.starts + at for (_, p), at in zip(parts, offsets([len(p.laid) for _, p in parts]), strict=True)])
    laid = np.concatenate([p.laid for _, p in parts])[_flat(starts[one], sizes[one])]
    member = np.concatenate([inverse[p.member + at] for (_, p), at in zip(parts, offsets([len(p.keys) for _, p in parts]), strict=True)])
    first = np.concatenate([p.first + at for (_, p), at in zip(parts, offsets([len(p.member) for _, p in parts]), strict=True)])
    text = np.concatenate([p.text + at for (_, p), at in zip(parts, offsets([n for n, _ in parts]), strict=True)])
    return Bags(keys, laid, np.cumsum(sizes[one]) - sizes[one], member, first, text)


def _grams(bags: Bags, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each place of the laid-out words, and which of them lie within one word."""
    size = np.diff(np.append(bags.starts, len(bags.laid)))
    left = np.repeat(bags.starts + size, size) - np.arange(len(bags.laid))
    h = np.zeros(len(bags.laid), np.uint64)
    for k in range(n):
        h *= _BASE
        h[: len(h) - k or None] += bags.laid[k:]
    h += np.uint64(n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), left >= n


def _bag_means(values: np.ndarray, bags: Bags) -> np.ndarray:
    """Mean over each bag of a value (or vector) of its words."""
    n = np.diff(np.append(bags.first, len(bags.member)))
    sums = np.add.reduceat(values[bags.member], bags.first, axis=0)
    return sums / (n if values.ndim == 1 else n[:, None])


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 2, steps: int = 60, rate: float = 0.1, decay: float = DECAY, seed: int = 7, toxic_share: float | None = None) -> Model:
    """A model of labelled texts; texts without words are left out. With one label only it says that label.

    toxic_share is the share among all labelled texts, where the sample's own is another.
    """
    bags = merged([(len(some), bags_of([t for (t,) in some])) for some in chunked(((t,) for t in texts), 0)] or [(0, bags_of([]))])
    share = float(toxic.mean()) if len(toxic) else 0.0
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    if not len(bags.member) or share in (0.0, 1.0):
        return Model(np.zeros((1 << BITS, DIMENSIONS)), weights, bias, 0.0, -20.0 if share < 0.5 else 20.0)
    n_words = len(bags.starts)
    at_word = np.repeat(np.arange(n_words), np.diff(np.append(bags.starts, len(bags.laid))))
    pairs = [(grams[fits], at_word[fits]) for grams, fits in (_grams(bags, n) for n in SIZES)]
    gram, word = (np.concatenate(x) for x in zip(*pairs, strict=True))
    per_word = np.bincount(word, minlength=n_words).astype(float)
    # N-grams of fewer than MIN_WORDS different words keep a zero vector: nothing general is to be learnt from them.
    common = np.bincount(gram, minlength=1 << BITS) >= MIN_WORDS
    word, gram = word[common[gram]], gram[common[gram]]
    columns = np.flatnonzero(common)
    gram = (np.cumsum(common) - 1)[gram]
    table = rng.normal(0, 0.1, (len(columns), DIMENSIONS))
    per_bag = np.diff(np.append(bags.first, len(bags.member)))
    label = toxic[bags.text].astype(np.int64)
    stands = np.ones(len(bags.text), bool)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, weights, bias)]

    def word_vectors() -> np.ndarray:
        return np.stack([np.bincount(word, table[gram, d], n_words) for d in range(DIMENSIONS)], axis=1) / per_word[:, None]

    step = 0
    for _ in range(rounds):
        weight = np.where(stands, np.where(label == 1, 0.5 / max(1, (stands & (label == 1)).sum()), 0.5 / max(1, (stands & (label == 0)).sum())), 0.0)
        for _ in range(steps):
            step += 1
            hidden = _bag_means(word_vectors(), bags)
            logits = hidden @ weights + bias
            p = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -40, 40)))
            delta = (p - label) * weight
            delta = np.stack([-delta, delta], axis=1)
            to_hidden = (delta @ weights.T) / per_bag[:, None]
            to_word = np.stack([np.bincount(bags.member, np.repeat(to_hidden[:, d], per_bag), n_words) for d in range(DIMENSIONS)], axis=1) / per_word[:, None]
            to_table = np.stack([np.bincount(gram, to_word[word, d], len(columns)) for d in range(DIMENSIONS)], axis=1)
            for param, grad, (m, v) in zip((table, weights, bias), (to_table + decay * table, hidden.T @ delta + 1e-4 * weights, delta.sum(axis=0)), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        margin = (_bag_means(word_vectors(), bags) @ weights + bias) @ np.array([-1.0, 1.0])
        place, size = _places(margin, bags.text)
        stands = (label == 0) | (place < np.maximum(TOP_BAGS, SHARE * size))
    best = _text_margins(margin, bags.text, len(texts))
    seen = np.isfinite(best)
    full = np.zeros((1 << BITS, DIMENSIONS))
    full[columns] = table
    scale, shift = _logistic(best[seen], toxic[seen].astype(float))
    if toxic_share is not None:
        odds = lambda p: np.log(p / (1 - p))
        shift += float(odds(np.clip(toxic_share, 0.01, 0.99)) - odds(np.clip(toxic[seen].mean(), 0.01, 0.99)))
    return Model(full, weights, bias, scale, shift)


def _places(margin: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each bag among those of its text, from 0 for the largest margin, and the number of them."""
    order = np.lexsort((-margin, text))
    new = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    starts = np.flatnonzero(new)
    nth = np.arange(len(order)) - starts[np.cumsum(new) - 1]
    place = np.empty(len(order), np.int64)
    place[order] = nth
    return place, np.bincount(text)[text]


def _text_margins(margin: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Mean margin of each text's TOP_BAGS most toxic bags, or of all if it has fewer; -inf without any."""
    place, _ = _places(margin, text)
    top = place < TOP_BAGS
    count = np.bincount(text[top], minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, np.bincount(text[top], margin[top], n) / count, -np.inf)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve over one margin, by Newton steps on standardised values."""
    mean, spread = x.mean(), x.std() + 1e-9
    z, w = (x - mean) / spread, np.zeros(2)
    design = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-2 * np.eye(2), grad)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Probability of toxic for each text; one without words scores as a bag of zero margin."""
    out = np.full(len(texts), 0.0)
    bags = bags_of(texts)
    direction = model.weights[:, 1] - model.weights[:, 0]
    margin = np.full(len(texts), -np.inf)
    if len(bags.member):
        by_gram = model.embeddings @ direction
        sums, counts = np.zeros(len(bags.starts)), np.zeros(len(bags.starts))
        for n in SIZES:
            grams, fits = _grams(bags, n)
            sums += np.add.reduceat(by_gram[grams] * fits, bags.starts)
            counts += np.add.reduceat(fits.astype(float), bags.starts)
        margin = _text_margins(_bag_means(sums / counts, bags) + model.bias[1] - model.bias[0], bags.text, len(texts))
    seen = np.isfinite(margin)
    out[seen] = 1 / (1 + np.exp(-np.clip(model.scale * margin[seen] + model.shift, -30, 30)))
    return out


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows of fold 0 are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled documents outside fold 0, at most MAX_TOXIC and MAX_CLEAN of them; their texts are read whole.

    An id with several labels counts as toxic if one says so; null ids, labels and texts are left out. Of an id with
    several texts the least by hash stands for it, so the order of rows doesn't matter.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold("doc_id") != 0)
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = F.broadcast(drawn[0].union(drawn[1]).toDF("__id", "__toxic"))  # at most MAX_TOXIC + MAX_CLEAN rows
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") > 0)
    one = F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__one")
    chosen = texts.join(sample, "__id").groupBy("__id", "__toxic").agg(one).select("__id", "__one.__text", "__toxic")
    share = known.agg(F.avg("toxic")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        model = fit([t for _, t, _ in rows], np.array([y for *_, y in rows], np.int64), toxic_share=share)
        used = np.flatnonzero(model.embeddings.any(axis=1))
        parts = [used, model.embeddings[used].ravel(), model.weights.ravel(), model.bias, np.array([model.scale, model.shift])]
        yield pa.RecordBatch.from_arrays([pa.array([p.astype(float)], pa.list_(pa.float64())) for p in parts], names=["used", "vectors", "weights", "bias", "scale"])

    # One task fits the bounded sample; only the model, whose size is fixed, comes to the driver.
    arrays = "used array<double>, vectors array<double>, weights array<double>, bias array<double>, scale array<double>"
    fitted = chosen.coalesce(1).mapInArrow(run, arrays).collect()
    if not fitted:  # an empty sample may have no task at all
        return fit([], np.zeros(0, np.int64))
    got = [np.array(x) for x in fitted[0]]
    embeddings = np.zeros((1 << BITS, DIMENSIONS))
    embeddings[got[0].astype(np.int64)] = got[1].reshape(-1, DIMENSIONS)
    return Model(embeddings, got[2].reshape(DIMENSIONS, 2), got[3], *got[4].tolist())


def toxic_score(text: Column, model: Model) -> Column:
    """Score of each text, 0 to 1; rows stay where they are. Null and empty texts score 0."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = [scores([t or "" for (t,) in some], sent.value) for some in chunked(((t,) for t in texts), 0)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored(text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 from threshold on).

    Whole texts are scored, whatever their length; null and empty texts score 0. Repeated and null ids keep rows of
    their own; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    out = docs.select(F.col(id_col).cast("long").alias("id"), toxic_score(F.col(text_col).cast("string"), model).alias("score"))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
