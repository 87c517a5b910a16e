"""Sampled segmentations for SentencePiece vocabularies: Gumbel top-k without replacement by perturbed A* search.

A text's lattice has an edge for each piece of the vocabulary at each place; a piece weighs what its rank tells
(Zipf: the logarithm of one over the rank). The log-mass of all ways to finish from a place is an exact bound, so the
search pops the prefix with the largest perturbed mass, hands that maximum down to its continuations as truncated
Gumbel variables, and emits whole segmentations in the order of their perturbed log-probabilities: distinct samples,
drawn without replacement. What is then left on the heap tells the threshold, and with it each sample's probability
of inclusion.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import words_of

SPACE = "▁"
#: Log-weight of a character that must be spelt in bytes, for each byte.
BYTE = -14.0
#: Words whose lattices a task keeps.
KEPT = 50_000


class Vocabulary:
    """Pieces of a SentencePiece model file with their ids, byte pieces and rank weights."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = math.log(sum(1 / (k + 10) for k in range(len(plain))))
        self.pieces = {model.id_to_piece(i): (i, -math.log(k + 10) - total) for k, i in enumerate(plain)}
        self.text = {i: p for p, (i, _) in self.pieces.items()}
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.words: dict[str, list] = {}

    def lattice(self, word: str) -> list[list[tuple[float, float, int, tuple[int, ...]]]]:
        """By place: the edges from it, (cumulative probability, log-probability given the place, next place, ids)."""
        known = self.words.get(word)
        if known is not None:
            return known
        n, pieces, starts, exp = len(word), self.pieces, self.starts, math.exp
        mass, edges = [0.0] * (n + 1), [[] for _ in word]
        for at in range(n - 1, -1, -1):
            found = []
            for to in range(at + 1, n + 1):
                part = word[at:to]
                if part not in starts:
                    break
                piece = pieces.get(part)
                if piece:
                    found.append((piece[1] + mass[to], to, (piece[0],)))
            if not found or found[0][1] != at + 1:
                raw = word[at].encode("utf-8", "replace")
                found.append((BYTE * len(raw) + mass[at + 1], at + 1, tuple(self.byte[b] for b in raw)))
            if len(found) == 1:
                mass[at] = found[0][0]
                edges[at] = [(1.0, 0.0, found[0][1], found[0][2])]
                continue
            found.sort(key=lambda e: (-e[0], e[1]))
            top, below = found[0][0], 0.0
            mass[at] = total = top + math.log(sum(exp(w - top) for w, _, _ in found))
            for w, to, ids in found:
                below += exp(w - total)
                edges[at].append((below, w - total, to, ids))
            edges[at][-1] = (math.inf, *edges[at][-1][1:])
        if len(self.words) < KEPT:
            self.words[word] = edges
        return edges

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(bytes([self.bytes_of[i]]) if i in self.bytes_of else self.text[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def units(text: str) -> list[str]:
    """What pieces never reach across: runs of spaces (as the space mark) with the word after them."""
    return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", SPACE + text.replace(" ", SPACE)) if text else []


def sample(text: str, vocab: Vocabulary, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
    """Up to k distinct segmentations: (ids, log-probability, perturbed log-probability, probability of inclusion).

    Fewer than k if the text has no more; an empty text has one, the empty one. Equal seeds give equal samples.

    A Gumbel variable of location phi is -log of an exponential one of rate exp(phi). Of a node's continuations the
    one that keeps the node's maximum is drawn by weight alone, and the exponentials of the others exceed the node's
    by exponentials of their own rates, as exponentials forget. So each sibling's perturbed maximum comes directly,
    and siblings that are less likely than exp(-40) to be among the best k + 1 need not be drawn.
    """
    lattices = [vocab.lattice(u) for u in units(text)]
    rnd, log, exp = Random(seed).random, math.log, math.exp
    # A node is a prefix: (-perturbed, serial, log-probability, unit, place, path); path is a linked list of ids.
    best_nodes: list[tuple] = [(log(-log(1 - rnd() or 1e-300)), 0, 0.0, 0, 0, None)]
    serial, done = 0, []
    while best_nodes and len(done) < k:
        minus, _, phi, unit, place, path = best_nodes.pop(0)
        steps: list[tuple[int, ...]] = []
        while unit < len(lattices):
            edges = lattices[unit][place]
            at = 0
            if len(edges) > 1:
                full = len(best_nodes) > k
                if phi + (best_nodes[-1][0] if full else math.inf) <= -40:
                    break
                drawn = rnd()
                while edges[at][0] <= drawn:
                    at += 1
                for j, (_, w, to, ids) in enumerate(edges):
                    if j != at:
                        x = log(-log(1 - rnd() or 1e-300)) - phi - w
                        value = max(minus, x) + math.log1p(exp(-abs(minus - x)))  # -perturbed maximum of the sibling
                        if not full or value < best_nodes[-1][0]:
                            serial += 1
                            last = to == len(lattices[unit])
                            insort(best_nodes, (value, serial, phi + w, unit + last, 0 if last else to, (path, ids)))
                            del best_nodes[k + 1 :]
                            full = len(best_nodes) > k
            _, w, to, ids = edges[at]
            phi, path = phi + w, (path, ids)
            unit, place = (unit + 1, 0) if to == len(lattices[unit]) else (unit, to)
        for rest in lattices[unit:]:  # no sibling matters any more: draw by weight alone
            n = len(rest)
            while place < n:
                edges, at = rest[place], 0
                if len(edges) > 1:
                    drawn = rnd()
                    while edges[at][0] <= drawn:
                        at += 1
                _, w, place, ids = edges[at]
                phi += w
                steps.append(ids)
            place = 0
        done.append((path, steps, phi, -minus))
    out = []
    for path, steps, phi, perturbed in done:
        steps.reverse()
        while path:
            path, some = path
            steps.append(some)
        inclusion = -math.expm1(-exp(min(50.0, phi + best_nodes[0][0]))) if best_nodes else 1.0
        out.append(([i for some in reversed(steps) for i in some], phi, perturbed, inclusion))
    return out


def sampled_segmentations(docs: DataFrame, model_path: str, keys: list[str], text_col: str = "text", k: int = 3, seed: int = 0) -> DataFrame:
    """One row per row of docs: keys and samples, an array of (ids, log_prob, perturbed, inclusion), best first.

    Samples are distinct segmentations into pieces of the model file at model_path, drawn without replacement with a
    seed that the keys and ``seed`` decide; every one decodes to the text. Null is the empty text, which has one
    segmentation without pieces. Rows that repeat keys and text get equal samples; null keys count as keys. Texts are
    cut whole, whatever their length. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        kind = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())]))
        for batch in batches:
            key_rows = zip(*(batch.column(j).to_pylist() for j in range(len(keys))), strict=True)
            found = []
            for key, text in zip(key_rows, batch.column(len(keys)).to_pylist(), strict=True):
                row_seed = int(words_of([repr((seed, *key)).encode()]).hashes.sum())
                found.append([dict(zip(("ids", "log_prob", "perturbed", "inclusion"), s, strict=True)) for s in sample(text or "", vocab, k, row_seed)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, kind)], names=[*keys, "samples"])

    texts = docs.select(*[F.col(c).cast("long").alias(c) for c in keys], F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", samples array<struct<ids: array<int>, log_prob: double, perturbed: double, inclusion: double>>")


def decoded(samples: DataFrame, model_path: str, keys: list[str], ids_col: str = "ids") -> DataFrame:
    """keys and text of rows with piece ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([vocab.decode(i or []) for i in batch.column(len(keys)).to_pylist()], pa.string())], names=[*keys, "text"])

    return samples.select(*[F.col(c).cast("long").alias(c) for c in keys], F.col(ids_col).alias("ids")).mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", text string")
