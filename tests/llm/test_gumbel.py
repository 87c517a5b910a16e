from __future__ import annotations

import math
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from larder.llm.gumbel import Vocabulary, decoded, sample, sampled_segmentations, units

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = Vocabulary(MODEL)


def everything(text):
    """All segmentations of a text with their log-probabilities."""
    ways = [((), 0.0)]
    for u in units(text):
        edges, own = VOCAB.lattice(u), []

        def walk(at, ids, w, edges=edges, own=own, n=len(u)):
            if at == n:
                own.append((ids, w))
            else:
                for _, x, to, some in edges[at]:
                    walk(to, ids + some, w + x)

        walk(0, (), 0.0)
        ways = [(a + b, x + y) for a, x in ways for b, y in own]
    return dict(ways)


def test_lattice_is_a_distribution_and_holds_the_models_own_pieces():
    for text in ("the cat", "é x", "a  b", "naïve"):
        ways = everything(text)
        assert abs(sum(map(math.exp, ways.values())) - 1) < 1e-9
        assert tuple(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)) in ways


def test_samples_are_distinct_ordered_and_decode():
    for text in ("the cat sat", "", "a", " lead  and trail ", "tab\tnew\nline", "漢字😀é", "x" * 3000, "The quick " * 400):
        got = sample(text, VOCAB, 4, 7)
        assert len({tuple(g[0]) for g in got}) == len(got) and [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)
        assert all(VOCAB.decode(g[0]) == text and g[1] <= 1e-9 and 0 < g[3] <= 1 for g in got)
        assert len(got) == min(4, len(everything(text))) if len(text) < 12 else len(got) == 4


def test_draws_follow_the_lattice_without_replacement():
    text, n = "cat", 6000
    ways = everything(text)
    first, weighted = Counter(), Counter()
    for seed in range(n):
        got = sample(text, VOCAB, 3, seed)
        first[tuple(got[0][0])] += 1
        for ids, w, _, inclusion in got:
            weighted[tuple(ids)] += math.exp(w) / inclusion / n
    for ids, w in ways.items():
        p = math.exp(w)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        if p > 0.01:  # unbiased by the scores of inclusion
            assert abs(weighted[ids] - p) < 0.2 * p + 0.01


def test_on_spark(spark):
    rows = [(1, 0, "some words here"), (1, 0, "some words here"), (1, 1, "some words here"), (2, 0, None), (None, 3, ""), (4, 0, "y" * 20000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, text string, samples int")
    got = sampled_segmentations(frame.repartition(3), MODEL, ["conv_id", "turn"]).collect()
    by_key = {}
    for r in got:
        assert by_key.setdefault((r.conv_id, r.turn), r.samples) == r.samples
    assert by_key[1, 0] != by_key[1, 1] and [s.ids for s in by_key[2, 0]] == [[]] and len(got) == len(rows)
    ids = spark.createDataFrame(got).select("conv_id", "turn", F.explode("samples.ids").alias("ids"))
    assert {(r.conv_id, r.turn, r.text) for r in decoded(ids, MODEL, ["conv_id", "turn"]).collect()} == {(a, b, t or "") for a, b, t in rows}
    assert sampled_segmentations(frame.limit(0), MODEL, ["conv_id", "turn"]).count() == 0
