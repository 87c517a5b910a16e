from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from larder.llm import toxicity as T
from larder.llm.toxicity import bags_of, fit, fold, score, scores, train

STEMS = ["vokrat", "zumpel", "grindax"]


def corpus(n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        w = ["".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.choice([20, 80, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(w) // 60):
                stem = rnd.choice(STEMS)
                k = rnd.randrange(1, len(stem) - 1)
                w.insert(rnd.randrange(len(w)), rnd.choice([stem, stem.upper(), stem + "s", stem[:k] + stem[k + 1 :]]))
        rows.append((i, " ".join(w) + ".", int(toxic)))
    return rows


def test_bags_hold_every_word_once():
    texts = ["A b, c! d é", "", "x" * 5000, "no\nnew line 12"]
    bags = bags_of(texts)
    assert len(bags.member) == 10 and list(np.bincount(bags.text, minlength=4)) == [2, 0, 1, 1]


def test_unseen_misspellings_are_found():
    rows = corpus(900, 1)
    model = fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    fresh = corpus(400, 2)
    got = scores([t for _, t, _ in fresh], model) >= 0.5
    assert (got == np.array([y for *_, y in fresh], bool)).mean() > 0.95
    assert scores(["mild vokratt words"], model)[0] > 0.5 > scores(["mild other words"], model)[0] and scores([""], model)[0] == 0


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(900, 3) + [(5000, None, 0), (5001, "", 1), (5002, "long word " * 30000, 0)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in score(docs, model).withColumn("held_out", fold() == 0).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, y) for i, _, y in rows[:900] if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert got[5000].score == got[5001].score == 0 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert score(docs.limit(0), model).count() == 0
    none = train(docs, labels.limit(0))
    assert {r.predicted for r in score(docs.limit(5), none).collect()} == {0}


def plain_scores(texts, model):
    """The score told word by word: mean over n-grams, mean over bags of four words, mean of the two worst bags."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    value = [int(v) for v in T._VALUE]
    direction = model.weights[:, 1] - model.weights[:, 0]

    def letter(c):
        return ord(c) >= 0xC0 or c.isascii() and c.isalnum()

    def word(w):
        laid = [value[1], *((value[ord(c) & 0xFFFF] + ord(c)) & mask for c in w), value[2]]
        found = []
        for n in (3, 4, 5):
            for k in range(len(laid) - n + 1):
                h = 0
                for x in laid[k : k + n]:
                    h = (h * base + x) & mask
                h = (h + n) & mask
                h ^= h >> 32
                found.append(float(model.embeddings[((h * 0xC4CEB9FE1A85EC53) & mask) >> (64 - T.BITS)] @ direction))
        return sum(found) / len(found)

    out = []
    for text in texts:
        words = [word("".join(g)) for is_word, g in itertools.groupby(text.lower(), letter) if is_word]
        bags = sorted((np.mean(words[k : k + 4]) + model.bias[1] - model.bias[0] for k in range(0, len(words), 4)), reverse=True)
        out.append(1 / (1 + np.exp(-np.clip(model.scale * np.mean(bags[:2]) + model.shift, -30, 30))) if bags else 0.0)
    return np.array(out)


def test_scores_equal_a_plain_version():
    rows = corpus(300, 5)
    model = fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    rnd = random.Random(6)
    texts = [t for _, t, _ in corpus(60, 7)] + ["", " .,", "a", "É" * 40, "𝔳okrat \U00010041b 9x—y", "".join(rnd.choice("aB é\n.9\U0001f600") for _ in range(900))]
    assert np.allclose(scores(texts, model), plain_scores(texts, model), atol=1e-9)


def test_repeated_ids_train_the_same_in_any_order(spark):
    rows = [(i // 2, t) for i, t, _ in corpus(400, 8)] + [(None, "x"), (7, None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    models = [train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 5))]
    assert np.allclose(models[0].embeddings, models[1].embeddings) and models[0].scale == models[1].scale


def test_long_texts_are_learnt_from_whole(spark):
    rows, clean = corpus(60, 9), [t for _, t, y in corpus(400, 10) if not y]
    rows = [(i, " ".join(random.Random(i).choices(clean, k=40)) + " " + t, y) for i, t, y in rows]
    assert min(len(t) for _, t, _ in rows) > 20_000
    model = train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    assert scores(["such a vokrat zumpel"], model)[0] > scores([clean[0]], model)[0]
