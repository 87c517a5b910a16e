from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm import bags
from larder.llm.bags import ranked_search, terms


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, items, k):
    docs = [(i, Counter(plain(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in plain(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "tids": F.lit("x"), "item": F.lit(0)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("x"))
    return sorted((tuple(r) for r in ranked_search(docs, asked, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(["the", "of", "a"]) if rnd.random() < 0.5 else f"W{int(rnd.expovariate(0.05))}" for _ in range(rnd.randrange(30)))) for i in range(n)]
    rows += [(n + i, rows[rnd.randrange(5)][1]) for i in range(n)]  # a third and more are copies
    rnd.shuffle(rows)
    return rows, [(j, " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 9))) + " the the") for j in range(9)]


@pytest.mark.parametrize("k", [1, 5, 20])
def test_equals_brute_force(spark, k):
    rows, items = corpus(k, 150)
    assert got(spark, rows, items, k=k) == brute(rows, items, k)


def test_blocks_of_items_classes_and_documents(spark, monkeypatch):
    rows, items = corpus(7, 120)
    want = brute(rows, items, 6)
    assert got(spark, rows, items, k=6, item_words=12) == want
    for name in ("CLASSES", "ITEMS"):
        monkeypatch.setattr(bags, name, 2)
    posted = bags.Asked([[0, 1], [1], [2, 2]], bags.np.array([5, 7, 9]))
    assert [(f, u.tolist(), m.tolist()) for f, u, m in posted.blocks()] == [(0, [0, 1], [[5, 0], [7, 7], [0, 0]]), (2, [2], [[18], [0]])]


def test_nulls_ties_and_repeats(spark):
    rows = [(5, "apple pie"), (3, "Apple, PIE!"), (None, "pie apple"), (4, "pie-apple"), (3, "apple pie"), (None, None), (9, ""), (8, "--"), (7, "été apple"), (6, "pie " * 3000)]
    items = [(1, "apple"), (1, "pie pie"), (2, None), (3, "?"), (None, "ÉTÉ été apple"), (4, "unknown")]
    assert got(spark, rows, items, k=4) == brute(rows, items, 4)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == got(spark, [(1, "a")], []) == got(spark, [(1, None)], [(1, "a")]) == []


def test_terms():
    text = "Ab9é_Z@{ü}\x7f\x80[q`"
    assert [t.decode() for t in terms(text)] == plain(text) and terms(None) == []
