from __future__ import annotations

import random
from binascii import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm.queries import repeating
from larder.llm.runs import periodic_runs, runs_of
from larder.llm.suffix_tree import SuffixTree


def brute(w, least=6, powers=4):
    found = []
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, powers * q):
                found.append((i, j - i + q, q))
            i = j + 1
    smallest = lambda s, n, q: not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q))
    return sorted((r for r in found if smallest(*r)), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_tree_gives_ranks_and_extensions(w):
    tree = SuffixTree(w)
    suffixes = sorted(range(len(w) + 1), key=lambda i: [*w[i:], 0])
    assert np.argsort(tree.rank).tolist() == suffixes
    pairs = [(i, j) for i in range(len(w) + 1) for j in range(i + 1, len(w) + 1)]
    same = [next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j) for i, j in pairs]
    if pairs:
        assert tree.common(*np.array(pairs).T).tolist() == same


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5).flatmap(lambda root: st.integers(1, 7).map(lambda k: root * k)), max_size=5).map(lambda parts: sum(parts, [])))
def test_runs_equal_brute_force(w):
    assert sorted(map(tuple, runs_of(np.array(w, np.int64)).tolist()), key=lambda r: (r[0], r[2])) == brute(w)


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        w = [f"w{rnd.randrange(rnd.choice([1, 3, 8, 300]))}" for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            root = [f"r{rnd.randrange(3)}" for _ in range(rnd.randrange(1, 9))]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = (root * 8)[: rnd.randrange(8 * len(root))]
        yield w


def test_operator_equals_brute_force(spark):
    rows = [(i, w) for i, w in enumerate(texts(4, 400))]
    docs = spark.createDataFrame([(i, "\n".join(w)) for i, w in rows], "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit("x")})
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert len(got) == 400
    for i, w in rows:
        runs = brute(w)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == runs
        assert (got[i].n_words, got[i].collapsed) == (len(w), collapse(w, runs))
    assert sum(len(r.runs) for r in got.values()) > 200


def test_edge_cases(spark):
    long = "a b c " * 4000 + " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, None), (1, "a a a a a a"), (None, "a a a a a"), (None, ""), (2, " \t\x0b "), (3, long), (3, long), (4, "a  a  a  a  a  a ")]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = [(i, len(w := (t or "").encode().split()), brute(w) if i != 3 else [(0, 12_000, 3)]) for i, t in rows]
    assert [r[:3] for r in got] == sorted(want, key=repr)
    assert {r[3] for r in got if r[0] == 1} == {"", "a"} and all(r[3].startswith("a b c x0 x1") for r in got if r[0] == 3)
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), powers=2)


def test_other_bounds(spark):
    w = "a b a b a b c c c d e d e".split()
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs(docs, least=3, powers=3).first().runs] == brute(w, 3, 3) == [(0, 6, 2), (6, 3, 1)]


def test_planted_runs(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(30)))) for i in [*range(-20, 300)]] + [(None, "a b"), (7, None)]
    got = sorted((tuple(r) for r in repeating(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()), key=repr)
    want = []
    for i, t in rows:
        h, w = crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        want.append((i, t))
    assert got == sorted(want, key=repr)
