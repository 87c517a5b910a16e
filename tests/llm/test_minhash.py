from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from larder.llm.minhash import most_differing, near_duplicates, shingle_sets, signatures, sketch_similarity
from larder.llm.words import words_of


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, bases, copies):
    rnd, rows = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 40, 120, 300]))]
        for _ in range(copies):
            mine = words[:]
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                mine[rnd.randrange(len(mine))] = f"x{rnd.randrange(50)}"
            rows.append((len(rows), " ".join(mine) if rnd.random() < 0.8 else "\n".join(mine).upper()))
    return rows


def test_words_are_the_contracts():
    texts = ["  a bc\td\x0b\x0ce\r\n", "", "É é É", "\xa0x\x85 y", "A a"]
    for lower in (False, True):
        w = words_of([t.encode() for t in texts], lower)
        seen = {}
        for i, t in enumerate(texts):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t
            own = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert w.first[i + 1] - w.first[i] == len(own)
            for h, x in zip(w.hashes[w.first[i] : w.first[i + 1]], own):
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_components_equal_brute_force(spark):
    rows = corpus(3, 12, 14) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "w" * 50000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_chain_of_links_is_followed(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i * 4 : i * 4 + 60] + [f"w{60 + k}" for k in range(i * 4)][-60:])) for i in range(9)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def test_repeated_ids_null_ids_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e", "x", 3), (1, "a b c d e", "y", 4), (None, "a b c d e", "z", 5), (2, "a b c d e", "q", 6)], "doc_id long, text string, component_id string, bands int")
    got = near_duplicates(frame).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(frame.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        common = rnd.integers(0, 1 << 62, int(1000 * share)).astype(np.uint64)
        own = [rnd.integers(0, 1 << 62, int(1000 * (1 - share) / 2)).astype(np.uint64) for _ in range(2)]
        sets = [np.concatenate([common, x]) for x in own]
        true = len(common) / (len(common) + sum(map(len, own)))
        keys, sketch = signatures(sets, 32, 4)
        far = int(sum(bin(int(v) & (2**64 - 1)).count("1") for v in sketch[0] ^ sketch[1]))
        assert abs(sketch_similarity(far, 128) - true) < 0.12 and (keys[0] == keys[1]).any()
    assert most_differing(0.8, 128) < 200


def test_shingle_sets_of_short_texts():
    sets, _ = shingle_sets([b"a b", b"", b"A B", b"a b c d e"], 4)
    assert [len(s) for s in sets] == [1, 0, 1, 2] and sets[0][0] == sets[2][0]


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    from larder.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 5)
    rnd, rows = random.Random(6), []
    base = [f"w{k}" for k in range(90)]
    for i in range(90):
        mine = base[:]
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            mine[rnd.randrange(90)] = f"x{rnd.randrange(9)}"
        rows.append((i, " ".join(mine)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 80)


def brute_rows(rows, n, percent):
    """By row: component and whether it leads, with every row a document of its own."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((tuple(w), {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    root = list(range(len(rows)))
    linked = [i for i, (k, _) in enumerate(rows) if k is not None and sets[i][1]]
    for _ in range(len(rows)):
        before = root[:]
        for x in linked:
            for y in linked:
                if 100 * len(sets[x][1] & sets[y][1]) >= percent * len(sets[x][1] | sets[y][1]):
                    root[x] = root[y] = min(root[x], root[y])
        if root == before:
            break
    return [min(rows[y][0] for y in linked if root[y] == root[x]) if x in linked else rows[x][0] for x in range(len(rows))]


def test_repeated_ids_with_different_texts(spark):
    base, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    four = [(1, base), (2, base), (2, other), (3, other + " x")]
    for rows in (four, four[::-1]):
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept, r.leads) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(got) == 3 and got[1, 56] == (1, True, True) and got[3, 57] == (2, False, False)
    for seed in (1, 2):
        rnd = random.Random(seed)
        texts = [t for _, t in corpus(seed, 7, 8)] + ["", " ", None]
        rows = [(rnd.choice([None, *range(12)]), rnd.choice(texts)) for _ in range(90)]
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(0))
        out = near_duplicates(frame.repartition(4), shingle_words=4).collect()
        want = brute_rows(rows, 4, 80)
        assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted(zip([i for i, _ in rows], want, strict=True), key=str)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) and (r.kept or not r.leads) for r in out)
        groups = {}
        for r in out:
            if r.n_shingles and r.doc_id is not None:
                groups.setdefault(r.component_id, set()).update({r.text_hash} if r.leads else ())
        # A component id may name several components, each with one text that leads.
        assert all(groups.values())


def test_a_text_of_each_component_leads(spark):
    a = " ".join(f"w{k}" for k in range(80))
    rows = [(1, a), (1, a + " x"), (1, "other words stand in this one alone"), (2, a + " y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.leads for r in got) == 2 and sorted((r.component_id, r.kept) for r in got) == [(1, False), (1, True), (1, True), (1, True)]


def test_a_bucket_of_many_unlike_members_gives_few_rows(spark, monkeypatch):
    """Members that share a band, no two alike but for some pairs."""
    from larder.llm import minhash
    from larder.llm.scratch import Scratch

    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 300)
    rng = np.random.default_rng(4)
    sketch = rng.integers(-(1 << 62), 1 << 62, (2000, 8))
    sketch[1500:] = sketch[:500]
    rows = [(9, k, k, 100, sketch[k].tolist(), 2000) for k in range(2000)] + [(8, k, k, 100, sketch[k % 5].tolist(), 10) for k in range(10)]
    apart = spark.createDataFrame(rows, "key long, node long, family long, n_shingles long, sketch array<long>, held long")
    got = {(r.b, r.a) for r in minhash._met_families(apart, 80, most_differing(0.8, 128), Scratch(spark, "test")).collect()}
    assert got == {(k, k + 1500) for k in range(500)} | {(k, k + 5) for k in range(5)}
