from __future__ import annotations

import hashlib
import random
import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from larder.llm.winnowing import contamination, names


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, window=10):
    runs = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1) if n else ():
            runs.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(r) for r in runs}:
            for j in range(len(w) - n + 1):
                if (r := tuple(w[j : j + n])) in runs:
                    hit |= set(range(j, j + n))
                    found |= runs[r]
        told = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), len(hit), len(found - {None}), hashlib.sha256(told.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, rows, items, **more):
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs.withColumn("name", F.lit(1)).withColumn("key", F.lit("x")).withColumn("length", F.lit(3)), asked.withColumn("run", F.lit(2)), **more)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=repr)


@pytest.mark.parametrize("shortest", [10, 1])
def test_equals_brute_force(spark, shortest):
    rnd = random.Random(shortest)
    items = [(k % 12, " ".join(f"W{rnd.randrange(9)}" for _ in range(rnd.choice([shortest, 10, 12, 25])))) for k in range(15)]
    rows = []
    for i in range(60):
        w = [f"w{rnd.randrange(9 if i % 3 else 400)}" for _ in range(rnd.randrange(40))]
        for _ in range(i % 4):
            own = items[rnd.randrange(15)][1].split()
            at, a = rnd.randrange(len(w) + 1), rnd.randrange(len(own))
            w[at:at] = own[a : a + rnd.choice([9, 10, 11, 30])]
        rows.append((i, rnd.choice([" ", ", ", "\n- "]).join(w)))
    assert got(spark, rows, items) == brute(rows, items)


def test_nulls_repeats_and_letters_beyond_ascii(spark):
    ten = "É b c d e f g h i j"
    items = [(1, ten), (1, ten), (2, f"x {ten} y"), (None, "lone words of nobody a b c d e f"), (3, None), (4, "!!"), (5, "solo")]
    rows = [(1, f"a {ten}."), (1, ten.lower()), (None, f"q {ten} {ten}"), (None, f"q {ten} {ten}"), (2, None), (3, ""), (4, "--"), (5, "lone words of nobody a b c d e f"), (6, "a b"), (7, "Solo so-lo SOLO"), (8, "solİ soloİ solo")]
    assert got(spark, rows, items) == brute(rows, items)


def test_a_text_of_one_word_over_and_over(spark):
    items, rows = [(1, "a " * 12), (2, "b " * 10)], [(1, "a " * 5000), (2, "a " * 9), (3, ("a " * 10 + "c ") * 300)]
    assert got(spark, rows, items) == brute(rows, items)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_every_run_keeps_its_name_in_other_surroundings(spark):
    rnd = random.Random(3)
    run = [rnd.getrandbits(40) for _ in range(10)]
    texts = [[rnd.getrandbits(40) for _ in range(k)] + run + [rnd.getrandbits(40) for _ in range(7)] for k in range(20)]
    found = spark.createDataFrame([(t,) for t in texts], "h array<bigint>").select(names(F.col("h"), 10).alias("n")).collect()
    assert len({r.n[k] for k, r in enumerate(sorted(found, key=lambda r: len(r.n)))}) == 1


def test_spans_and_items(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a b {item} c")], "doc_id long, text string")
    r = contamination(docs, spark.createDataFrame([("q10", item), ("q9", item)], "item_id string, text string")).first()
    assert [(s.at, s.length) for s in r.spans] == [(2, 10), (3, 10), (4, 10)] and list(r["items"]) == ["q10", "q9"] and r.n_hit == 12
    assert all(b.at - a.at == 1 for a, b in pairwise(r.spans))
