from __future__ import annotations

import hashlib
import random
import re

import pytest

from larder.llm.automaton import SuffixAutomaton
from larder.llm.substrings import remove_reference_spans, remove_repeats


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed, docs, alphabet):
    rnd = random.Random(seed)
    passages = [[f"p{rnd.randrange(alphabet)}" for _ in range(rnd.choice([20, 49, 50, 51, 60, 90, 130]))] for _ in range(8)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(rnd.randrange(0, 5)):
            w += [f"é{rnd.randrange(alphabet)}" for _ in range(rnd.randrange(0, 60))]
            p = passages[rnd.randrange(8)][:]
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "changed"
            if rnd.random() < 0.3:
                p = p[rnd.randrange(len(p)) :]
            w += p
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
        if rnd.random() < 0.1 and rows:
            rows.append((1000 + i, rows[rnd.randrange(len(rows))][1].replace(" ", "  ")))
    return rows + [(5000, None), (5001, ""), (5002, "x " * 3000), (5003, "y x " + "x " * 2000), (5004, "x y " * 700), (5005, "z" * 40000)]


@pytest.mark.parametrize(("seed", "crowd", "alphabet"), [(1, 3000, 300), (2, 3, 300), (3, 3000, 3), (4, 0, 40)])
def test_equals_brute_force(spark, seed, crowd, alphabet):
    rows = corpus(seed, 70, alphabet)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows, 50) and len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert hashlib.sha256(" ".join(words(text if r.kept_text is None else r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_repeated_and_null_ids_extra_columns_and_empty(spark):
    long = " ".join(f"w{k}" for k in range(60))
    frame = spark.createDataFrame([(1, long, 1), (1, long, 2), (1, "q " + long, 3), (None, long, 4), (2, long + " r", 5)], "doc_id long, text string, th int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(frame).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (1, 61, 0), (2, 61, 60)]
    assert remove_repeats(frame.limit(0)).count() == 0


def test_automaton_owners_equal_search():
    rnd = random.Random(4)
    for _ in range(200):
        texts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 14))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for k, t in enumerate(texts):
            automaton.add(t, 10 - k)
        automaton.finish()
        asked = [rnd.randrange(3) for _ in range(20)]
        for n in (1, 3, 5):
            want = [min((10 - k for k, t in enumerate(texts) if any(t[j : j + n] == asked[e - n + 1 : e + 1] for j in range(len(t) - n + 1))), default=None) if e >= n - 1 else None for e in range(20)]
            assert list(automaton.owners(asked, n)) == want


def test_reference_spans(spark):
    ref = [f"r{k}" for k in range(80)]
    docs = spark.createDataFrame([(1, "a " + " ".join(ref[10:70]) + " b"), (2, " ".join(ref[:49])), (3, None)], "doc_id long, text string")
    refs = spark.createDataFrame([(" ".join(ref),), (None,)], "text string")
    assert sorted((r.doc_id, r.n_removed, r.kept_text[:3]) for r in remove_reference_spans(docs, refs).collect()) == [(1, 60, "a b"), (2, 0, "r0 "), (3, 0, "")]
    with pytest.raises(ValueError):
        from larder.llm.substrings import reference_automata

        reference_automata(refs, most_words=10)
