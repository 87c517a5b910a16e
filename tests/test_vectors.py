"""The approximate index, the search that never comes short, and 16-bit vectors, against exact search."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import halves as H
from larder.operators import retrieval as R
from larder.operators import vector_index as V
from larder.plans.all import QUERIES

FOLDER = "/root/testdata/sf0.1"


def table(spark, vectors, labels=None):
    rows = [(i, None if v is None else [float(x) for x in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def asked_of(vectors, which="vec_id % 20 = 0"):
    return vectors.where(which).select(F.col("vec_id").alias("query"), "embedding")


def clusters(n, seed=1, centres=40, spread=0.35):
    rnd = np.random.default_rng(seed)
    own = rnd.integers(centres, size=n)
    return rnd.normal(size=(centres, 32))[own] + spread * rnd.normal(size=(n, 32)), own


def recall(got, want):
    found = {(r["query"], r["id"]) for r in got}
    return sum((r["query"], r["id"]) in found for r in want) / len(want)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
def test_query_reaches_its_recall_and_prunes(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = QUERIES["vec_index"](spark, FOLDER).collect()
    want = R.top_k_many(vectors, asked_of(vectors), 5).collect()
    assert recall(got, want) >= 0.9 and len(got) == len(want)
    n, compared = vectors.count(), {r["query"]: r["compared"] for r in got}
    assert sum(compared.values()) <= 0.1 * n * len(compared)


def test_clustered_vectors_need_few_lists(spark, tmp_path):
    vectors = table(spark, clusters(3000)[0])
    model = V.train(vectors, lists=64)
    index = V.build(vectors, model, str(tmp_path / "index"))
    asked = asked_of(vectors)
    got = V.search(index, asked, model, 5, 4).collect()
    assert recall(got, R.top_k_many(vectors, asked, 5).collect()) >= 0.95
    assert sum({r["query"]: r["compared"] for r in got}.values()) <= 0.1 * 3000 * asked.count()


def test_lists_and_parts_change_nothing(spark, tmp_path, monkeypatch):
    # All lists and no cut is exact search, also where one list holds nearly all vectors and is dealt out in blocks.
    vectors = np.vstack([np.ones((150, 8)), np.eye(8), np.random.default_rng(2).normal(size=(60, 8))])
    frame = table(spark, vectors)
    model = V.train(frame, lists=5)
    whole = V.Quantiser(model.centroids, model.directions, 10_000)
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "CELL", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # cells of many batches
    index = V.build(frame, whole, str(tmp_path / "index"))
    key = lambda rows: sorted((r["query"], r["rank"], r["id"], round(r["similarity"], 5)) for r in rows)
    asked = asked_of(frame, "vec_id >= 150")
    try:
        got = V.search(index, asked, whole, 4, whole.lists).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exact = R.top_k_many(frame, asked, 4).collect()
    assert [x[3] for x in key(got)] == pytest.approx([x[3] for x in key(exact)], abs=1e-5) and len(got) == len(exact)
    assert {r["compared"] for r in got} == {len(vectors) - 1}


def test_cells_give_k_hits_a_query_however_many_lists(spark, tmp_path):
    frame = table(spark, np.random.default_rng(9).normal(size=(2000, 16)))
    asked = asked_of(frame)
    for lists in (20, 200):
        model = V.train(frame, lists=lists)
        index = V.build(frame, model, str(tmp_path / f"index{lists}"))
        met = V._meet(index, V.asking(asked, model), 5, None, True)
        assert 5 * asked.count() <= met.count() <= 5 * asked.count() * V.CELLS


def test_filtered_search_never_comes_short(spark, tmp_path):
    vectors, own = clusters(1500)
    labels = np.where(own == 7, 1, 0)
    labels[:3] = 2
    frame = table(spark, [*vectors, None], [*labels, 2])
    model = V.train(frame, lists=32)
    index = V.build(frame, model, str(tmp_path / "index"), columns=("label",))
    asked = asked_of(frame)
    for label, n in ((1, int((labels == 1).sum())), (2, 3), (9, 0)):
        got = V.search_filtered(index, asked, model, 5, F.col("label") == label, probes=1).collect()
        exact = R.top_k_many(frame.where(F.col("label") == label), asked, 5).collect()
        per = {}
        for r in got:
            per[r["query"]] = per.get(r["query"], 0) + 1
        want = {}
        for r in exact:
            want[r["query"]] = want.get(r["query"], 0) + 1
        assert per == want and (n or not got)
        if label == 2:  # all lists are asked where there is too little, so those hits are exact
            assert {(r["query"], r["id"]) for r in got} == {(r["query"], r["id"]) for r in exact}
    easy = V.search_filtered(index, asked, model, 5, F.lit(True), probes=8).groupBy("query").agg(F.max("rounds").alias("n")).collect()
    assert {r["n"] for r in easy} == {1}


def test_no_vectors(spark, tmp_path):
    nothing = table(spark, [None, None])
    model = V.train(nothing)
    index = V.build(nothing, model, str(tmp_path / "index"))
    assert V.search(index, asked_of(nothing), model, 3, 1).count() == 0 and V.search_filtered(index, asked_of(nothing), model, 3, F.lit(True)).count() == 0


def test_halves(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=32)
    vectors = [base + 1e-4 * rnd.normal(size=32) for _ in range(300)] + [rnd.normal(size=32) for _ in range(300)] + [None, np.zeros(32)]
    frame = table(spark, vectors)
    stored = frame.select("vec_id", H.to_half(F.col("embedding")).alias("half"))
    held = {r["vec_id"]: (len(r["half"]), r["v"]) for r in stored.where("half is not null").select("vec_id", "half", H.from_half(F.col("half")).alias("v")).collect()}
    assert len(held) == 601 and {n for n, _ in held.values()} == {64}
    assert all(np.array_equal(np.array(v, np.float16), np.array(vectors[i], np.float32).astype(np.float16)) for i, (_, v) in held.items())
    query = [float(x) for x in np.float32(base)]
    got = [r["vec_id"] for r in H.top_k_halves(stored, frame, query, 20).collect()]
    assert got == [r["vec_id"] for r in R.top_k(frame.where("vec_id < 600"), query, 20, "vec_id").collect()]
    assert H.top_k_halves(stored.limit(0), frame, query, 3).count() == 0
    with pytest.raises(Exception, match="16 bits"):
        table(spark, [[1e6]]).select(H.to_half(F.col("embedding"))).collect()


def test_exact_search_holds_a_strip_of_products():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(6000, 16)).round(3)
    group = pa.table({"id": np.arange(6000), "vector": vectors.tolist(), "asks": np.arange(6000) < 3000})
    tracemalloc.start()
    got = R._nearest(group, 5, True).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = [(q, 3000 + v) for q in range(3000) for v in np.argsort(-(unit[q] @ unit[3000:].T), kind="stable")[:5]]
    print("MB", peak / 1e6)
    assert list(zip(got["query"], got["id"], strict=True)) == want and peak < 40e6  # all products: 72 MB


def test_equal_directions_are_ties_by_id(spark):
    base = np.random.default_rng(5).normal(size=(3, 7))
    vectors = table(spark, np.concatenate([base[k % 3] * (1 + k / 7) for k in range(300)]).reshape(300, 7))
    got = {(r["query"], r["rank"]): r["id"] for r in R.top_k_many(vectors, asked_of(vectors), 6).collect()}
    assert got == {(q, n + 1): i for q in range(0, 300, 20) for n, i in enumerate([i for i in range(q % 3, 300, 3) if i != q][:6])}


def test_odd_vectors_are_left_out_or_far(spark):
    vectors = table(spark, [[1, 0], None, [0, 0], [float("nan"), 1], [2, 0.1], [-1, 0]])
    got = [(r["query"], r["id"], r["rank"]) for r in R.top_k_many(vectors, asked_of(vectors, "vec_id = 0"), 9).collect()]
    assert sorted(got) == [(0, 2, 2), (0, 4, 1), (0, 5, 3)]


def test_each_trigram_is_hashed_once(monkeypatch):
    import hashlib

    from larder.operators import predict as U

    def plain(text, dimension):
        v, padded = np.zeros(dimension), f"  {text.lower()} "
        for k in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[k : k + 3].encode(), digest_size=8).digest(), "big")
            v[h % dimension] += 1 if h >> 63 else -1
        return (v / (np.linalg.norm(v) or 1)).tolist()

    texts = ["", "a", "Two Words", "\u0130I\0", "\U0001f600\u65e5\u672c " * 40, "abcd " * 60_000]
    want, calls, real = [plain(t, 24) for t in texts], [], hashlib.blake2b
    monkeypatch.setattr(U.hashlib, "blake2b", lambda *a, **b: calls.append(a) or real(*a, **b))
    model = U.HashedNgrams(24)
    assert model.embed(texts) == want and model.embed(texts) == want and model.embed([]) == []
    assert len(calls) == len({f"  {t.lower()} "[k : k + 3] for t in texts for k in range(len(t.lower()) + 1)})
