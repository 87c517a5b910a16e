"""Queries do the whole job: no rows, names or classes are left out."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from larder.functions.text import key_words
from larder.operators import aliases as A
from larder.operators import retrieval as R
from larder.operators import sampling as S
from larder.plans.all import QUERIES

FOLDER = "/root/testdata/sf0.001"
shared = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")


@shared
def test_texts_of_every_length_are_classified(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("doc_id", "lang", "text")
    want = {r.doc_id: r.n for r in S.stratified_split(rows, "lang", "doc_id").where("is_test").select("doc_id", F.length("text").alias("n")).collect()}
    got = {r.code for r in QUERIES["ml_logreg"](spark, FOLDER).collect()}
    assert got == set(want) and max(want.values()) >= 1500
    full = QUERIES["ml_run_tfidf"](spark, FOLDER).where("dataset = 'full'").first().products
    assert full == sum(round(0.2 * r["count"]) for r in docs.groupBy("lang").count().collect())


def test_split_ranks_no_texts_and_counts_repeated_ids(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("code"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("y"), F.lit("text").alias("text"))
    got = S.stratified_split(rows, "y")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.y: r["count"] for r in got.where("is_test").groupBy("y").count().collect()} == {"a": 600, "b": 200}
    key = F.md5(F.concat("code", F.lit("20260905")))
    least = {r.code for y, n in (("a", 600), ("b", 200)) for r in rows.where(F.col("y") == y).orderBy(key).limit(n).collect()}
    assert {r.code for r in got.where("is_test").collect()} == least
    same = S.stratified_split(spark.createDataFrame([("x", "a", str(k % 7)) for k in range(100)] + [(None, "a", "n")], "code string, y string, text string"), "y")
    assert {r.is_test: r["count"] for r in same.groupBy("is_test").count().collect()} == {True: 20, False: 81}


@shared
def test_names_of_the_whole_text_are_grounded(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text").collect()}
    words = {i: re.split(r"[^a-z0-9_]+", (r.text or "").lower(), flags=re.ASCII) for i, r in docs.items()}
    forms = {w: [w] for i, r in docs.items() if r.lang == "en" for w in words[i] if len(w) > 4}
    got = {r.doc_id: r.grounded for r in QUERIES["txt_sugar_grounded"](spark, FOLDER).collect()}
    assert got == {i: A.grounded([w for w in words[i] if w in forms], key_words(r.text), {w: [w.split()] for w in forms}) for i, r in docs.items()}
    assert any(set(got[i]) - set(words[i][:5]) for i in docs)


@shared
def test_index_finds_the_nearest(spark):
    got = {(r.query, r.id) for r in QUERIES["vec_index"](spark, FOLDER).collect()}
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    want = {(r.query, r.id) for r in R.top_k_many(vectors, asked, 5).collect()}
    print("recall", len(got & want), len(want))
    assert len(want) >= 5 and len(got & want) >= 0.9 * len(want) and len(got) <= len(want)


def test_features_are_read_in_small_batches(spark):
    import pyarrow.parquet as pq

    from larder.operators import classify as L

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.md5(F.concat(F.col("id").cast("string"), F.lit("-"), k.cast("string")))), " ")
    rows = L.counted(spark.range(600).repartition(1).select("id", words.alias("text")), "text", 200_000)
    assert rows.count() == 600
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(k).num_rows for f in rows.inputFiles() for k in range(pq.ParquetFile(f.removeprefix("file://")).num_row_groups)]
    most = rows.select("vector").first().vector.indices.size
    print("rows of a group", max(sizes), "features of a row", most)
    assert sum(sizes) == 600 and max(sizes) * most * 12 <= 24e6


def test_texts_that_no_model_reads_stay_in_the_jvm(spark):
    from larder.operators import predict as U

    rows = [(k, None if k % 7 == 0 else f"text {k}", None if k % 5 == 0 else k % 3 > 0, k % 2 > 0) for k in range(700)]
    frame = spark.createDataFrame(rows, "code long, text string, is_usable boolean, too_long boolean").coalesce(1)
    got = U.extract(frame, lambda: U.FakeLLM(lambda p: f'{{"unreadable": {"true" if p.endswith("1") else "false"}}}', failures=1), "{text}", {})
    want = lambda text, usable, long: ("unreadable", "too_long" if long else "empty") if not usable else ("unreadable", "model_unreadable") if str(text).endswith("1") else ("ok", None)
    assert {r.code: (r.status, r.skip_reason) for r in got.collect()} == {str(k): want(*row) for k, *row in rows}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN is_usable" in plan and "MapInArrow" in plan


def test_documents_without_text_have_the_status_of_the_sql(spark, tmp_path):
    import duckdb

    from larder.plans.all import ORACLES

    rows = [(1, None), (2, ""), (3, " "), (4, "a" * 9830), (5, "a" * 9831), (6, "\N{GRINNING FACE}" * 9830), (7, "{x}")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = sorted(con.execute(ORACLES["udf_extract"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["udf_extract"](spark, str(tmp_path)).collect()) == want
    assert {s for _, s in want} == {"ok", "unreadable"}


@shared
def test_every_vector_has_its_similar_ones(spark):
    import numpy as np

    rows = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids = [i for i, _ in rows]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    want = {(q, ids[n], place + 1) for k, q in enumerate(ids) for place, n in enumerate(sorted((n for n in range(len(ids)) if n != k), key=lambda n: (-sims[k, n], ids[n]))[:5])}
    assert {tuple(r) for r in QUERIES["vec_similar"](spark, FOLDER).collect()} == want


def test_blocks_are_searched_exactly_in_parts(monkeypatch):
    """Ids that repeat, equal vectors, and some that differ by less than 32 bits can tell."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(R, "BLOCK", 97)
    monkeypatch.setattr(R, "STRIP", 10)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6))
    v[300:340], v[340:380] = v[7], v[8] + rng.normal(size=(40, 6)) * 1e-8
    ids = rng.permutation(400)
    ids[390:] = ids[:10]
    v = v[np.argsort(ids, kind="stable")]
    ids.sort()
    asks = np.r_[np.ones(400, bool), np.zeros(400, bool)]
    both = pa.array(np.concatenate([v, v]).tolist(), pa.list_(pa.float64()))
    got = R._nearest(pa.table({"id": np.r_[ids, ids], "vector": both, "asks": asks}), 5, True).to_pydict()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(np.einsum("ij,kj->ik", unit, unit), 9)
    want = sorted((ids[q], s, n) for q in range(400) for s, n in sorted(((-sims[q, n], ids[n]) for n in range(400) if ids[n] != ids[q]))[:5])
    assert sorted((q, -s, n) for q, s, n in zip(got["query"], got["__ranked"], got["id"], strict=True)) == want


def test_features_are_those_of_hashing_and_written_once(spark):
    import numpy as np
    from pyspark.ml.feature import HashingTF

    from larder.operators import classify as L
    from larder.session import shared_folder

    texts = ["", " \t ", "a", "é", "\N{GRINNING FACE} ÀÉ İstanbul ΣΑΣ a\x0bb c", "ab ab AB", "the words of a text " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "code long, text string").coalesce(2)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/larder-core")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {p.getPath().getName() for p in store.listStatus(folder)} if store.exists(folder) else set()
    had = tables()
    got = {r.code: r.vector for r in L.counted(rows, "text", 5000).collect()}
    assert [name.split("-")[0] for name in tables() - had] == ["features"]
    for r in HashingTF(inputCol="grams", outputCol="vector", numFeatures=5000).transform(rows.withColumn("grams", L.char_wb(F.col("text")))).collect():
        assert got[r.code].indices.tolist() == r.vector.indices.tolist()
        assert np.allclose(got[r.code].values, 1 + np.log(r.vector.values), rtol=1e-14, atol=0)


def test_the_regression_is_spark_s_own_and_leaves_nothing(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    from larder.operators import classify as L
    from larder.session import shared_folder

    words = ["sugar salt", "salz zucker", "sel sucre", "oil water", "wasser milch", "eau lait"]
    texts = [(k, " ".join(words[(k * j + k // 3) % 6] for j in range(1 + k % 7)) if k % 11 else "", "abc"[(k % 3) * (k % 5 > 0)]) for k in range(120)]
    rows = spark.createDataFrame(texts, "code long, text string, label_text string").coalesce(3)
    model = L.fit(rows, "text", vocabulary=500, min_df=2)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/larder-core")
    assert not [p for p in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if p.getPath().getName().startswith("packed")]

    plain = L.counted(L.balanced_weights(rows).withColumn("label", F.instr(F.lit("abc"), F.col("label_text")) - 1.0), "text", 500)
    idf = IDF(inputCol="vector", outputCol="idf").fit(plain)
    scale = np.where(np.array(idf.docFreq) >= 2, 1 + idf.idf.toArray(), 0.0)
    unit = Normalizer(inputCol="weighed", outputCol="features").transform(ElementwiseProduct(inputCol="vector", outputCol="weighed", scalingVec=Vectors.dense(scale)).transform(plain))
    spark_s = LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / 120, maxIter=400).fit(unit)
    assert np.allclose(model.idf, scale)
    assert np.abs(model.weights - spark_s.coefficientMatrix.toArray() * scale).max() < 0.01 * np.abs(model.weights).max()
    assert np.abs(model.bias - spark_s.interceptVector.toArray()).max() < 0.02
    got = {r.code: r.predicted for r in model.predict(rows).collect()}
    assert got == {r.code: "abc"[int(r.prediction)] for r in spark_s.transform(unit).collect()}
