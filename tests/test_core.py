"""Hand-computed cases of the operators, and the invariants between the two product sources."""

from __future__ import annotations

import gzip
import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions import numbers as N
from larder.functions import products as P
from larder.functions import text as X
from larder.operators import aliases as A
from larder.operators import classify as L
from larder.operators import corpus as C
from larder.operators import gate as G
from larder.operators import merge as M
from larder.operators import metrics as E
from larder.operators import predict as U
from larder.operators import ranking as O
from larder.operators import sampling as S
from larder.operators import sqlguard as Q
from larder.schemas import DUMP, LANGUAGES, PREDICTION
from larder.session import apply_settings
from larder.sources import files as R
from larder.sources import sinks as K
from larder.streaming import deltas as D


def product(code, **more):
    row = {
        "code": code, "lang": "en", "ingredients_text": [{"lang": "main", "text": "sugar, salt, cocoa"}, {"lang": "en", "text": " sugar, salt, cocoa "}], "product_name": [{"lang": "en", "text": "Bar"}],
        "categories_tags": ["en:sweet-snacks"], "nutriscore_grade": " D ", "nova_group": 4, "nutriments": [{"name": "sugars", "100g": 44.5}, {"name": "sugars", "100g": 45.0}, {"name": "iron", "100g": 1.0}, {"name": "fat", "value": 1.0}],
        "unknown_ingredients_n": 1, "unique_scans_n": 3, "rev": 5, "obsolete": False,
    }
    return row | more


@pytest.fixture()
def dump(spark):
    apply_settings(spark)
    rows = [
        product("1000000000001"), product("1000000000002", lang="ru", ingredients_text=[{"lang": "ru", "text": "сахар, какао-масло"}]), product("1000000000003", ingredients_text=[{"lang": "de", "text": "Zucker, Kakaobutter"}, {"lang": "fr", "text": "sucre, sel"}]),
        product("2000000000001", ingredients_text=[]), product("2000000000002", ingredients_text=[{"lang": "en", "text": "short"}]), product("2000000000003", ingredients_text=[{"lang": "ja", "text": "砂糖と塩とカカオバターを含む"}]), product("2000000000004", obsolete=True),
        product("2000000000005", data_quality_errors_tags=["en:bad"]), product("2000000000006", categories_tags=["en:meats"]), product("2000000000007", ingredients_text=[{"lang": "main", "text": "sugar, salt, cocoa"}]), product("2000000000008", unique_scans_n=None), product("12x"),
    ]
    return spark.createDataFrame([tuple(r.get(f.name) for f in DUMP) for r in rows], DUMP)


def test_corpus_filter_keeps_exactly_the_right_codes(dump):
    raw = R.from_dump(dump)
    assert sorted(r.code for r in raw.where(C.corpus_predicate()).collect()) == ["1000000000001", "1000000000002", "1000000000003"]
    row = raw.where("code = '1000000000001'").first()
    assert row.ingredients_text == {"en": "sugar, salt, cocoa"} and row.nutriments == {"sugars": 45.0}
    out = {r.code: r for r in P.product_rows(raw).collect()}
    assert out["1000000000001"].nutriscore_grade == "d" and out["1000000000001"].salt_100g is None and float(out["1000000000001"].sugars_100g) == 45.0
    assert out["1000000000003"].lang == "de" and out["1000000000003"].ingredients_text.startswith("Zucker") and out["2000000000001"].ingredients_text is None


def test_one_product_in_both_formats_is_the_same_row(spark, dump, tmp_path):
    record = {"code": "1000000000001", "lang": "en", "ingredients_text_en": " sugar, salt, cocoa ", "ingredients_text_en_debug_tags": "x", "product_name_en": "Bar", "categories_tags": ["en:sweet-snacks"], "nutriscore_grade": " D ", "nova_group": 4, "nutriments": {"sugars_100g": 45.0, "sugars_unit": "g", "fat_100g": "n/a"}, "unknown_ingredients_n": 1, "unique_scans_n": 3, "rev": 5, "obsolete": False}
    with gzip.open(tmp_path / "d_1704067200_1704153600.json.gz", "wt") as f:
        f.write(json.dumps(record) + "\n\n{broken\n" + json.dumps(record | {"code": "x"}) + "\n")
    lines = R.read_delta_lines(spark, str(tmp_path))
    assert lines.count() == 3 and lines.where("broken").count() == 1
    got = R.from_delta(lines).collect()
    assert len(got) == 1
    want = R.from_dump(dump).where("code = '1000000000001'").first().asDict()
    assert got[0].asDict() | {"source": 0} == want | {"source": 0}


def test_index_watermark_and_gap(spark, tmp_path):
    (tmp_path / "index.txt").write_text("b_1704153600_2.json.gz\nreadme\na_1704067200_1.json.gz\nnone.gz\n")
    files = R.parse_index(spark, str(tmp_path / "index.txt"))
    assert [r.timestamp for r in files.collect()] == [1704067200, 1704153600]
    assert R.select_files(files, 1704067200).count() == 1 and R.select_files(files, None).count() == 2
    assert R.retention_gap(files, 1).first().gap and not R.retention_gap(files, 1704067200).first().gap and not R.retention_gap(files, None).first().gap


@pytest.mark.parametrize(("old", "new", "wins"), [(None, None, True), (None, 1, True), (3, None, False), (3, 2, False), (3, 3, True), (3, 4, True)])
def test_revision_guard(spark, old, new, wins):
    schema = "code string, rev int, v string"
    stored = spark.createDataFrame([("a", old, "old"), ("k", 1, "kept")], schema)
    incoming = spark.createDataFrame([("a", new, "new"), ("z", None, "added")], schema)
    got = {r.code: r.v for r in M.merge_by_revision(stored, incoming).collect()}
    assert got == {"a": "new" if wins else "old", "k": "kept", "z": "added"}
    again = M.merge_by_revision(M.merge_by_revision(stored, incoming), incoming)
    assert {r.code: r.v for r in again.collect()} == got


def test_duplicates_in_a_batch(spark):
    schema = "code string, rev int, v string, position int"
    stored = spark.createDataFrame([("a", 1, "old", 0)], schema)
    incoming = spark.createDataFrame([("a", 2, "x", 1), ("a", 3, "y", 2), ("a", 3, "z", 3), ("a", None, "n", 4)], schema)
    assert M.merge_by_revision(stored, incoming, position="position").first().v == "z"


def test_stream_and_files_end_in_the_same_state(spark, tmp_path):
    schema = "code string, rev int, v string"
    parts = [[("a", 1, "a1"), ("b", 5, "b5")], [("a", 3, "a3"), ("c", None, "c")], [("a", 2, "late"), ("b", None, "null"), ("c", 1, "c1")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"f{k}"))
    state, mark = D.apply_files(spark.createDataFrame([], schema), [(k, str(tmp_path / f"f{k}")) for k in range(3)] + [(9, str(tmp_path / "gone"))], lambda p: spark.read.parquet(p), None)
    assert mark == 2
    merged = lambda: {tuple(r) for r in D.stream_merge(spark, str(tmp_path / "in"), schema, str(tmp_path / "table"), str(tmp_path / "cp"), "code", "rev").collect()}
    want = {("a", 3, "a3"), ("b", 5, "b5"), ("c", 1, "c1")}
    assert {tuple(r) for r in state.collect()} == want == merged()
    assert merged() == want  # no new files
    spark.createDataFrame([("d", 1, "d1"), ("a", 1, "old")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert merged() == want | {("d", 1, "d1")}


def test_windows_on_a_stream_equal_those_on_a_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:1{m}:00", e, 1.0) for h in range(6) for m in range(3) for e in ("a", "b")]
    frame = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "e"))
    query = D.windowed_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from w").collect()} == {tuple(r) for r in D.windowed_counts(frame).collect()}


def test_text_functions(spark):
    row = spark.range(1).select(
        X.normalize_key(F.lit("  Süß-Molke_(Pulver), ЙОД ")).alias("key"), X.prepare_text(F.lit(" - a &amp; <b>b</b>  c. ")).alias("prep"), X.strip_markup(F.lit("<p>a</p>\n b")).alias("markup"), X.clean_category(F.lit(" en:sweet-snacks")).alias("cat"),
        X.first_brand(F.lit(" A , B")).alias("brand"), X.strip_tag_prefix(F.lit("en:")).alias("tag"), X.detect_language(F.lit("привет мир и all")).alias("ru"), X.detect_language(F.lit("abc")).alias("short"), X.citations(F.lit("[123456] [12] [999999] [123456]")).alias("cited"),
        X.normalize_barcode(F.lit(" 123456\n")).alias("code"), X.mentions_alias(F.lit("из сахара"), F.array(F.lit("сахар"))).alias("m1"), X.mentions_alias(F.lit("несахар"), F.array(F.lit("сахар"))).alias("m2"), X.tokens_present(F.lit("syrup of glucose"), F.lit("glucose syrup")).alias("tokens"),
    ).first()
    assert row.key == "suß molke pulver иод" and row.prep.text == "a & b c" and row.prep.had_markup and row.prep.is_usable and row.markup == "a b" and row.cat == "sweet snacks"
    assert (row.brand, row.tag, row.ru, row.short, row.cited, row.code, row.m1, row.m2, row.tokens) == ("A", "en:", "ru", "", ["123456", "999999"], "123456", True, False, True)


FORMS = {"sugar": ["sugar", "сахар"], "glucose syrup": ["glucose syrup", "глюкозный сироп"], "glucose-fructose syrup": ["glucose fructose syrup", "глюкозно фруктозный сироп"], "honey": ["honey"], "glucose": ["glucose"]}
GROUNDING = [
    (["sugar", "honey"], "Sugars, salt", ["sugar"]),
    (["sugar"], "без сахара", ["sugar"]),
    (["sugar"], "несахар", []),
    (["glucose syrup", "Glucose-Fructose Syrup"], "water, glucose-fructose syrup", ["glucose-fructose syrup"]),
    (["glucose", "glucose fructose syrup"], "Water, glucose-fructose syrup", ["glucose-fructose syrup"]),
    (["glucose", "glucose fructose syrup"], "Glucose-fructose syrup, water, glucose", ["glucose", "glucose-fructose syrup"]),
    (["glucose-fructose syrup"], "Мука, сироп глюкозно-фруктозный", ["glucose-fructose syrup"]),
    (["glucose-fructose syrup"], "Вода, сироп из топинамбура", []),
    (["Сахар", "salt"], "SUGAR", ["sugar"]),
    (["honey"], "", []),
    (None, "honey", []),
    (["honey", None], None, []),
]


@pytest.mark.parametrize("bound", [200_000, 3])
def test_grounding_cases(spark, monkeypatch, bound):
    monkeypatch.setattr(A, "MAX_BROADCAST", bound)
    aliases = [(alias, "xx", name, "sugar", k) for k, (name, own) in enumerate(FORMS.items()) for alias in own] + [("salt", "xx", "salt", "base", 9)]
    frame = spark.createDataFrame([(k, *case[:2]) for k, case in enumerate(GROUNDING)], "id int, names array<string>, text string")
    got = {r.id: r.grounded for r in A.ground(frame, spark.createDataFrame(aliases, "alias_key string, lang string, canonical_name string, kind string, line int")).collect()}
    assert got == {k: case[2] for k, case in enumerate(GROUNDING)}


def test_one_pass_grounds_as_alias_by_alias():
    rng = random.Random(5)
    stem = lambda: "".join(rng.choices("ab", k=rng.randint(1, 3)))
    for _ in range(3000):
        forms = {f"n{k}": [" ".join(stem() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))] for k in range(rng.randint(0, 6))}
        words, names = [stem() for _ in range(rng.randint(0, 12))], rng.sample(["n0", "n1", "n2", "n3", "n4", "n5", "n9"], rng.randint(0, 7))
        assert A.Forms(forms).mentioned(names, words) == A.grounded(names, words, {name: [alias.split() for alias in own] for name, own in forms.items()})


def test_plain_judging_grounds_as_alias_by_alias(monkeypatch):
    rng = random.Random(8)
    stem = lambda most: "".join(rng.choices("ab", k=rng.randint(1, most)))
    monkeypatch.setattr(A.Forms, "_places", None)  # no automaton for such names
    for _ in range(5000):
        own = {stem(5) for _ in range(rng.randint(0, 9))}
        forms = {f"n{k}": [alias] for k, alias in enumerate(sorted(own))} | {"n7": [""], "n8": []}
        words, names = [stem(6) for _ in range(rng.randint(0, 12))], rng.sample([f"n{k}" for k in range(10)], 7)
        assert A.Forms(forms).mentioned(names, words) == A.grounded(names, words, {name: [alias.split() for alias in some] for name, some in forms.items()})


def test_a_chunk_of_plain_names_needs_no_automaton(monkeypatch):
    monkeypatch.setattr(A, "ahocorasick", None)
    words = ["molasses", "treacle", "sirup", "siruptopf", "Mélasse", "Honey"]
    rows = pa.table({"chunk": pa.array([7] * 3), "row": pa.array(range(3)), "lang": ["", "", "de"], "names": [words, None, words], "text": ["Molasses and honey", "sirup", "Siruptopf, MELASSE"]})
    asked = pa.Table.from_batches(A._asked(iter(rows.combine_chunks().to_batches()))).to_pylist()
    assert sorted((r["chunk"], r["lang"], r["alias_key"]) for r in asked) == sorted((7, lang, w.lower().replace("é", "e")) for lang in ("", "de") for w in words)
    found = A._mentioned_of(rows, pa.Table.from_pylist([r | {"entry": [r["alias_key"].upper(), r["alias_key"]]} for r in asked]))
    assert found["grounded"].to_pylist() == [["HONEY", "MOLASSES"], [], ["MELASSE", "SIRUPTOPF"]]


def test_both_ways_of_grounding_agree(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 4)
    rng = random.Random(6)
    stem = lambda: "".join(rng.choices("abé", k=rng.randint(1, 3)))
    aliases = [(" ".join(stem() for _ in range(rng.randint(1, 2))), rng.choice(["en", "de", "xx", None]), f"n{rng.randint(0, 9)}", rng.choice(["sugar", "sugar", "base"]), line) for line in range(60)]
    aliases.append(("a_b", "en", "n1", "sugar", 99))
    rows = [(k % 90, None if k % 17 == 0 else [rng.choice([None, "", stem(), stem().upper(), f"{stem()} {stem()}"]) for _ in range(rng.randint(0, 8))], None if k % 13 == 0 else " ".join(stem() for _ in range(rng.randint(0, 20))), rng.choice(["en", "de", "", None]), "kept") for k in range(200)]
    dictionary = spark.createDataFrame(aliases, "alias_key string, lang string, canonical_name string, kind string, line int")
    frame = spark.createDataFrame(rows, "id int, names array<string>, text string, lang string, line string")
    for lang in (None, "lang"):
        small, large = A.ground(frame, dictionary, lang_col=lang), A.ground_by_shuffle(frame, dictionary, lang_col=lang)
        assert small.columns == large.columns == [*frame.columns, "grounded"]
        got = sorted(map(repr, small.collect()))
        assert got == sorted(map(repr, large.collect())) and len(got) == 200 and any("['n" in r for r in got)
    none = A.ground_by_shuffle(frame, dictionary.limit(0)).where("size(grounded) = 0").count()
    assert none == 200 and A.ground(frame, dictionary.limit(0)).where("size(grounded) = 0").count() == 200


def test_redaction_of_addresses(spark):
    cases = {"pg://u:p@h": "pg://u:***@h", "see a://b:c d://e:f@g @h": "see a://b:c d://e:***@g @h", "x://u:p@h, y://v:q@i": "x://u:***@h, y://v:***@i", "no@where a:b@c": "no@where a:b@c", "s://u:@h s:///:p@h": "s://u:@h s:///:p@h", "s://u@h:p@x": "s://u@h:p@x", "": ""}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.out for r in frame.select("t", K.redact(F.col("t"), ["zzz"]).alias("out")).collect()} == cases


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('// head\n{"canonical_name": "Sugar", "kind": "sugar", "aliases": {"en": ["Cane-Sugar"], "de": ["Zucker"]}}\n\n{"canonical_name": "x", "kind": "base", "aliases": {"en": ["zucker"]}}\n')
    got = {(r.alias_key, r.lang, r.canonical_name, r.line) for r in R.read_dictionary(spark, str(path)).collect()}
    assert got == {("sugar", "xx", "Sugar", 2), ("cane sugar", "en", "Sugar", 2), ("zucker", "de", "Sugar", 2), ("x", "xx", "x", 4), ("zucker", "en", "x", 4)}
    frame = R.read_dictionary(spark, str(path))
    assert A.conflicts(frame).first().alias_key == "zucker" and {r.alias_key: r.canonical_name for r in A.by_key(frame).collect()}["zucker"] == "Sugar"
    path.write_text('{"canonical_name": "a"}\n{oops\n')
    with pytest.raises(Exception, match="line 2"):
        R.read_dictionary(spark, str(path)).collect()


def test_macro_f1_counts_labels_seen_only_in_predictions(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), ("b", "b"), ("a", "a")], "t string, p string")
    assert abs(E.macro_f1(rows, "t", "p").first()[0] - (0.8 + 4 / 6 + 0) / 3) < 1e-9
    assert {(r.truth, r.predicted): r.n for r in E.confusion(rows, "t", "p").collect()}["c", "a"] == 0 and E.confusion(rows, "t", "p").count() == 9
    assert E.majority(rows.limit(0), "t").count() == 0 and tuple(E.majority(rows, "t").first()) == ("a", 0.5)


def test_order_statistics(spark):
    assert spark.createDataFrame([(float(k),) for k in range(1, 5)], "x double").agg(N.median(F.col("x"))).first()[0] == 2.5
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1.0, 2.0, 2.5, rnd.random()])) for _ in range(400)] + [("one", 5.0), ("none", None)]
    ranks = {"a": O.lower_middle(), "b": O.upper_middle(), "p": O.at_share(0.95)}
    got = {r.g: (r.a, r.b, r.p) for r in O.order_statistics(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", ranks).collect()}
    groups = {g: sorted(x for h, x in rows if h == g and x is not None) for g in ("a", "b", None, "one")}
    assert got == {g: (v[(len(v) - 1) // 2], v[len(v) // 2], v[min(int(0.95 * len(v)), len(v) - 1)]) for g, v in groups.items()}
    placed = O.global_rank(spark.createDataFrame([(k * 7 % 100, "z") for k in range(100)], "x int, place2 string").repartition(5), ["x"]).collect()
    assert all(r.place == r.x + 1 for r in placed) and len(placed) == 100 and O.global_rank(spark.createDataFrame([], "x int"), ["x"]).count() == 0
    assert {r.lang: r.quota for r in S.language_quotas(spark.createDataFrame([("de",), ("fr",), ("en",)], "lang string"), 7).collect()} == {"de": 3, "en": 2, "fr": 2}


def test_medians(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", None), ("b", 3.0), ("b", 1.0), ("b", 9.0), (None, 2.0), ("c", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    assert {r.g: r["median"] for r in O.medians(frame, ["g"], "x").collect()} == {"a": 2.5, "b": 3.0, None: 2.0, "c": None}
    assert O.medians(frame.limit(0), ["g"], "x").count() == 0


def test_baseline_is_written_by_asking(spark, tmp_path):
    metrics = spark.createDataFrame([("s", 0.6, 0.5, 0.12345), ("t", 0.1, 0.2, 0.3)], "system string, f1_ingredients double, f1_typed double, sugar_accuracy double")
    gold = spark.createDataFrame([("b",), ("a",)], "code string")
    path = str(tmp_path / "baseline")
    assert G.write_baseline(metrics, gold, path).count() == 6
    was, print_ = G.read_baseline(spark, path)
    assert {(r.system, r.metric, r["value"]) for r in was.collect()} == {(r.system, r.metric, r["value"]) for r in G.snapshot(metrics).collect()}
    assert G.run_gate(2, 2, was, G.snapshot(metrics), E.fingerprint(gold).first().digest, print_) == ("pass", [])
    assert G.run_gate(2, 2, was, G.snapshot(metrics), E.fingerprint(gold.limit(1)).first().digest, print_)[0] == "stale"
    for a, b in ((metrics.limit(0), gold), (metrics, gold.limit(0))):
        with pytest.raises(ValueError):
            G.write_baseline(a, b, path)
    assert G.read_baseline(spark, path)[0].count() == 6


def test_quota_sample_equals_a_window(spark):
    rows = [(k, "abc"[k % 3] if k % 10 else None, k % 2) for k in range(700)]
    frame = spark.createDataFrame(rows, "code long, g string, h int")
    nth = F.row_number().over(Window.partitionBy("g", "h").orderBy(X.shuffle_key(F.col("code"))))
    want = frame.withColumn("n", nth).where(F.col("n") <= F.when(F.col("h") == 1, 9).otherwise(200)).drop("n")
    got = S.quota_sample(frame, ["g", "h"], F.when(F.col("h") == 1, 9).otherwise(200))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_gate(spark):
    metrics = lambda *v: spark.createDataFrame([(s, m, x) for s, x in v for m in G.METRICS], "system string, metric string, value double")
    base = metrics(("a", 0.63), ("b", 0.5))
    assert G.run_gate(0, 1, base, base, "x", "x")[0] == G.run_gate(1, 0, base, base, "x", "x")[0] == G.run_gate(1, 1, None, base, "x", "x")[0] == "skip"
    assert G.run_gate(1, 1, base, base, "x", "y")[0] == "stale" and G.run_gate(1, 1, base, base, "x", "x") == ("pass", [])
    assert G.run_gate(1, 1, base, metrics(("a", 0.63)), "x", "x")[0] == "regress" and G.run_gate(1, 1, base, metrics(("a", 0.605), ("b", 0.5)), "x", "x")[0] == "pass"
    assert G.run_gate(1, 1, base, metrics(("a", 0.60), ("b", 0.5)), "x", "x")[0] == "regress"  # doubles: 0.63 - 0.60 is above 0.03


@pytest.mark.parametrize("sql", ["", "DELETE FROM products", "SELECT 1; SELECT 2", "SELECT * FROM products", "SELECT * FROM secrets LIMIT 5", "SELECT * FROM products, secrets LIMIT 5", "SELECT * FROM products WHERE code IN (SELECT code FROM secrets) LIMIT 5", "SELECT * FROM `secrets` LIMIT 5", "DROP TABLE products", "SELECT 1 LIMIT 1", "WITH x AS (SELECT * FROM secrets) SELECT * FROM x LIMIT 3", "WITH secret AS (SELECT * FROM secret) SELECT s.* FROM secret s, products LIMIT 5", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM products LIMIT 1", "SELECT id FROM range(1000000), products LIMIT 5", "SELECT * FROM parquet.`/tmp` LIMIT 1", "WITH RECURSIVE r AS (SELECT 1 AS id UNION ALL SELECT id + 1 FROM r) SELECT r.id FROM r, products LIMIT 3", "WITH a AS (SELECT id FROM products) SELECT * FROM (WITH products AS (SELECT * FROM secret) SELECT * FROM products) LIMIT 1"])
def test_guard_rejects(spark, sql):
    with pytest.raises(Q.RejectedSQL):
        Q.validate_sql(spark, sql)


BYPASSES = [
    "WITH `text.{f}` AS (SELECT id FROM products) SELECT s.* FROM text.`{f}` s, products LIMIT 1",
    "WITH `parquet.{f}` AS (SELECT id FROM products) SELECT s.* FROM parquet.`{f}` s, products LIMIT 1",
    "WITH `products.x` AS (SELECT id FROM products) SELECT * FROM products LIMIT 1",
    "SELECT * FROM `text.{f}`, products LIMIT 1",
    "SELECT * FROM spark_catalog.default.products LIMIT 1",
    "SELECT id FROM products WHERE id IN (SELECT value FROM text.`{f}`) LIMIT 1",
    "SELECT * FROM global_temp.products LIMIT 1",
    "SELECT missing FROM products LIMIT 1",
    "SELECT id FROM products WHERE 'a' COLLATE UNICODE_CI = 'A' LIMIT 1",
]


@pytest.mark.parametrize("sql", BYPASSES)
def test_guard_resolves_what_a_statement_reads(spark, tmp_path, sql):
    (tmp_path / "f").write_text("secret\n")
    spark.range(5).createOrReplaceGlobalTempView("products")
    with pytest.raises(Q.RejectedSQL):
        Q.run_sql(spark, sql.format(f=tmp_path / "f"), {"products": spark.range(100)})


def test_guard_compares_resolved_leaves(spark, monkeypatch):
    # Even a statement that the parsed check would let through is held to what the allowed tables read.
    monkeypatch.setattr(Q, "_check", lambda *_: 1)
    guard = Q.GuardedSession(spark, {"products": spark.range(100)})
    guard.spark.range(7).createOrReplaceTempView("secret")
    with pytest.raises(Q.RejectedSQL, match="not an allowed table"):
        guard.run("SELECT p.id FROM products p JOIN secret s ON p.id = s.id LIMIT 3")
    with pytest.raises(Q.RejectedSQL, match="not an allowed table"):
        guard.run("SELECT id FROM products WHERE id IN (SELECT max(id) FROM secret) LIMIT 3")


def test_guard_lets_through(spark):
    frame = spark.range(100)
    run = lambda sql: Q.run_sql(spark, sql, {"products": frame, "product_extraction": frame.where("id < 3").withColumnRenamed("id", "code")})
    assert run("SELECT id FROM products ORDER BY id LIMIT 50;").count() == 20
    assert run("WITH x AS (SELECT id FROM products) SELECT count(*) AS n FROM x LIMIT 1").first().n == 100
    assert run("WITH x AS (SELECT id FROM products) SELECT a.id FROM x a JOIN x b ON a.id = b.id + 1 LIMIT 500").count() == 20
    assert run("SELECT p.id FROM products p WHERE EXISTS (SELECT 1 FROM product_extraction e WHERE e.code = p.id) ORDER BY 1 LIMIT 9").count() == 3
    assert not spark.catalog.tableExists("product_extraction")


def test_guard_cancels_what_takes_too_long(spark):
    slow = spark.range(0, 4, 1, 4).select(F.expr("reduce(sequence(1, 40000000), 0L, (a, x) -> a + x * id % 7)").alias("id"))
    guard = Q.GuardedSession(spark, {"products": slow, "ingredients_dict": spark.range(10)})
    began = time.perf_counter()
    with pytest.raises(Q.StatementTimeout):
        guard.run("SELECT sum(id) AS s FROM products LIMIT 1", seconds=1.0)
    assert time.perf_counter() - began < 25
    assert guard.run("SELECT count(*) AS n FROM ingredients_dict LIMIT 1").first().n == 10 and spark.range(3).count() == 3


def test_extraction_states(spark):
    rows = spark.createDataFrame([("a", "text", True, False), ("b", "", False, False), ("c", "z" * 99, False, True)], "code string, text string, is_usable boolean, too_long boolean")
    run = lambda make: {r.code: (r.status, r.skip_reason) for r in U.extract(rows, make, "{text}", {}).collect()}
    assert run(lambda: U.FakeLLM()) == {"a": ("ok", None), "b": ("unreadable", "empty"), "c": ("unreadable", "too_long")}
    assert run(lambda: U.FakeLLM(failures=9))["a"] == ("unavailable", None) and run(lambda: U.FakeLLM(failures=2))["a"] == ("ok", None)
    assert run(lambda: U.FakeLLM(lambda p: "no json"))["a"] == ("invalid", None) and run(lambda: U.FakeLLM(lambda p: '{"unreadable": true}'))["a"] == ("unreadable", "model_unreadable")
    assert run(lambda: U.FakeLLM(lambda p: "x" * 9999))["a"] == ("unreadable", "output_limit")
    with pytest.raises(Exception, match="vectors"):
        bad = type("Bad", (U.HashedNgrams,), {"embed": lambda self, texts: [[0.0]] * len(texts)})
        U.embed(rows, lambda: bad(8)).collect()


def test_split_is_exact_and_fixed(spark):
    rows = spark.createDataFrame([(str(k), "abc"[k % 3] if k < 90 else "rare") for k in range(91)], "code string, y string")
    got = S.stratified_split(rows, "y")
    assert {(r.y, r.is_test): r["count"] for r in got.groupBy("y", "is_test").count().collect()} == {(c, t): n for c in "abc" for t, n in ((True, 6), (False, 24))}
    assert got.where("is_test").select("code").exceptAll(S.stratified_split(rows.repartition(7), "y").where("is_test").select("code")).count() == 0
    assert S.stratified_subset(rows, "y", 30).count() == 30 and S.stratified_subset(rows, "y", 1000).count() == 91


def test_char_wb(spark):
    got = spark.range(1).select(L.char_wb(F.lit("Abc d"))).first()[0]
    assert got == [" ab", "abc", "bc ", " abc", "abc ", " abc ", " d "]
    assert L.TRAINING == ("code", "ingredients_text", "lang", "nutriscore_grade", "nova_group")


def test_profile_and_records(spark, tmp_path):
    text = spark.range(1).select(P.profile(F.lit("<b>Bar</b>"), F.lit("Bar, Other"), F.array(*[F.lit(f"en:c-{k}") for k in range(6)]), F.lit("sugar"))).first()[0]
    assert text == "Bar\nc 2, c 3, c 4, c 5\nsugar"
    assert R.read_records(spark, str(tmp_path / "none.jsonl"), PREDICTION).count() == 0
    (tmp_path / "p.jsonl").write_text('{"code": "1", "system": "s", "latency_s": 0.5}\n')
    assert R.read_records(spark, str(tmp_path / "p.jsonl"), PREDICTION).first().latency_s == 0.5
    (tmp_path / "q.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        R.read_records(spark, str(tmp_path / "q.jsonl"), PREDICTION).collect()
    assert "en" in LANGUAGES


def test_journal_and_watermark(spark):
    counts = spark.createDataFrame([(5, 4, 1, 17)], "seen int, written int, skipped int, last int")
    runs = M.journal(counts, "ingest", "completed", mode=F.lit("delta"), watermark=F.col("last")).union(M.journal(counts, "ingest", "failed", mode=F.lit("delta"), watermark=F.lit(99)))
    assert M.last_watermark(runs).first()[0] == 17 and M.last_watermark(runs.limit(0)).first()[0] is None
