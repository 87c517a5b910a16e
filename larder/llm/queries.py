"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.bags import ranked_search
from larder.llm.chroma import search, sonify
from larder.llm.content_sort import content_sort
from larder.llm.gumbel import sampled_segmentations
from larder.llm.minhash import near_duplicates
from larder.llm.packing import pack
from larder.llm.patience import scan_licenses
from larder.llm.pii import PATTERNS, find_personal_data, spans_text
from larder.llm.ring import ring_shards
from larder.llm.runs import periodic_runs
from larder.llm.substrings import remove_repeats
from larder.llm.toxicity import fold, score, train
from larder.llm.winnowing import contamination


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle_words=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["doc_id"]
    return search(_documents(spark, sf_dir), keys, F.col("doc_id") % 20 == 0, audio_col="text", sound=sonify)


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(_documents(spark, sf_dir))


def op4_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), window=50, with_text=False).drop("kept_text")


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(_documents(spark, sf_dir), shards=40)


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_documents(spark, sf_dir))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in PATTERNS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "terms")).alias("spans"))


def op7_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = sampled_segmentations(turns, public_tokenizers.path("piece_bpe_32k.model"), ["conv_id", "turn"], k=3)
    return found.select("conv_id", "turn", F.posexplode("samples").alias("nth", "s")).select("conv_id", "turn", "nth", F.col("s.ids").alias("ids"), F.col("s.log_prob").alias("log_prob"), F.col("s.perturbed").alias("perturbed"), F.col("s.inclusion").alias("inclusion"))


def op8_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=0)


def op9_subword_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("held_out", fold() == 0)


def op10_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def repeating(docs: DataFrame) -> DataFrame:
    """docs with the runs that the query's contract plants: one id in ten repeats words of its own from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    made = docs.withColumns({"__g": F.floor(h / 10), "__w": F.when(h % 10 == 0, words)}).withColumn("__n", F.size("__w").cast("long"))
    made = made.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    made = made.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8)))
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda i: F.get("__w", place(i))), " ")
    return made.withColumn("text", F.when(F.col("__n") > 0, text).otherwise(F.col("text"))).drop("__g", "__w", "__n", "__a", "__p")


def op12_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeating(_documents(spark, sf_dir)))
    ahead = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, r: F.when(ahead(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).drop("spans", "items")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_odd_sketch": op1_minhash_odd_sketch,
    "op2_chroma_fingerprints": op2_chroma_fingerprints,
    "op3_content_sort": op3_content_sort,
    "op4_suffix_automata": op4_suffix_automata,
    "op5_bounded_ring": op5_bounded_ring,
    "op6_disclosure_pii": op6_disclosure_pii,
    "op7_gumbel_top_k": op7_gumbel_top_k,
    "op8_best_fit_decreasing": op8_best_fit_decreasing,
    "op9_subword_bags": op9_subword_bags,
    "op10_patience_licenses": op10_patience_licenses,
    "op11_bag_search": op11_bag_search,
    "op12_suffix_tree_runs": op12_suffix_tree_runs,
    "op13_winnowing": op13_winnowing,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {
    "op1_minhash_odd_sketch": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) end) as s from w),
        x as (select doc_id, len(s) as n, unnest(s) as h from s),
        e as (select a.doc_id as a, b.doc_id as b from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        r as (select doc_id as id, doc_id as reached from documents union select r.id, e.b from r join e on e.a = r.reached),
        c as (select id, min(reached) as component_id from r group by id)
        select s.doc_id, len(s.s) as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join c on c.id = s.doc_id""",
    "op4_suffix_automata": r"""
        with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        g as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50)),
        f as (select h, min(doc_id) as first from g group by h),
        c as (select distinct doc_id, unnest(range(i, i + 50)) as pos from g join f using (h) where first < doc_id),
        p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from w),
        k as (select p.doc_id, string_agg(word, ' ' order by pos) as kept, count(*) as n from p anti join c on c.doc_id = p.doc_id and c.pos = p.pos group by p.doc_id)
        select w.doc_id, len(w) as n_words, len(w) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k using (doc_id)""",
    "op3_content_sort": r"""
        with n as (select doc_id, length(coalesce(text, '')) as n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
        k as (select doc_id, norm, first_value(doc_id) over (partition by norm order by n_cp desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k""",
    "op11_bag_search": r"""
        with t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        i as (select item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark),
        s as (select count(*)::bigint as N, sum(len(w))::bigint as L from t where len(w) > 0),
        x as (select doc_id, len(w)::bigint as n, unnest(w) as term from t),
        f as (select doc_id, term, n, count(*)::bigint as tf from x group by doc_id, term, n),
        d as (select term, floor(1000 * ln((2 * (select N from s) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f group by term),
        c as (select i.item_id, f.doc_id, d.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + ((25 * f.n * s.N) // s.L)))) as part from i join f using (term) join d using (term) cross join s),
        r as (select item_id, doc_id, sum(part)::bigint as score from c group by item_id, doc_id having sum(part) > 0),
        k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r)
        select item_id, rank, doc_id, score from k where rank <= 20""",
    "op12_suffix_tree_runs": r"""
        with o as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as o from documents),
        h as (select doc_id, o, len(o) as n, xor(list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end, 4294967295::bigint), 4294967295::bigint) as h from o),
        g as (select doc_id, o, n, h, h // 10 as g, case when n > 0 then (h // 10) % n end as a from h),
        p as (select doc_id, o, n, h, a, 1 + (n - a) // (3 + g % 8) as p from g),
        w as (select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: o[1 + (case when i < a then i else a + (i - a) % p end)]) else o end as w from p),
        x as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from w),
        e as (select a.doc_id, b.i - a.i as q, a.i from x a join x b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
        l as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from e),
        m as (select doc_id, q, min(i) as start, count(*) + q as length from l group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
        r as (select * from m anti join m as less on less.doc_id = m.doc_id and less.q < m.q and less.start <= m.start and less.start + less.length >= m.start + m.length),
        t as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as told, list(struct_pack(start := start, length := length, period := q) order by length::double / q desc, start, q)[1] as b from r group by doc_id),
        d as (select distinct doc_id, unnest(range(start + q, start + length)) as i from r),
        k as (select x.doc_id, string_agg(word, ' ' order by i) as kept from x anti join d on d.doc_id = x.doc_id and d.i = x.i group by x.doc_id)
        select w.doc_id, coalesce(t.n_runs, 0) as n_runs, t.b.start as start, t.b.length as length, t.b.period as period, (1000 * t.b.length) // t.b.period as exponent_milli,
            sha256(coalesce(t.told, '')) as runs_sha256, sha256(coalesce(k.kept, '')) as collapsed_sha256 from w left join t using (doc_id) left join k using (doc_id)""",
    "op13_winnowing": r"""
        with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        i as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
        g as (select item_id, n, array_to_string(list_slice(w, j, j + n - 1), ' ') as run from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as j from i where len(w) > 0)),
        l as (select distinct n from g),
        t as (select doc_id, n, j, array_to_string(list_slice(w, j, j + n - 1), ' ') as run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as j from d cross join l where len(w) >= n)),
        m as (select distinct t.doc_id, t.j, t.n, g.item_id from t join g on t.run = g.run and t.n = g.n),
        h as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(j, j + n)) from m) group by doc_id),
        s as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from m) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated from d left join h using (doc_id) left join s using (doc_id)""",
}
