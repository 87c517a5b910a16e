"""The rest of the surface over the shared tables: sinks, logs, resume, reports, evaluation flows."""

from __future__ import annotations

from functools import reduce

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
from larder.operators import retrieval as R
from larder.operators import sampling as S
from larder.operators import sqlguard as Q
from larder.plans.analytics import ALIASES, GATE, GUESSES, INCOMING, PAIRS, RESOLVED, SETS, STORED, alias_table, gate_metrics, guesses, name_table, neighbours, query_vector, revisions, sets
from larder.plans.registry import Tables, query
from larder.plans.scans import ENTRIES, entries
from larder.sources import files as Z
from larder.sources import sinks as K

# --- sources


@query("src_dump_version", "select 'orders.parquet' as name, true as has_version")
def src_dump_version(t: Tables):
    found = Z.dump_versions(t.orders)
    return found.select("name", F.col("dump_version").rlike(r"^size=\d+;modified=\d+$").alias("has_version"))


@query("src_dict_jsonl", f"with a as ({ALIASES}) select distinct alias_key, lang, canonical_name from a")
def src_dict_jsonl(t: Tables):
    entry = alias_table(t).groupBy("canonical_name", "kind", "lang").agg(F.collect_set("alias_key").alias("names"))
    lines = entry.select(F.to_json(F.struct("canonical_name", "kind", F.create_map("lang", "names").alias("aliases"))).alias("value"))
    path = K.workspace(t.spark, "dictionary")
    lines.write.text(path)
    return Z.read_dictionary(t.spark, path).where("lang <> 'xx'").select("alias_key", "lang", "canonical_name").distinct()


@query("src_dict_table", f"with a as ({ALIASES}) select alias_key, count(*) as lines from a group by 1")
def src_dict_table(t: Tables):
    return alias_table(t).groupBy("alias_key").agg(F.count("*").alias("lines"))


@query("src_jsonl_records", "select item_id as code, text as ingredients_text from benchmark")
def src_jsonl_records(t: Tables):
    rows = t.benchmark.select(F.col("item_id").alias("code"), F.col("text").alias("ingredients_text"))
    path = K.workspace(t.spark, "records")
    K.write_json(rows, path)
    return Z.read_records(t.spark, path, rows.schema)


@query("src_predictions_dir", "select 'p' || (o_orderkey % 3) as system, count(*) as predictions from orders group by 1")
def src_predictions_dir(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").cast("string").alias("code"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("system"))
    return K.write_json(rows, K.workspace(t.spark, "predictions")).groupBy("system").agg(F.count("*").alias("predictions"))


@query("src_gold_queries", "select vec_id as query, label from embeddings")
def src_gold_queries(t: Tables):
    return K.write_json(t.embeddings.select(F.col("vec_id").alias("query"), "label"), K.workspace(t.spark, "queries"))


@query("src_agent_questions", "select conv_id, text as question from conversations where turn = 0")
def src_agent_questions(t: Tables):
    return K.write_json(t.conversations.where("turn = 0").select("conv_id", F.col("text").alias("question")), K.workspace(t.spark, "questions"))


@query("src_dataset_cache", "select doc_id as code, lang, quality as nova_group from documents join labels using (doc_id)")
def src_dataset_cache(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("code"), "lang", F.col("quality").alias("nova_group"))
    return K.write_table(rows, K.workspace(t.spark, "dataset"))


@query("src_scores_dir", "select l_returnflag as target, l_linestatus as dataset, count(*) as products from lineitem group by 1, 2")
def src_scores_dir(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("target"), F.col("l_linestatus").alias("dataset")).agg(F.count("*").alias("products")).select("products", "target", "dataset")
    return K.write_table(rows, K.workspace(t.spark, "scores"), "target", "dataset")


@query("src_vectors_cache", "select vec_id, 'm' as model_name, len(embedding)::int as dimension from embeddings")
def src_vectors_cache(t: Tables):
    rows = t.embeddings.select("vec_id", F.lit("m").alias("model_name"), "embedding")
    return K.write_table(rows, K.workspace(t.spark, "vectors")).select("vec_id", "model_name", F.size("embedding").alias("dimension"))


@query("src_zero_shot_log", "select user_id as code, arg_max(event_type, event_id) as answer from events group by 1")
def src_zero_shot_log(t: Tables):
    log = K.write_json(t.events.select(F.col("user_id").alias("code"), F.col("event_type").alias("answer"), F.col("event_id").alias("position")), K.workspace(t.spark, "zero-shot"))
    return Z.last_by_line(log).select("code", "answer")


@query("src_profile_stream", "select p_partkey, substr(sha256(p_name), 1, 32) as profile_hash from part where length(p_name) > 10")
def src_profile_stream(t: Tables):
    return t.part.where(F.length("p_name") > 10).select("p_partkey", P.profile_hash(F.col("p_name")).alias("profile_hash"))


@query("src_fresh_hashes", "select doc_id, substr(sha256(text), 1, 32) as profile_hash from documents where source = 'src1'")
def src_fresh_hashes(t: Tables):
    return t.documents.where("source = 'src1'").select("doc_id", P.profile_hash(F.col("text")).alias("profile_hash"))


@query("src_local_predictions", "select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_orderpriority = '5-LOW'")
def src_local_predictions(t: Tables):
    path = K.workspace(t.spark, "predictions")
    rows = t.orders.where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    K.write_json(rows, path)
    sample = t.customer.where("c_mktsegment = 'BUILDING'")
    return Z.read_records(t.spark, path, rows.schema).join(sample, "c_custkey", "left_semi").select("o_orderkey", "o_totalprice")


# --- sinks


@query("snk_upsert_products", f"with s as ({STORED}), n as ({INCOMING}), m as (select coalesce(s.code, n.code) as code, case when s.code is null or (n.code is not null and (s.rev is null or coalesce(n.rev >= s.rev, false))) then n.rev else s.rev end as rev, case when s.code is null or (n.code is not null and (s.rev is null or coalesce(n.rev >= s.rev, false))) then n.source else s.source end as source from s full join n on s.code = n.code) select code, rev, source, source as raw_source from m")
def snk_upsert_products(t: Tables):
    # Both tables of a product, under one guard: an older revision or none changes neither.
    stored, incoming = revisions(t)
    raw = M.merge_by_revision(P.raw_snapshot(stored, "old", None), P.raw_snapshot(incoming, "new", "v2"))
    return M.merge_by_revision(stored, incoming).join(raw.select("code", F.col("source").alias("raw_source")), "code", "left")


@query("snk_upsert_alias", f"with a as ({ALIASES}) select alias_key, lang, arg_max(canonical_name, (kind = 'sugar', line)) as canonical_name from a group by 1, 2")
def snk_upsert_alias(t: Tables):
    rows = alias_table(t)
    return M.upsert(rows.where("kind <> 'sugar'"), rows.where("kind = 'sugar'"), ["alias_key", "lang"], "line").select("alias_key", "lang", "canonical_name")


@query("snk_sync_dict", f"with a as ({ALIASES}) select alias_key, lang, canonical_name, kind, line from a")
def snk_sync_dict(t: Tables):
    return K.write_table(alias_table(t), K.workspace(t.spark, "dict"))


@query("snk_upsert_embedding", "select vec_id as code, case when label >= 5 then 'new' else 'old' end as profile_hash from embeddings")
def snk_upsert_embedding(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("code"), F.lit("m").alias("model_name"), F.lit("old").alias("profile_hash"), F.lit(1).alias("version"), "label")
    return M.upsert(rows, rows.where("label >= 5").withColumn("profile_hash", F.lit("new")), ["code", "model_name"], "version").select("code", "profile_hash")


@query("snk_run_journal", "select 'ingest' as stage, 'completed' as status, count(*) as items_seen, count(*) filter (value > 1) as items_written, count(*) filter (not value > 1) as items_skipped from events")
def snk_run_journal(t: Tables):
    counts = t.events.agg(F.count("*").alias("seen"), F.count_if(F.col("value") > 1).alias("written"), F.count_if(~(F.col("value") > 1)).alias("skipped"))
    return K.write_table(M.journal(counts, "ingest", "completed", mode=F.lit("delta")), K.workspace(t.spark, "runs")).drop("params", "started_at")


@query("snk_run_journal_llm", "select 'extract' as stage, count(*) as items_seen, sum(length(text))::bigint as input_tokens from conversations")
def snk_run_journal_llm(t: Tables):
    n = F.count("*")
    counts = t.conversations.agg(n.alias("seen"), n.alias("written"), F.lit(0).alias("skipped"), F.sum(F.length("text")).alias("tokens"))
    row = K.write_table(M.journal(counts, "extract", "completed", model=F.lit("m"), input_tokens=F.col("tokens")), K.workspace(t.spark, "runs"))
    return row.select("stage", "items_seen", F.col("params")["input_tokens"].cast("long").alias("input_tokens"))


@query("snk_dataset_parquet", "select * from labels")
def snk_dataset_parquet(t: Tables):
    return K.write_table(t.labels, K.workspace(t.spark, "labels"))


@query("snk_jsonl", "select conv_id, turn, role, text from conversations")
def snk_jsonl(t: Tables):
    return K.write_json(t.conversations.select("conv_id", "turn", "role", "text"), K.workspace(t.spark, "turns"))


@query("snk_append_query", "select item_id, text from benchmark union all select -1, 'added'")
def snk_append_query(t: Tables):
    path, rows = K.workspace(t.spark, "queries"), t.benchmark.select("item_id", "text")
    K.write_json(rows, path)
    return K.write_json(rows.limit(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("added").alias("text")), path, append=True)


@query("snk_score", "select replace(replace('m:' || l_returnflag || '/x', ':', '_'), '/', '_') as system, count(*) as products from lineitem group by l_returnflag")
def snk_score(t: Tables):
    name = F.replace(F.replace(F.concat(F.lit("m:"), "l_returnflag", F.lit("/x")), F.lit(":"), F.lit("_")), F.lit("/"), F.lit("_"))
    return K.write_table(t.lineitem.groupBy(name.alias("system")).agg(F.count("*").alias("products")), K.workspace(t.spark, "score"))


@query("snk_vectors", "select vec_id, embedding[1] as first, embedding[64] as last from embeddings")
def snk_vectors(t: Tables):
    out = K.write_table(t.embeddings.select("vec_id", "embedding"), K.workspace(t.spark, "vectors"))
    return out.select("vec_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 64).alias("last"))


@query("snk_zero_shot", "select doc_id as code from documents")
def snk_zero_shot(t: Tables):
    path, rows = K.workspace(t.spark, "resume"), t.documents.select(F.col("doc_id").alias("code"))
    K.write_json(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("code")), path)
    rest = C.not_done(rows, t.spark.read.schema(rows.schema).json(path), ["code"])
    return K.write_json(rest, path, append=True)


@query("snk_baseline", "select 's' || (doc_id % 3) as system, round(avg(quality), 4) as f1_ingredients from labels group by 1 order by 1")
def snk_baseline(t: Tables):
    rows = t.labels.groupBy(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("system")).agg(F.round(F.avg("quality"), 4).alias("f1_ingredients"))
    return K.write_json(rows.orderBy("system"), K.workspace(t.spark, "baseline"))


@query("snk_agent_runs", "select user_id, list(event_type order by event_id) as steps from events group by 1")
def snk_agent_runs(t: Tables):
    steps = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"])
    return K.write_json(t.events.groupBy("user_id").agg(steps.alias("steps")), K.workspace(t.spark, "runs"))


@query("snk_reports", "select '# Documents' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|---|---|' || chr(10) || coalesce(string_agg('| ' || lang || ' | ' || n || ' |' || chr(10), '' order by lang), '') as report from (select lang, count(*) as n from documents group by 1)")
def snk_reports(t: Tables):
    return K.markdown(t.documents.groupBy("lang").agg(F.count("*").alias("n")), "Documents", ["lang"])


# --- projections, filters, joins


@query("prj_delta_multilang", "select event_id, map([substr(event_type, 1, 2)], [event_type]) as texts from events")
def prj_delta_multilang(t: Tables):
    record = F.create_map(F.concat(F.lit("name_"), F.substring("event_type", 1, 2)), "event_type", F.lit("name_debug_tags"), F.lit("x"), F.lit("name_zz"), F.lit(" "))
    return t.events.select("event_id", Z.delta_multilang(record, "name").alias("texts"))


@query("prj_delta_nutriments", "select event_id, value as fat, cast(json_extract(props, '$.k') as double) as salt from events")
def prj_delta_nutriments(t: Tables):
    nutrients = F.to_json(F.create_map(F.lit("fat_100g"), F.col("value").cast("string"), F.lit("salt_100g"), F.get_json_object("props", "$.k"), F.lit("fat_unit"), F.lit("g"), F.lit("bad_100g"), F.lit("n/a")))
    m = Z.delta_nutriments(F.create_map(F.lit("nutriments"), nutrients))
    return t.events.select("event_id", m.alias("m")).select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("fat", "salt")])


@query("prj_delta_row", "select cast(o_orderkey as varchar) as code, case o_orderstatus when 'F' then 'fr' else 'en' end as lang, cast(o_custkey as int) as rev, 'delta' as source from orders where length(o_orderkey::varchar) between 4 and 20")
def prj_delta_row(t: Tables):
    r = t.orders.select(F.map_from_arrays(F.array(F.lit("code"), F.lit("lang"), F.lit("rev"), F.lit("nutriments")), F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "fr").otherwise("en"), F.col("o_custkey").cast("string"), F.lit("{}"))).alias("record"), F.lit(False).alias("broken"))
    return Z.from_delta(r).select("code", "lang", "rev", "source")


@query("prj_clean_texts", f"with e as ({ENTRIES}) select conv_id, list_sort(list_distinct(list_transform(list_filter(texts, lambda x: x.lang <> 'user'), lambda x: x.lang))) as langs from e")
def prj_clean_texts(t: Tables):
    renamed = F.map_from_entries(F.transform("texts", lambda x: F.struct(F.when(x["lang"] == "user", "main").otherwise(x["lang"]), F.concat(F.lit(" "), x["text"]))))
    return entries(t).select("conv_id", F.array_sort(F.map_keys(P.clean_texts(renamed))).alias("langs"))


@query("prj_hit", f"{PAIRS} select query, id, round(similarity, 5) as similarity, rank from r where rank <= 3")
def prj_hit(t: Tables):
    return neighbours(t, 3).select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("flt_corpus_py", "select event_id from events where event_type in ('view', 'click') and value > 2")
def flt_corpus_py(t: Tables):
    rows = t.events.select("event_id", F.create_map(F.lit("en"), F.lit("a long enough text")).alias("ingredients_text"), (F.col("value") <= 2).alias("obsolete"), F.array().cast("array<string>").alias("data_quality_errors"), F.array("event_type").alias("categories_tags"), F.lit(1).alias("unique_scans_n"))
    return rows.where(C.corpus_predicate(("en",), ("view", "click"), 10)).select("event_id")


@query("flt_search_obj", "select p_partkey from part where p_brand = 'Brand#11' and p_size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)")
def flt_search_obj(t: Tables):
    rows = t.part.withColumn("categories_tags", F.array("p_brand"))
    return rows.where(R.matching(rows, {"categories_tags": "Brand#11", "p_size": range(1, 11), "p_type": []})).select("p_partkey")


@query("flt_nova", "select vec_id, label from embeddings where label in (select label from embeddings group by 1 having count(*) >= 40)")
def flt_nova(t: Tables):
    return C.drop_rare_classes(t.embeddings.select("vec_id", "label"), "label", 40)


@query("flt_vec_pending", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def flt_vec_pending(t: Tables):
    return C.not_done(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("flt_pending_gold", "select doc_id from documents where lang = 'fr' and doc_id not in (select doc_id from labels)")
def flt_pending_gold(t: Tables):
    return C.not_done(t.documents.where("lang = 'fr'").select("doc_id"), t.labels, ["doc_id"])


@query("flt_latest_run", "select event_id, ts from events where event_type = 'purchase' order by ts desc, event_id desc limit 1")
def flt_latest_run(t: Tables):
    return t.events.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "ts")


@query("jn_card", "select s_suppkey, s_name, coalesce(n_name, 'unknown') as origin from supplier left join (select * from nation where n_regionkey = 1) on n_nationkey = s_nationkey")
def jn_card(t: Tables):
    return t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("origin"))


@query("jn_semi_any", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50)")
def jn_semi_any(t: Tables):
    return t.part.join(t.lineitem.where("l_quantity = 50"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("jn_zip", "select vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::double * i)), 4) as weighted from embeddings")
def jn_zip(t: Tables):
    both = F.arrays_zip(F.col("embedding").alias("e"), F.transform("embedding", lambda x, k: k + 1).alias("k"))
    rows = t.embeddings.select("vec_id", F.explode(both).alias("z"))
    return rows.groupBy("vec_id").agg(F.round(F.sum(F.col("z.e").cast("double") * F.col("z.k")), 4).alias("weighted"))


# --- aggregates


@query("agg_probe_langs", f"with e as ({ENTRIES}) select x.lang as lang, count(*) as n from (select unnest(texts) as x from e) group by 1")
def agg_probe_langs(t: Tables):
    return entries(t).select(F.explode("texts").alias("x")).groupBy(F.col("x.lang").alias("lang")).agg(F.count("*").alias("n"))


@query("agg_probe_report", "select event_type as name, count(*) filter (value > 5) / count(*) >= 0.5 as covered from events group by 1")
def agg_probe_report(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("name")).agg((F.count_if(F.col("value") > 5) / F.count("*") >= 0.5).alias("covered"))


@query("agg_run_result", "select event_type, count(*) as items, round(coalesce(count(*) filter (value < 1) / nullif(count(*), 0), 0), 6) as invalid_share, round(coalesce(sum(value) / nullif(count(*), 0), 0), 4) as seconds_per_item from events group by 1")
def agg_run_result(t: Tables):
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("items"), F.count_if(F.col("value") < 1).alias("bad"), F.sum("value").alias("s"))
    return rows.select("event_type", "items", F.round(N.ratio(F.col("bad"), F.col("items")), 6).alias("invalid_share"), F.round(N.ratio(F.col("s"), F.col("items")), 4).alias("seconds_per_item"))


@query("agg_switch", "select quantile_cont(value, 0.5) filter (event_type = 'view') as same_s, quantile_cont(value, 0.5) filter (event_type = 'error') as switched_s from events")
def agg_switch(t: Tables):
    per = O.medians(t.events.where("event_type in ('view', 'error')"), ["event_type"], "value")
    one = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("median")))
    return per.agg(one("view").alias("same_s"), one("error").alias("switched_s"))


@query("agg_embed_progress", "select count(*) as seen, count(*) filter (lang = 'fr') as skipped, count(*) filter (lang <> 'fr') as embedded from documents")
def agg_embed_progress(t: Tables):
    now = t.documents.select("doc_id", "lang", X.short_hash(F.col("text")).alias("profile_hash"))
    todo = C.changed(now, now.where("lang = 'fr'"), "doc_id").select("doc_id", F.lit(True).alias("todo"))
    done = now.join(todo, "doc_id", "left")
    return done.agg(F.count("*").alias("seen"), F.count_if(F.col("todo").isNull()).alias("skipped"), F.count("todo").alias("embedded"))


@query("agg_count_candidates", "select count(*) as n from documents where length(text) > 1000")
def agg_count_candidates(t: Tables):
    return t.documents.where(F.length("text") > 1000).agg(F.count("*").alias("n"))


@query("win_quota_lang", "select d.doc_id, d.lang, l.quality from (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar || '42')) as r from documents join labels using (doc_id)) d join labels l on l.doc_id = d.doc_id where r <= 10")
def win_quota_lang(t: Tables):
    return S.quota_sample(t.documents.join(t.labels, "doc_id"), ["lang"], 10, "doc_id").select("doc_id", "lang", "quality")


@query("top_n_names", "select split_part(p_name, ' ', 1) as name, count(*) as n from part group by 1 order by n desc, name limit 10")
def top_n_names(t: Tables):
    return A.unknown_names(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.lit(False).alias("known")), 10)


@query("lim_sql_tool", "select c_custkey, c_name from customer order by c_custkey limit 20")
def lim_sql_tool(t: Tables):
    return Q.run_sql(t.spark, "SELECT c_custkey, c_name FROM products ORDER BY c_custkey LIMIT 500", {"products": t.customer})


@query("srt_report", "select o_orderpriority as kind, round(avg(o_totalprice), 2) as mean, row_number() over (order by avg(o_totalprice) desc) as place from orders group by 1")
def srt_report(t: Tables):
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.avg("o_totalprice").alias("m"))
    return rows.select("kind", F.round("m", 2).alias("mean"), F.row_number().over(Window.orderBy(F.desc("m"))).cast("long").alias("place"))  # a row per kind


@query("srt_alias_len", f"with a as ({ALIASES}) select canonical_name, list(alias_key order by length(alias_key) desc, alias_key) as forms from (select distinct canonical_name, alias_key from a) group by 1")
def srt_alias_len(t: Tables):
    forms = alias_table(t).groupBy("canonical_name").agg(F.collect_set("alias_key").alias("f"))
    by_length = F.array_sort(F.transform("f", lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    return forms.select("canonical_name", F.transform(by_length, lambda x: x["a"]).alias("forms"))


@query("set_invented", "select l_orderkey, len(list_filter(list(distinct l_returnflag), lambda x: x <> 'N'))::int as invented from lineitem group by 1")
def set_invented(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("cited")).withColumn("sources", F.array(F.lit("N")))
    return E.grounding(rows).select("l_orderkey", F.size("invented").alias("invented"))


@query("set_tables", "select count(*) as n from orders")
def set_tables(t: Tables):
    return Q.run_sql(t.spark, "WITH x AS (SELECT o_orderkey FROM product_extraction) SELECT count(*) AS n FROM x LIMIT 1", {"product_extraction": t.orders})


# --- text, arithmetic, arrays, maps, JSON


@query("txt_max_len", "select page_id, length(html) > 9830 as too_long from pages")
def txt_max_len(t: Tables):
    return t.pages.select("page_id", (F.length("html") > X.max_text_length(8192)).alias("too_long"))


@query("txt_alias_pattern", "select doc_id, len(regexp_extract_all(lower(text), '(^|[^a-zà-ÿ])(ther[a-zà-ÿ]*)'))::int as n from documents where lang = 'en'")
def txt_alias_pattern(t: Tables):
    return t.documents.where("lang = 'en'").select("doc_id", F.regexp_count("text", X.alias_pattern(F.lit("ther"))).alias("n"))


@query("txt_model_annotator", "select distinct o_orderpriority as annotator, o_orderpriority like '1%' or o_orderpriority like '2%' as is_model from orders")
def txt_model_annotator(t: Tables):
    return t.orders.select(F.col("o_orderpriority").alias("annotator"), X.is_model_annotator(F.col("o_orderpriority"), ("1", "2")).alias("is_model")).distinct()


@query("txt_safe_path", "select p_partkey, replace(replace(p_brand, ':', '_'), '/', '_') as name from part")
def txt_safe_path(t: Tables):
    return t.part.select("p_partkey", F.translate("p_brand", ":/", "__").alias("name"))


@query("txt_format", "select c_custkey, c_name || ' (' || c_mktsegment || ')' as line from customer")
def txt_format(t: Tables):
    return t.customer.select("c_custkey", F.concat_ws("", "c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("line"))


@query("txt_redact", "select c_custkey, 'pg://u:***@h/' || c_custkey || ' ***' as line from customer")
def txt_redact(t: Tables):
    line = F.concat(F.lit("pg://u:"), "c_name", F.lit("@h/"), F.col("c_custkey").cast("string"), F.lit(" s3cret"))
    return t.customer.select("c_custkey", K.redact(line, ["s3cret", ""]).alias("line"))


@query("mth_ratios", "select event_id, coalesce(value / nullif(event_id % 3, 0), 0) as ratio from events")
def mth_ratios(t: Tables):
    return t.events.select("event_id", N.ratio(F.col("value"), F.col("event_id") % 3).alias("ratio"))


@query("mth_rounding", "select event_id, round_even(value::decimal(20,10) / 8, 1)::double as rounded from events")
def mth_rounding(t: Tables):
    return t.events.select("event_id", F.bround(F.col("value").cast("decimal(20,10)") / 8, 1).cast("double").alias("rounded"))


@query("mth_extrapolate", "select event_type, round(quantile_cont(value, 0.5) * 147856 / 3600, 4) as hours from events group by 1")
def mth_extrapolate(t: Tables):
    return O.medians(t.events, ["event_type"], "value").select("event_type", F.round(F.col("median") * 147856 / 3600, 4).alias("hours"))


@query("dt_manual_window", "select event_id, greatest(epoch_us(ts) // 1000000 - 3 * 86400, 1704100000) as since from events")
def dt_manual_window(t: Tables):
    return t.events.select("event_id", F.greatest(F.unix_timestamp("ts") - 3 * 86400, F.lit(1704100000)).alias("since"))


@query("dt_now", "select count(*) as n from events where ts < now()")
def dt_now(t: Tables):
    return t.events.where(F.col("ts") < F.current_timestamp()).agg(F.count("*").alias("n"))


@query("arr_filter", f"with e as ({ENTRIES}) select conv_id, len(list_filter(texts, lambda x: length(x.text) > 300))::int as n from e")
def arr_filter(t: Tables):
    return entries(t).select("conv_id", F.size(F.filter("texts", lambda x: F.length(x["text"]) > 300)).alias("n"))


@query("arr_transform", f"with e as ({ENTRIES}) select conv_id, list_transform(texts, lambda x: length(x.text)) as lengths from e")
def arr_transform(t: Tables):
    return entries(t).select("conv_id", F.transform("texts", lambda x: F.length(x["text"]).cast("long")).alias("lengths"))


@query("arr_len", "select l_orderkey, len(list(l_partkey))::int as n from lineitem group by 1")
def arr_len(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.size(F.collect_list("l_partkey")).alias("n"))


@query("arr_contains", "select l_orderkey, list_contains(list(l_linenumber), 3) as has_third from lineitem group by 1")
def arr_contains(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_contains(F.collect_list("l_linenumber"), 3).alias("has_third"))


@query("arr_unnest", f"with e as ({ENTRIES}) select conv_id, x.text as text from (select conv_id, unnest(texts) as x from e)")
def arr_unnest(t: Tables):
    return entries(t).select("conv_id", F.explode("texts.text").alias("text"))


@query("map_build", "select o_custkey, count(distinct o_orderpriority)::int as keys from orders group by 1")
def map_build(t: Tables):
    pairs = F.collect_list(F.struct("o_orderpriority", "o_totalprice"))
    return t.orders.groupBy("o_custkey").agg(F.size(F.map_from_entries(pairs)).alias("keys"))


@query("map_get", "select o_custkey, max(o_totalprice) filter (o_orderpriority = '1-URGENT') as urgent from orders group by 1")
def map_get(t: Tables):
    per = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("p"))
    return per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "p"))).alias("m")).select("o_custkey", F.try_element_at("m", F.lit("1-URGENT")).alias("urgent"))


@query("jsn_dump", "select r_regionkey, r_name, length(r_name) as n from region")
def jsn_dump(t: Tables):
    text = F.to_json(F.struct("r_regionkey", "r_name"))
    return t.region.select("r_regionkey", F.get_json_object(text, "$.r_name").alias("r_name"), F.length(F.get_json_object(text, "$.r_name")).cast("long").alias("n"))


@query("jsn_load", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def jsn_load(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- models, vectors, increments


@query("ml_small_train", "with p as (select lang, count(*) as n, sum(count(*)) over () as total from documents group by 1), q as (select lang, floor(n * 200.0 / total) as base, n * 200.0 / total - floor(n * 200.0 / total) as rest from p), k as (select lang, base + case when row_number() over (order by rest desc, lang) <= 200 - sum(base) over () then 1 else 0 end as quota from q) select doc_id from (select doc_id, lang, row_number() over (partition by lang order by md5(doc_id::varchar || '20260905')) as r from documents) join k using (lang) where r <= quota")
def ml_small_train(t: Tables):
    return S.stratified_subset(t.documents.select("doc_id", "lang"), "lang", 200, "doc_id").select("doc_id")


@query("ml_tfidf", "with g as (select p_partkey, unnest(list_distinct(list_transform(range(1, length(p_brand) + 1), lambda k: substr(' ' || lower(p_brand) || ' ', k, 3)))) as gram from part) select gram, count(*) as df, round(ln((1 + (select count(*) from part)) / (1 + count(*))) + 1, 5) as idf from g group by 1 having count(*) >= 5")
def ml_tfidf(t: Tables):
    grams = t.part.select(F.explode(F.array_distinct(L.char_wb(F.col("p_brand"), 3, 3))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df >= 5")
    rows = t.part.agg(F.count("*").alias("n"))
    return grams.crossJoin(F.broadcast(rows)).select("gram", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 5).alias("idf"))  # one row


@query("ml_run_tfidf")
def ml_run_tfidf(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("code"), F.col("text").alias("ingredients_text"), "lang", F.col("lang").alias("label_text"))
    split = S.stratified_split(rows, "label_text")
    found = K.write_table(L.fit(split.where("not is_test")).predict(split.where("is_test")), K.workspace(t.spark, "predicted"))
    common = S.stratified_subset(found.select("code", "label_text"), "label_text", 30)
    slice_ = found.join(common.select("code"), "code", "left_semi")
    return L.scored(found).withColumn("dataset", F.lit("full")).unionByName(L.scored(slice_).withColumn("dataset", F.lit("common")))


@query("ml_score_pair", f"with g as ({GUESSES}) select 'length' as system, count(*) as products, round(avg(case when truth = guess then 1.0 else 0 end), 6) as accuracy from g union all select 'always', count(*), round(avg(case when truth = '1' then 1.0 else 0 end), 6) from g")
def ml_score_pair(t: Tables):
    g = guesses(t)
    pair = {"length": g, "always": g.withColumn("guess", F.lit("1"))}
    one, two = (L.scored(rows, "truth", "guess").select(F.lit(name).alias("system"), "products", F.round("accuracy", 6).alias("accuracy")) for name, rows in pair.items())
    return one.unionByName(two)


@query("ml_run_embeddings")
def ml_run_embeddings(t: Tables):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    split = S.stratified_split(rows, "label", "vec_id")
    model = LogisticRegression(family="multinomial", maxIter=30).fit(split.where("not is_test"))
    return model.transform(split.where("is_test")).select("vec_id", "label", "prediction")


@query("ml_zero_shot", "select doc_id::varchar as code, case when length(text) > 1000 then 'a' else 'b' end as predicted from documents")
def ml_zero_shot(t: Tables):
    rows = t.documents.select("doc_id", "text", F.lit(True).alias("is_usable"), F.lit(False).alias("too_long"))
    answers = U.extract(rows, lambda: U.FakeLLM(lambda p: '{"label": "a"}' if len(p) > 1000 else '{"label": "b"}'), "{text}", {}, "doc_id", max_output_tokens=100)
    return answers.select("code", F.coalesce(F.get_json_object("payload", "$.label"), F.lit("")).alias("predicted"))


@query("ml_embed_corpus", "select doc_id as code from documents where lang <> 'es'")
def ml_embed_corpus(t: Tables):
    now = t.documents.select(F.col("doc_id").alias("code"), "text", "lang", X.short_hash(F.col("text")).alias("profile_hash"))
    todo = C.changed(now, now.where("lang = 'es'").select("code", "profile_hash"))
    return U.embed(todo, lambda: U.HashedNgrams(16), "code", "text").where(F.size("embedding") == 16).select("code")


@query("vec_explain")
def vec_explain(t: Tables):
    found = R.top_k(t.embeddings, query_vector(t), 5, "vec_id")
    plan = found._jdf.queryExecution().simpleString()
    return found.select("vec_id", F.lit(R.uses_top_k(plan)).alias("keeps_k"))


@query("vec_by_text", "select doc_id::bigint as id from documents where doc_id = 5")
def vec_by_text(t: Tables):
    vectors = U.embed(t.documents, lambda: U.HashedNgrams(64), "doc_id", "text")
    text = t.documents.where("doc_id = 5").select("text").first()[0]
    return R.top_k(vectors, U.HashedNgrams(64).embed([text])[0], 1, "doc_id").select(F.col("doc_id").alias("id"))


@query("str_delta_file", "select user_id, max(event_id) as event_id from events where value > 1 or event_type = 'view' group by 1")
def str_delta_file(t: Tables):
    # What is stored meets a file of which some rows fail validation, and newer rows win.
    stored = M.newest(t.events.where("event_type = 'view'").select("user_id", "event_id"), ["user_id"], F.desc("event_id"))
    rows = M.quarantine(t.events, {"value": F.col("value") > 1})[0].select("user_id", "event_id")
    return M.merge_by_revision(stored, rows, "user_id", "event_id")


#: Arrivals of events: the first fifteen days and the rest, one event in seven an arrival later; what is older than ten days before the newest event so far is late.
ARRIVALS = "least((epoch_ms(ts) - (select min(epoch_ms(ts)) from events)) // 1296000000, 1) + (event_id % 7 = 0)::int"


@query("str_late_data", f"with a as (select *, {ARRIVALS} as arrival from events), m as (select arrival, max(max(epoch_ms(ts))) over (order by arrival rows between unbounded preceding and 1 preceding) - 864000000 as mark from a group by 1), j as (select a.*, epoch_ms(ts) < coalesce(mark, 0) as is_late from a join m using (arrival)) select user_id, max(event_id) filter (not is_late) as event_id, count(*) filter (not is_late) as merged, count(*) filter (is_late) as late from j group by 1")
def str_late_data(t: Tables):
    from larder.streaming import late as Y

    source, out, checkpoint = (K.workspace(t.spark, f"late-{n}") for n in ("in", "out", "checkpoint"))
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.unix_millis(F.min("ts"))).first()[0]
    turn = F.least(F.floor((F.unix_millis("ts") - first) / 1_296_000_000), F.lit(1)) + (F.col("event_id") % 7 == 0).cast("int")
    dealt = K.write_table(events.select("user_id", "event_id", "ts", turn.cast("int").alias("arrival")), K.workspace(t.spark, "late-dealt"), "arrival")
    for arrival in range(3):
        dealt.where(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(source)
        Y.arrive(t.spark, source, "user_id long, event_id long, ts timestamp", out, checkpoint, "user_id", "event_id", "ts", late="10 days", idle_ms=3 * 86_400_000)
    return Y.totals(t.spark, out).select(F.col("key").alias("user_id"), F.col("rev").alias("event_id"), "merged", "late")


@query("str_batch_txn", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, (select count(distinct event_type) from events)::int as commits from events group by 1")
def str_batch_txn(t: Tables):
    from larder.streaming.manifest import ManifestTable

    # A batch for each kind of event, each run twice as after a failure; the table is what its manifest names.
    table = ManifestTable(t.spark, K.workspace(t.spark, "txn"), "user_id long, event_id long, event_type string", "user_id", "event_id", buckets=4, most=2)
    kinds = sorted(r[0] for r in t.events.select("event_type").distinct().collect())
    done = [table.apply(t.events.where(F.col("event_type") == kind), number) for number, kind in enumerate(kinds) for _ in range(2)]
    return table.read().withColumn("commits", F.lit(sum(done)))


@query("str_resume", "select conv_id, turn from conversations where role = 'assistant'")
def str_resume(t: Tables):
    return C.not_done(t.conversations.select("conv_id", "turn"), t.conversations.where("role <> 'assistant'"), ["conv_id", "turn"])


@query("str_stream_state", "select user_id, max(event_id) as event_id from events group by 1")
def str_stream_state(t: Tables):
    from larder.streaming.deltas import stream_merge

    source, table = K.workspace(t.spark, "stream-in"), K.workspace(t.spark, "stream-table")
    t.events.select("user_id", "event_id").repartition(3).write.parquet(source)
    return stream_merge(t.spark, source, "user_id long, event_id long", table, K.workspace(t.spark, "stream-checkpoint"), "user_id", "event_id")


# --- evaluation flows


@query("ev_collect", f"with s as ({SETS}), c as (select lang, sum(len(list_intersect(gold, pred)))::bigint as tp, sum(len(list_filter(pred, lambda x: not list_contains(gold, x))))::bigint as fp, sum(len(list_filter(gold, lambda x: not list_contains(pred, x))))::bigint as fn from s group by 1) select lang, tp, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall from c")
def ev_collect(t: Tables):
    return E.micro_prf(sets(t), "gold", "pred", ["lang"]).select("lang", "tp", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


@query("ev_report", "select lang, count(*) filter (text = '') as zero, round(max(n_chars) - min(n_chars), 0)::bigint as gap from documents group by 1")
def ev_report(t: Tables):
    return t.documents.groupBy("lang").agg(F.count_if(F.col("text") == "").alias("zero"), (F.max("n_chars") - F.min("n_chars")).alias("gap"))


@query("ev_sample", "select doc_id from (select doc_id, row_number() over (partition by lang order by md5(doc_id::varchar || '42')) as r from documents) where r <= 5")
def ev_sample(t: Tables):
    return S.quota_sample(t.documents, ["lang"], 5, "doc_id").select("doc_id")


@query("ev_predict", "select doc_id, 'long' as system, (n_chars > 900)::int as guess from documents union all select doc_id, 'odd', (n_chars % 2)::int from documents")
def ev_predict(t: Tables):
    d = t.documents
    return d.select("doc_id", F.lit("long").alias("system"), (F.col("n_chars") > 900).cast("int").alias("guess")).unionByName(d.select("doc_id", F.lit("odd").alias("system"), (F.col("n_chars") % 2).cast("int").alias("guess")))


@query("ev_cloud", "select doc_id as code, coalesce(case when lang <> 'de' then 1 end, 0) as answered from documents")
def ev_cloud(t: Tables):
    gold = t.documents.select(F.col("doc_id").alias("code"))
    answers = t.documents.where("lang <> 'de'").select(F.col("doc_id").alias("code"), F.lit(0).alias("position"), F.lit(1).alias("a"))
    return E.joined_predictions(gold, answers).select("code", F.coalesce("a", F.lit(0)).alias("answered"))


@query("ev_baseline_cmd", f"with g as ({GATE}), f as (select count(*) as products, substr(sha256(string_agg(cast(doc_id as varchar), chr(10) order by cast(doc_id as varchar))), 1, 12) as digest from labels) select system, metric, value, products, digest from (unpivot g on f1_ingredients, f1_typed, sugar_accuracy into name metric value value) cross join f")
def ev_baseline_cmd(t: Tables):
    return G.write_baseline(gate_metrics(t), t.labels, K.workspace(t.spark, "baseline"), "doc_id")


@query("ev_retrieval", f"{PAIRS} select round(avg(p), 6) as mean_precision, count(*) as queries from (select query, avg(case when ql = el then 1.0 else 0 end) as p from r where rank <= 5 group by 1)")
def ev_retrieval(t: Tables):
    labels = t.embeddings.select("vec_id", "label")
    hits = neighbours(t, 5).join(labels.toDF("query", "ql"), "query").join(labels.toDF("id", "el"), "id")
    per = hits.groupBy("query").agg(F.avg((F.col("ql") == F.col("el")).cast("double")).alias("p"))
    return per.agg(F.round(F.avg("p"), 6).alias("mean_precision"), F.count("*").alias("queries"))


@query("ev_agent_score", "select user_id, arg_min(event_type, event_id) = 'view' as right_tool from events group by 1")
def ev_agent_score(t: Tables):
    steps = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return t.events.groupBy("user_id").agg((F.element_at(steps, 1)["event_type"] == "view").alias("right_tool"))


@query("ev_recount", f"{RESOLVED}, f as (select l_orderkey, count(distinct case when dict_kind = 'sugar' then dict_name end) as n from r group by 1) select l_orderkey, n as sugar_forms from f where n > 0")
def ev_recount(t: Tables):
    now = A.sugar_forms(A.normalised(name_table(t), alias_table(t)), ["l_orderkey"], "dictionary")
    stored = now.withColumn("sugar_forms", F.lit(0).cast("long"))
    return C.changed(now, stored, "l_orderkey", "sugar_forms")


@query("ev_unknown", f"{RESOLVED} select count(*) - count(dict_name) as unknown from r")
def ev_unknown(t: Tables):
    return A.resolve(name_table(t), alias_table(t)).agg(F.count_if(~F.col("known")).alias("unknown"))


@query("ev_per_language", "select d.lang, count(*) as n, round(avg(case when l.quality::varchar = (case when d.n_chars % 7 = 0 then '9' when d.n_chars > 900 then '1' else '0' end) then 1.0 else 0 end), 6) as accuracy from labels l join documents d using (doc_id) group by 1 having count(*) >= 10")
def ev_per_language(t: Tables):
    return L.by_language(guesses(t), "truth", "guess", 10).withColumn("accuracy", F.round("accuracy", 6))


@query("sql_gold", "select vec_id from embeddings where label = 3 or (label > 5 and not label = 8)")
def sql_gold(t: Tables):
    return t.embeddings.where(R.gold_predicate("label = 3 OR (label > 5 AND NOT label = 8)")).select("vec_id")


@query("udf_rag", f"{PAIRS}, s as (select query, list_sort(list(id) filter (similarity >= 0.2)) as sources from r where rank <= 5 group by 1) select query, coalesce(len(sources), 0) = 0 as refused, coalesce(len(sources), 0)::int as n_sources from s")
def udf_rag(t: Tables):
    hits = neighbours(t, 5).withColumn("code", F.col("id"))
    return U.answer_or_refuse(hits, "query", 0.2).select("query", "refused", F.size("sources").alias("n_sources"))


@query("udf_embed_check", "select doc_id, 8 as dimension from documents")
def udf_embed_check(t: Tables):
    return U.embed(t.documents, lambda: U.HashedNgrams(8), "doc_id", "text").select("doc_id", F.size("embedding").alias("dimension"))


@query("udf_benchmark", "select role, count(*) as n, (list_sort(list(length(text)))[(count(*) + 1) // 2] + list_sort(list(length(text)))[count(*) // 2 + 1]) / 2 as median_length, list_sort(list(length(text)))[least((count(*) * 95) // 100, count(*) - 1) + 1] as p95_length from conversations group by 1")
def udf_benchmark(t: Tables):
    rows = t.conversations.select("role", F.length("text").cast("long").alias("length"))
    placed = O.order_statistics(rows, ["role"], "length", {"a": O.lower_middle(), "b": O.upper_middle(), "p95_length": O.at_share(0.95)})
    return placed.join(rows.groupBy("role").agg(F.count("*").alias("n")), "role").select("role", "n", ((F.col("a") + F.col("b")) / 2).alias("median_length"), "p95_length")


# --- the guarded SELECT surface


#: Statements over customers as products; {file} is the path of a table that they may not read, by which each file's rows could be had.
STATEMENTS = {
    "plain": "SELECT c_custkey FROM products WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 15",
    "with": "WITH x AS (SELECT c_mktsegment, count(*) AS n FROM products GROUP BY 1) SELECT n FROM x ORDER BY n LIMIT 3",
    "nested": "SELECT max(c_acctbal) AS m FROM products WHERE c_custkey IN (SELECT c_custkey FROM products WHERE c_acctbal < 0) LIMIT 5",
    "shadow": "WITH secret AS (SELECT * FROM secret) SELECT s.* FROM secret s, products LIMIT 5",
    "function": "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM products LIMIT 1",
    "range": "SELECT id FROM range(1000000), products LIMIT 5",
    "other table": "SELECT * FROM products WHERE c_custkey IN (SELECT o_custkey FROM secret) LIMIT 5",
    "no limit": "SELECT c_custkey FROM products",
    "write": "INSERT INTO products SELECT * FROM products LIMIT 1",
    "file": "SELECT s.* FROM parquet.`{file}` s, products LIMIT 1",
    "file as a dotted name": "WITH `parquet.{file}` AS (SELECT c_custkey FROM products) SELECT s.* FROM parquet.`{file}` s, products LIMIT 1",
    "text as a dotted name": "WITH `text.{file}` AS (SELECT c_custkey FROM products) SELECT s.* FROM text.`{file}` s, products LIMIT 1",
    "collation": "SELECT c_name FROM products WHERE c_name COLLATE UNICODE_CI = 'x' LIMIT 5",
}


@query("sql_guard", "select 'plain' as statement, true as allowed, (select count(*) from (select c_custkey from customer where c_acctbal > 0 limit 15)) as rows union all select 'with', true, (select least(count(distinct c_mktsegment), 3) from customer) union all select 'nested', true, 1 union all select unnest(['shadow', 'function', 'range', 'other table', 'no limit', 'write', 'file', 'file as a dotted name', 'text as a dotted name', 'collation']), false, 0")
def sql_guard(t: Tables):
    guard, file, out = Q.GuardedSession(t.spark, {"products": t.customer}), t.orders.inputFiles()[0], []
    for name, statement in STATEMENTS.items():
        try:
            found = guard.run(statement.format(file=file)).agg(F.count("*").alias("rows"), F.lit(True).alias("allowed")).first()
            out.append((name, found["allowed"], found["rows"]))
        except Q.RejectedSQL:
            out.append((name, False, 0))
    return t.spark.createDataFrame(out, "statement string, allowed boolean, rows long")  # a row a statement
