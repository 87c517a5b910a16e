"""Scans, projections, filters, arrays and maps over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import products as P
from larder.functions import text as X
from larder.operators import corpus as C
from larder.plans.registry import Tables, query
from larder.sources import files as S
from larder.sources import sinks as K


def entries(t: Tables):
    """Conversations as products: one row per conv_id with LIST<STRUCT(lang, text)>, the role as language."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("lang"), "text")))
    return t.conversations.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["lang"].alias("lang"), x["text"].alias("text"))).alias("texts"))


ENTRIES = "select conv_id, list({'lang': role, 'text': text} order by turn, role, text) as texts from conversations group by conv_id"


def dump(t: Tables):
    """Documents as a dump on disk: nested texts and nutrients, tags, codes of which some are no codes."""
    text = lambda lang, text: F.struct(F.lit(lang).alias("lang") if isinstance(lang, str) else lang.alias("lang"), text.alias("text"))
    number = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"), value.alias("100g"), F.lit("g").alias("unit"))
    size = F.col("n_chars").cast("double")
    rows = t.documents.select(
        F.when(F.col("source") == "src9", "none").otherwise(F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("code"),
        "lang",
        F.array(text("main", F.col("text")), text(F.col("lang"), F.concat(F.lit(" "), "text")), text("pl", F.lit(" "))).alias("ingredients_text"),
        F.array(text(F.col("lang"), F.col("source"))).alias("product_name"),
        F.array("source").alias("categories_tags"),
        F.array(number("fat", size), number("unheard-of", size), number("salt", F.when(size > 900, size / 2))).alias("nutriments"),
        (F.col("n_chars") > 5000).alias("obsolete"),
        F.col("n_chars").cast("int").alias("unique_scans_n"),
        F.lit(1).alias("rev"),
    )
    path = K.workspace(t.spark, "dump")
    rows.write.parquet(path)
    return S.read_dump(t.spark, path)


@query("src_parquet_dump", "select lpad(doc_id::varchar, 8, '0') as code, lang, length(trim(text)) as n from documents where source in ('src1', 'src2', 'src9') and source <> 'src9' and n_chars between 1 and 5000 and lang in ('en', 'fr', 'de') and length(trim(text)) >= 200")
def src_parquet_dump(t: Tables):
    rows = S.from_dump(dump(t)).where(C.corpus_predicate(("en", "fr", "de"), ("src1", "src2", "src9"), 200))
    return rows.select("code", "lang", F.length(F.try_element_at("ingredients_text", F.col("lang"))).cast("long").alias("n"))


@query("src_parquet_columns", "select lpad(doc_id::varchar, 8, '0') as code, lang, case when trim(text) = '' then 0 else 1 end as texts, source as name, [source] as categories_tags, n_chars::double as fat, case when n_chars > 900 then n_chars / 2.0 end::double as salt, [] as additives_tags, n_chars > 5000 as obsolete, 'parquet' as source from documents where source <> 'src9'")
def src_parquet_columns(t: Tables):
    nutrient = lambda name: F.try_element_at("nutriments", F.lit(name)).alias(name)
    rows = S.from_dump(dump(t))
    return rows.select("code", "lang", F.size("ingredients_text").alias("texts"), F.try_element_at("product_name", F.col("lang")).alias("name"), "categories_tags", nutrient("fat"), nutrient("salt"), "additives_tags", "obsolete", "source")


@query("src_schema_count", "select cast(count(*) as integer) as columns from (describe documents)")
def src_schema_count(t: Tables):
    columns = F.lit(len(t.documents.schema))
    return t.documents.agg(F.coalesce(F.max(columns), columns).alias("columns"))


@query("src_point_lookup", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7 limit 1")
def src_point_lookup(t: Tables):
    return t.orders.where("o_orderkey = 7").limit(1).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src_delta_jsonl", "select lpad(event_id::varchar, 8, '0') as code, event_type as name, user_id::int as rev, value as fat, cast(json_extract(props, '$.k') as double) as salt from events")
def src_delta_jsonl(t: Tables):
    nutrients = F.struct(F.col("value").alias("fat_100g"), F.get_json_object("props", "$.k").cast("double").alias("salt_100g"), F.lit("g").alias("fat_unit"))
    record = F.to_json(F.struct(F.lpad(F.col("event_id").cast("string"), 8, "0").alias("code"), F.lit("en").alias("lang"), F.col("event_type").alias("product_name_en"), F.col("user_id").alias("rev"), nutrients.alias("nutriments")))
    path = K.workspace(t.spark, "delta")
    t.events.select(F.explode(F.array(record, F.lit(" "), F.lit("{broken"), F.lit('{"code": "x"}'))).alias("value")).write.option("compression", "gzip").text(path)
    fat, salt = (F.try_element_at("nutriments", F.lit(n)).alias(n) for n in ("fat", "salt"))
    return S.from_delta(S.read_delta_lines(t.spark, path)).select("code", F.try_element_at("product_name", F.lit("en")).alias("name"), "rev", fat, salt)


@query("src_training_export", "select d.doc_id as code, d.text as ingredients_text, coalesce(d.lang, 'unknown') as lang, l.quality as nutriscore_grade, l.toxic as nova_group from documents d join labels l using (doc_id) where length(d.text) > 10 and (l.quality is not null or l.toxic is not null)")
def src_training_export(t: Tables):
    from larder.operators.classify import training_frame

    return training_frame(t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("code"), F.col("text").alias("ingredients_text"), "lang", F.col("quality").alias("nutriscore_grade"), F.col("toxic").alias("nova_group")))


@query("src_ingredients_scan", "select o_orderkey, o_totalprice from orders where not (o_orderstatus = 'F') and o_orderpriority = '1-URGENT'")
def src_ingredients_scan(t: Tables):
    return t.orders.where(~(F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_totalprice")


@query("src_off_baseline", "select d.doc_id, d.lang from documents d where d.doc_id in (select doc_id from labels where quality = 1)")
def src_off_baseline(t: Tables):
    return t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query("src_sample_materialise", "select p_brand, count(*) as n, count(distinct p_size) as sizes from (select p_brand, p_size from part order by p_partkey limit 1000) group by p_brand")
def src_sample_materialise(t: Tables):
    sample = t.part.orderBy("p_partkey").limit(1000).select("p_brand", "p_size")
    return sample.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("sizes"))


@query("src_delta_index", "select 'delta_' || epoch(date_trunc('day', ts))::bigint || '.json.gz' as name, epoch(date_trunc('day', ts))::bigint as timestamp from events group by 1, 2")
def src_delta_index(t: Tables):
    days = t.events.select(F.unix_timestamp(F.date_trunc("day", "ts")).alias("d")).distinct()
    path = K.workspace(t.spark, "index")
    names = days.select(F.explode(F.array(F.concat(F.lit(" delta_"), F.col("d").cast("string"), F.lit(".json.gz")), F.lit("index.txt"), F.lit("none.gz"))).alias("value"))
    names.write.text(path)
    return S.parse_index(t.spark, path)


@query("flt_delta_watermark", "select name, timestamp from (select 'delta_' || epoch(date_trunc('day', ts))::bigint || '.json.gz' as name, epoch(date_trunc('day', ts))::bigint as timestamp from events group by 1, 2) where timestamp > 1704240000")
def flt_delta_watermark(t: Tables):
    return S.select_files(src_delta_index(t), 1704240000)


@query("str_retention_gap", "select min(epoch(date_trunc('day', ts))::bigint) as oldest, min(epoch(date_trunc('day', ts))::bigint) > 1700000000 as gap from events")
def str_retention_gap(t: Tables):
    return S.retention_gap(src_delta_index(t), 1700000000)


@query("prj_multilang", f"with e as ({ENTRIES}) select conv_id, len(list_filter(texts, lambda x: x.lang <> 'assistant' and trim(x.text) <> ''))::int as n from e")
def prj_multilang(t: Tables):
    renamed = F.transform("texts", lambda x: F.struct(F.when(x["lang"] == "assistant", "main").otherwise(x["lang"]).alias("lang"), x["text"].alias("text")))
    return entries(t).select("conv_id", F.size(P.multilang(renamed)).alias("n"))


@query("prj_pairs_to_map", f"with e as ({ENTRIES}) select conv_id, list_last(list_filter(texts, lambda x: x.lang = 'user')).text as user_text, list_last(list_filter(texts, lambda x: x.lang = 'assistant')).text as assistant_text from e")
def prj_pairs_to_map(t: Tables):
    m = F.map_from_entries("texts")
    return entries(t).select("conv_id", F.try_element_at(m, F.lit("user")).alias("user_text"), F.try_element_at(m, F.lit("assistant")).alias("assistant_text"))


@query("prj_nutriments", "select l_orderkey, round(max(case when l_linenumber = 1 then l_quantity end), 3) as fat, round(max(case when l_linenumber = 2 then l_quantity end), 3) as salt, round(max(case when l_linenumber = 3 then l_quantity end), 3) as sugars from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) as r from lineitem) where r = 1 group by l_orderkey")
def prj_nutriments(t: Tables):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in ((1, "fat"), (2, "salt"), (3, "sugars"), (4, "unknown-one")) for x in kv]), F.least("l_linenumber", F.lit(4)))
    pairs = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", name.alias("name"), F.col("l_quantity").alias("100g"))))
    rows = t.lineitem.groupBy("l_orderkey").agg(pairs.alias("p")).withColumn("m", P.nutriments(F.col("p")))
    return rows.select("l_orderkey", *[F.round(F.try_element_at("m", F.lit(n)), 3).alias(n) for n in ("fat", "salt", "sugars")])


@query("prj_code_valid", "select o_orderkey from orders where regexp_full_match(cast(o_orderkey as varchar), '[0-9]{4,20}')")
def prj_code_valid(t: Tables):
    return P.valid_codes(t.orders.select("o_orderkey", F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("\n")).alias("code"))).select("o_orderkey")


@query("prj_grade_norm", "select p_partkey, case when lower(trim(right(p_brand, 1))) in ('a','b','c','d','e') then lower(trim(right(p_brand, 1))) when p_size % 7 = 0 then 'c' end as grade from part")
def prj_grade_norm(t: Tables):
    own = P.grade(F.right("p_brand", F.lit(1)))
    return t.part.select("p_partkey", F.coalesce(own, F.when(F.col("p_size") % 7 == 0, P.grade(F.lit(" C ")))).alias("grade"))


@query("prj_languages", f"with e as ({ENTRIES}) select conv_id, list_sort(list_distinct(list_transform(list_filter(texts, lambda x: length(x.text) >= 200), lambda x: x.lang))) as langs from (select conv_id, list({{'lang': lang, 'text': text}}) as texts from (select conv_id, x.lang as lang, arg_max(x.text, i) as text from (select conv_id, unnest(texts) as x, generate_subscripts(texts, 1) as i from e) group by 1, 2) group by 1)")
def prj_languages(t: Tables):
    return entries(t).select("conv_id", P.languages(F.map_from_entries("texts"), 200).alias("langs"))


@query("prj_pick_text", "with l as (select conv_id, role, arg_max(text, (turn, role, text)) as text from conversations group by 1, 2), m as (select conv_id, max(case when role = 'assistant' and length(text) >= 10 then text end) as a, max(case when role = 'user' and length(text) >= 10 then text end) as u, max(case when role = 'system' and length(text) >= 10 then text end) as s from l group by 1) select conv_id, case when a is not null then 'assistant' when u is not null then 'user' else 'system' end as lang, coalesce(a, u, s) as text from m where coalesce(a, u, s) is not null")
def prj_pick_text(t: Tables):
    picked = P.pick_text(F.map_from_entries("texts"), F.lit("assistant"), ("user", "system"), 10)
    return entries(t).select("conv_id", picked.alias("p")).where("p is not null").select("conv_id", "p.lang", "p.text")


@query("prj_pick_name", "with l as (select conv_id, role, arg_max(text, (turn, role, text)) as text from conversations group by 1, 2) select conv_id, coalesce(max(case when role = 'user' then text end), max(case when role = 'assistant' then text end)) as name from l group by 1")
def prj_pick_name(t: Tables):
    return entries(t).select("conv_id", P.pick_name(F.map_from_entries("texts"), F.lit("user"), ("assistant",)).alias("name"))


@query("prj_has_nutrition", "select event_id, not (event_type = 'error') and value is not null and value > 1 as has_data from events")
def prj_has_nutrition(t: Tables):
    values = F.map_filter(F.create_map(F.lit("v"), F.col("value")), lambda k, v: v > 1)
    return t.events.select("event_id", P.has_nutrition_data(F.col("event_type") == "error", values).alias("has_data"))


@query("prj_product_row", "select p_partkey as code, trim(split_part(p_name, ' ', 1)) as brand, cast(p_retailprice as decimal(10,3)) as fat_100g, cast(null as decimal(10,3)) as salt_100g, p_size > 25 as has_nutrition_data from part")
def prj_product_row(t: Tables):
    m = F.create_map(F.lit("fat"), F.col("p_retailprice"))
    cols = {c: e for c, e in zip(("fat_100g", "salt_100g"), [P.nutrient_columns(m)[1].alias("fat_100g"), P.nutrient_columns(m)[7].alias("salt_100g")], strict=True)}
    return t.part.select(F.col("p_partkey").alias("code"), F.trim(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("brand"), cols["fat_100g"], cols["salt_100g"], P.has_nutrition_data(F.col("p_size") <= 25, m).alias("has_nutrition_data"))


@query("prj_summary", "select doc_id as code, lang, source as category, n_chars from documents")
def prj_summary(t: Tables):
    return t.documents.select(F.col("doc_id").alias("code"), "lang", F.col("source").alias("category"), "n_chars")


@query("prj_extraction_row", "select doc_id, length(text) = 0 or length(text) > 9830 as unreadable, case when length(text) = 0 then 'empty' when length(text) > 9830 then 'too_long' end as skip_reason from documents")
def prj_extraction_row(t: Tables):
    reason = F.when(F.length("text") == 0, "empty").when(F.length("text") > X.max_text_length(8192), "too_long")
    return t.documents.select("doc_id", reason.isNotNull().alias("unreadable"), reason.alias("skip_reason"))


INGREDIENTS = "select l_orderkey, list({'n': lower(l_shipmode), 'k': case when l_returnflag = 'R' then 'sugar' else 'base' end, 'e': case when l_linestatus = 'O' then 'e' || l_linenumber end}) as i from (select l_orderkey, l_returnflag, l_linestatus, l_linenumber, 'form' || (l_partkey % 5) as l_shipmode from lineitem) group by 1"


def ingredients(t: Tables):
    item = F.struct(F.concat(F.lit(" FORM"), (F.col("l_partkey") % 5).cast("string")).alias("canonical_name"), F.when(F.col("l_returnflag") == "R", "sugar").otherwise("base").alias("kind"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("e"), F.col("l_linenumber").cast("string"))).otherwise(" ").alias("e_number"))
    return t.lineitem.groupBy("l_orderkey").agg(P.clean_ingredients(F.collect_list(item)).alias("i"))


@query("prj_derived_counts", f"with x as ({INGREDIENTS}) select l_orderkey, list_sort(list_distinct(list_transform(list_filter(i, lambda y: y.k = 'sugar'), lambda y: y.n))) as sugar_names, len(list_distinct(list_transform(list_filter(i, lambda y: y.k = 'sugar'), lambda y: y.n)))::int as distinct_sugar_forms, len(list_filter(i, lambda y: y.e is not null))::int as e_additives_count from x")
def prj_derived_counts(t: Tables):
    return ingredients(t).select("l_orderkey", *[e.alias(n) for n, e in P.ingredient_features(F.col("i")).items()])


@query("prj_ingredient_norm", "select l_orderkey, 'form' || (l_partkey % 5) as name, case when l_linestatus = 'O' then 'e' || l_linenumber end as e_number from lineitem")
def prj_ingredient_norm(t: Tables):
    return ingredients(t).select("l_orderkey", F.explode("i").alias("x")).select("l_orderkey", F.col("x.canonical_name").alias("name"), F.col("x.e_number").alias("e_number"))


@query("prj_off_extraction", "select p_partkey, lower(p_type) as name, case when p_size > 30 then 'additive' else 'base' end as kind, case when p_size > 30 and lower(p_type) like 'e%' then lower(p_type) end as e_number from part")
def prj_off_extraction(t: Tables):
    tag = F.concat(F.lit("en:"), F.col("p_type"))
    rows = t.part.select("p_partkey", F.array(tag).alias("tags"), F.when(F.col("p_size") > 30, F.array(tag)).alias("additives"))
    return rows.select("p_partkey", F.explode(P.tag_extraction(F.col("tags"), F.col("additives"))).alias("x")).select("p_partkey", F.col("x.canonical_name").alias("name"), F.col("x.kind").alias("kind"), F.col("x.e_number").alias("e_number"))


@query("prj_profile", "select p_partkey, concat_ws(chr(10), p_name, case when p_brand <> p_name then p_brand end, lower(p_type), cast(p_size as varchar) || ' units') as profile from part")
def prj_profile(t: Tables):
    return t.part.select("p_partkey", P.profile(F.col("p_name"), F.concat("p_brand", F.lit(", other")), F.array(F.concat(F.lit("en:"), F.col("p_type"))), F.concat(F.lit("<b>"), F.col("p_size").cast("string"), F.lit("</b> units"))).alias("profile"))


@query("prj_card", "select c.c_custkey, c.c_name, coalesce(o.o_orderstatus, 'none') as status from customer c left join (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) o on o.o_custkey = c.c_custkey and o.r = 1")
def prj_card(t: Tables):
    from larder.operators.aliases import latest

    newest = latest(t.orders, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return t.customer.join(newest, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("o_orderstatus", F.lit("none")).alias("status"))


@query("prj_label_cast", "select doc_id, cast(quality as varchar) as label_text from labels where quality is not null")
def prj_label_cast(t: Tables):
    from larder.operators.classify import prepare

    return prepare(t.labels.withColumn("quality", F.col("quality").cast("double")), "quality").select("doc_id", "label_text")


@query("flt_corpus_sql", "select doc_id, lang from documents where lang in ('en', 'fr', 'de') and length(trim(text)) >= 200 and source in ('src1', 'src2', 'src3') and n_chars > 0")
def flt_corpus_sql(t: Tables):
    raw = t.documents.select("doc_id", "lang", F.create_map("lang", "text").alias("ingredients_text"), F.lit(False).alias("obsolete"), F.array().cast("array<string>").alias("data_quality_errors"), F.array("source").alias("categories_tags"), F.col("n_chars").alias("unique_scans_n"))
    return raw.where(C.corpus_predicate(("en", "fr", "de"), ("src1", "src2", "src3"), 200)).select("doc_id", "lang")


@query("flt_text_len", "select doc_id from documents where length(text) > 1000")
def flt_text_len(t: Tables):
    return t.documents.where(F.length("text") > 1000).select("doc_id")


@query("flt_any_label", "select doc_id from labels where quality = 1 or toxic = 1")
def flt_any_label(t: Tables):
    return t.labels.where((F.col("quality") == 1) | (F.col("toxic") == 1)).select("doc_id")


@query("flt_stratum", "select event_id, case when cast(value as int) - 5 > 0 then 'unknown' when cast(value as int) - 5 = 0 then 'control' end as stratum from (select event_id, floor(value) as value from events)")
def flt_stratum(t: Tables):
    return t.events.select("event_id", C.stratum(F.floor("value").cast("int") - 5).alias("stratum"))


@query("flt_search", "select vec_id from embeddings where label in (2, 4)")
def flt_search(t: Tables):
    from larder.operators.retrieval import matching

    rows = t.embeddings.select("vec_id", "label", F.when(F.col("label") % 2 == 0, "en").otherwise("fr").alias("lang"))
    return rows.where(matching(rows, {"lang": "en", "label": (1, 2, 3, 4), "vec_id": None})).select("vec_id")


@query("flt_gold_predicate", "select p_partkey from part where p_name ilike '%a%' and not (p_name ilike '%b%') and (p_brand = 'Brand#11' or p_size > 20)")
def flt_gold_predicate(t: Tables):
    from larder.operators.retrieval import gold_predicate

    return t.part.withColumn("tags", F.array("p_brand")).where(gold_predicate("p_name ILIKE '%a%' AND p_name NOT ILIKE '%b%' AND ('Brand#11' = ANY(tags) OR p_size > 20)")).select("p_partkey")


@query("flt_rare_classes", "select doc_id, source from documents where source in (select source from documents group by source having count(*) >= 50)")
def flt_rare_classes(t: Tables):
    return C.drop_rare_classes(t.documents.select("doc_id", "source"), "source", 50)


@query("flt_done", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def flt_done(t: Tables):
    return C.not_done(t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("flt_fresh_hash", "select d.doc_id, d.h from (select doc_id, substr(sha256(text), 1, 32) as h from documents) d left join (select doc_id, substr(sha256(case when source = 'src1' then text || '!' else text end), 1, 32) as h from documents where lang <> 'de') k on k.doc_id = d.doc_id where k.h is distinct from d.h")
def flt_fresh_hash(t: Tables):
    now = t.documents.select("doc_id", X.short_hash(F.col("text")).alias("h"))
    known = t.documents.where("lang <> 'de'").select("doc_id", X.short_hash(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return C.changed(now, known, "doc_id", "h")


@query("flt_usable_text", "select doc_id, length(text) > 0 and length(text) <= 9830 as usable from documents")
def flt_usable_text(t: Tables):
    return t.documents.select("doc_id", ((F.length("text") > 0) & (F.length("text") <= X.max_text_length(8192))).alias("usable"))


@query("flt_lang_min", "select lang, count(*) as n from documents group by lang having count(*) >= 30")
def flt_lang_min(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 30")


@query("arr_filter_transform", f"with e as ({ENTRIES}) select conv_id, list_transform(list_filter(texts, lambda x: length(x.text) > 100), lambda x: upper(x.lang)) as roles, len(texts)::int as n from e")
def arr_filter_transform(t: Tables):
    return entries(t).select("conv_id", F.transform(F.filter("texts", lambda x: F.length(x["text"]) > 100), lambda x: F.upper(x["lang"])).alias("roles"), F.size("texts").alias("n"))


@query("arr_overlap", "select l_orderkey, list_has_any(list(l_returnflag), ['R']) as has_r, list_contains(list(l_linestatus), 'O') as has_o from lineitem group by l_orderkey")
def arr_overlap(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list("l_linestatus").alias("s"))
    return rows.select("l_orderkey", F.arrays_overlap("f", F.array(F.lit("R"))).alias("has_r"), F.array_contains("s", "O").alias("has_o"))


@query("arr_slice_last", "select l_orderkey, list_slice(x, greatest(len(x) - 3, 1), len(x)) as last4 from (select l_orderkey, list_sort(list(l_partkey)) as x from lineitem group by l_orderkey)")
def arr_slice_last(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("x"))
    return rows.select("l_orderkey", F.slice("x", F.greatest(F.size("x") - 3, F.lit(1)), F.lit(4)).alias("last4"))


@query("arr_default", "select c_custkey, coalesce(x, []) as keys from customer left join (select o_custkey, list_sort(list(o_orderkey)) as x from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def arr_default(t: Tables):
    keys = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("x"))
    return t.customer.join(keys, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.array().cast("array<bigint>")).alias("keys"))


@query("jn_unnest", f"with e as ({ENTRIES}) select conv_id, x.lang as role, length(x.text) as n from (select conv_id, unnest(texts) as x from e)")
def jn_unnest(t: Tables):
    return entries(t).select("conv_id", F.explode("texts").alias("x")).select("conv_id", F.col("x.lang").alias("role"), F.length("x.text").cast("long").alias("n"))


@query("map_build_get", "select event_id, case when event_type = 'view' then value end as view_value, cast(null as double) as missing from events")
def map_build_get(t: Tables):
    m = F.create_map("event_type", "value")
    return t.events.select("event_id", F.try_element_at(m, F.lit("view")).alias("view_value"), F.try_element_at(m, F.lit("none")).alias("missing"))


@query("jsn_path", "select event_id, cast(json_extract(props, '$.k') as int) as k from events where cast(json_extract(props, '$.k') as int) > 50")
def jsn_path(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 50")


@query("jsn_dump_load", "select n_nationkey, n_name, n_regionkey from nation")
def jsn_dump_load(t: Tables):
    text = t.nation.select(F.to_json(F.struct("*")).alias("payload"))
    return text.select(F.from_json("payload", "n_nationkey int, n_name string, n_regionkey int").alias("p")).select("p.*")


@query("jsn_as_number", "select event_id, case when event_id % 3 = 0 then 0.0 else value end as number from events")
def jsn_as_number(t: Tables):
    return t.events.select("event_id", X.as_number(F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.col("value").cast("string"))).alias("number"))


@query("dt_epoch", "select event_id, epoch_us(ts) // 1000000 as seconds, epoch_us(ts) // 1000000 - 86400 * 3 as back from events")
def dt_epoch(t: Tables):
    s = F.unix_timestamp("ts")
    return t.events.select("event_id", s.alias("seconds"), (s - 86400 * 3).alias("back"))


@query("lim_scan", "select doc_id from documents order by doc_id limit 25")
def lim_scan(t: Tables):
    return t.documents.select("doc_id").orderBy("doc_id").limit(25)


@query("srt_code", "select doc_id, row_number() over (order by doc_id) as place from documents")
def srt_code(t: Tables):
    from larder.operators.ranking import global_rank

    return global_rank(t.documents.select("doc_id"), ["doc_id"])


@query("set_categories", "select source, count(*) as n from documents where source in ('src0', 'src5') group by source")
def set_categories(t: Tables):
    return t.documents.where(F.arrays_overlap(F.array("source"), F.array(F.lit("src0"), F.lit("src5")))).groupBy("source").agg(F.count("*").alias("n"))


@query("set_union_strata", "select doc_id, 'q' as stratum from labels where quality = 1 union all select doc_id, 't' as stratum from labels where toxic = 1")
def set_union_strata(t: Tables):
    rows = [t.labels.where(f"{c} = 1").select("doc_id", F.lit(s).alias("stratum")) for c, s in (("quality", "q"), ("toxic", "t"))]
    return rows[0].unionByName(rows[1])


@query("set_missing_nutrients", "select n_name as name from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")
def set_missing_nutrients(t: Tables):
    return t.nation.join(t.supplier.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select(F.col("n_name").alias("name"))


@query("set_labels", "select cast(quality as varchar) as label from labels union select cast(toxic + 1 as varchar) from labels")
def set_labels(t: Tables):
    return t.labels.select(F.col("quality").cast("string").alias("label")).union(t.labels.select((F.col("toxic") + 1).cast("string"))).distinct()
