"""Expressions over product rows: unfolding of nested columns, cleaning, picking of texts, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import clean_category, corpus_code, first_brand, short_hash, strip, strip_markup
from larder.schemas import LANGUAGES, NUTRIENTS

_TEXT = "map<string,string>"


def multilang(c: Column) -> Column:
    """Entries (lang, text) of real languages with a text, trimmed; null is none."""
    held = F.filter(F.coalesce(c, F.array().cast("array<struct<lang:string,text:string>>")), lambda x: (x["lang"] != "main") & x["text"].isNotNull() & (F.trim(x["text"]) != ""))
    return F.transform(held, lambda x: F.struct(x["lang"].alias("lang"), F.trim(x["text"]).alias("text")))


def multilang_map(c: Column) -> Column:
    """The same as a map; the last entry of a language wins."""
    return F.map_from_entries(multilang(c))


def nutriments(c: Column, value: str = "100g") -> Column:
    """The known nutrients that have a value, as a map; a missing nutrient stays missing."""
    held = F.filter(c, lambda x: x["name"].isin(*NUTRIENTS) & x[value].isNotNull())
    return F.map_from_entries(F.transform(held, lambda x: F.struct(x["name"], x[value].cast("double"))))


def clean_texts(c: Column) -> Column:
    """Without the main marker and blanks, trimmed."""
    return F.transform_values(F.map_filter(c, lambda k, v: (k != "main") & v.isNotNull() & (strip(v) != "")), lambda k, v: strip(v))


def grade(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("a", "b", "c", "d", "e"), F.lower(F.trim(c)))


def languages(texts: Column, min_length: int = 0) -> Column:
    """Languages with a text of at least min_length characters, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(texts, lambda k, v: F.length(v) >= min_length)))


def pick_text(texts: Column, main: Column, wanted: tuple[str, ...] = LANGUAGES, min_length: int = 10) -> Column:
    """(lang, text): the main language if usable, else the first wanted one, else the first usable one by name."""
    usable = F.map_filter(texts, lambda k, v: F.length(v) >= min_length)
    order = F.concat(F.array(main, *map(F.lit, wanted)), F.array_sort(F.map_keys(usable)))
    lang = F.element_at(F.filter(order, lambda x: x.isNotNull() & F.map_contains_key(usable, F.coalesce(x, F.lit("")))), 1)
    return F.when(F.size(usable) > 0, F.struct(lang.alias("lang"), F.try_element_at(usable, lang).alias("text")))


def pick_name(names: Column, main: Column, wanted: tuple[str, ...] = LANGUAGES) -> Column:
    return F.coalesce(F.try_element_at(names, main), *[F.try_element_at(names, F.lit(x)) for x in wanted], F.try_element_at(F.map_values(names), F.lit(1)))


def has_nutrition_data(no_data: Column, values: Column) -> Column:
    return ~F.coalesce(no_data, F.lit(False)) & (F.coalesce(F.size(values), F.lit(0)) > 0)


def nutrient_columns(values: Column) -> list[Column]:
    """One decimal column per known nutrient; what is missing is null, never 0."""
    return [F.try_element_at(values, F.lit(name)).cast("decimal(10,3)").alias(column) for name, column in NUTRIENTS.items()]


def product_rows(raw: DataFrame, wanted: tuple[str, ...] = LANGUAGES, min_length: int = 10) -> DataFrame:
    """Canonical rows to the product table."""
    picked = pick_text(F.col("ingredients_text"), F.col("lang"), wanted, min_length)
    return raw.withColumn("picked", picked).select(
        "code",
        F.coalesce(F.col("picked.lang"), F.col("lang")).alias("lang"),
        F.col("picked.text").alias("ingredients_text"),
        pick_name(F.col("product_name"), F.col("lang"), wanted).alias("name"),
        "brands",
        "categories_tags",
        grade(F.col("nutriscore_grade")).alias("nutriscore_grade"),
        "nova_group",
        *nutrient_columns(F.col("nutriments")),
        has_nutrition_data(F.col("no_nutrition_data"), F.col("nutriments")).alias("has_nutrition_data"),
        "unknown_ingredients_n",
        "rev",
        "last_modified_t",
        "source",
    )


def raw_snapshot(frame: DataFrame, source: str, version: str | None) -> DataFrame:
    """(code, payload, source, dump_version, rev): every row whole, as JSON."""
    return frame.select("code", F.to_json(F.struct("*")).alias("payload"), F.lit(source).alias("source"), F.lit(version).cast("string").alias("dump_version"), "rev")


def ingredient_features(ingredients: Column) -> dict[str, Column]:
    """Derived counts of an extraction's ingredients."""
    sugars = F.array_sort(F.array_distinct(F.transform(F.filter(ingredients, lambda i: i["kind"] == "sugar"), lambda i: i["canonical_name"])))
    return {
        "sugar_names": sugars,
        "distinct_sugar_forms": F.size(sugars),
        "e_additives_count": F.size(F.filter(ingredients, lambda i: i["e_number"].isNotNull() & (i["e_number"] != ""))),
    }


def clean_ingredients(ingredients: Column) -> Column:
    """Names stripped and lower-cased, blank E-numbers null."""
    return F.transform(ingredients, lambda i: F.struct(F.lower(strip(i["canonical_name"])).alias("canonical_name"), i["kind"].alias("kind"), F.nullif(F.trim(i["e_number"]), F.lit("")).alias("e_number")))


def tag_extraction(tags: Column, additive_tags: Column) -> Column:
    """Ingredient tags as ingredients: those among the additives are additives, with an E-number if they start with e."""
    from larder.functions.text import strip_tag_prefix

    def one(t: Column) -> Column:
        name, additive = strip_tag_prefix(t), F.array_contains(F.coalesce(additive_tags, F.array().cast("array<string>")), t)
        return F.struct(name.alias("canonical_name"), F.when(additive, "additive").otherwise("base").alias("kind"), F.when(additive & name.startswith("e"), name).alias("e_number"))

    return F.transform(tags, one)


def profile(name: Column, brands: Column, categories: Column, ingredients: Column) -> Column:
    """What is embedded of a product: name, brand unless it is the name, last four categories, up to 2000 characters of text."""
    blank = lambda c: F.nullif(strip_markup(F.coalesce(c, F.lit(""))), F.lit(""))
    brand = blank(first_brand(brands))
    last = F.slice(categories, F.greatest(F.size(categories) - 3, F.lit(1)), F.lit(4))
    cats = F.nullif(F.array_join(F.filter(F.transform(last, clean_category), lambda c: c != ""), ", "), F.lit(""))
    return F.concat_ws("\n", blank(name), F.when(brand != F.coalesce(blank(name), F.lit("")), brand), cats, F.substring(blank(ingredients), 1, 2000))


def profile_hash(text: Column) -> Column:
    return short_hash(text, 32)


def valid_codes(frame: DataFrame) -> DataFrame:
    return frame.withColumn("code", corpus_code(F.col("code"))).where("code is not null")
