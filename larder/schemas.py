"""Schemas of the data model: what both product sources converge to, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = T.MapType(T.StringType(), T.StringType())
_TAGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Names and types of the nested Parquet dump as it is written.
DUMP = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("lang", T.StringType()),
        *[T.StructField(c, T.ArrayType(_struct(lang=T.StringType(), text=T.StringType()))) for c in ("ingredients_text", "product_name", "generic_name")],
        T.StructField("brands", T.StringType()),
        *[T.StructField(c, _TAGS) for c in ("categories_tags", "food_groups_tags", "countries_tags", "labels_tags")],
        T.StructField("nutriscore_grade", T.StringType()),
        T.StructField("nutriscore_score", T.IntegerType()),
        T.StructField("nova_group", T.IntegerType()),
        T.StructField("nutriments", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("100g", T.DoubleType()), T.StructField("unit", T.StringType())]))),
        T.StructField("nutrition_data_per", T.StringType()),
        T.StructField("no_nutrition_data", T.BooleanType()),
        *[T.StructField(c, _TAGS) for c in ("ingredients_tags", "ingredients_original_tags", "additives_tags", "allergens_tags", "traces_tags", "ingredients_analysis_tags")],
        *[T.StructField(c, T.IntegerType()) for c in ("ingredients_n", "known_ingredients_n", "unknown_ingredients_n", "additives_n")],
        T.StructField("obsolete", T.BooleanType()),
        T.StructField("completeness", T.DoubleType()),
        T.StructField("data_quality_errors_tags", _TAGS),
        T.StructField("unique_scans_n", T.IntegerType()),
        T.StructField("popularity_key", T.LongType()),
        T.StructField("rev", T.IntegerType()),
        T.StructField("last_modified_t", T.LongType()),
        T.StructField("created_t", T.LongType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)

# Names of the one row type that both sources are brought to.
RAW_PRODUCT = _struct(
    code=T.StringType(), lang=T.StringType(), ingredients_text=_TEXTS, product_name=_TEXTS, generic_name=_TEXTS, brands=T.StringType(),
    categories_tags=_TAGS, labels_tags=_TAGS, nutriscore_grade=T.StringType(), nova_group=T.IntegerType(),
    nutriments=T.MapType(T.StringType(), T.DoubleType()), no_nutrition_data=T.BooleanType(), additives_tags=_TAGS, allergens_tags=_TAGS,
    unknown_ingredients_n=T.IntegerType(), obsolete=T.BooleanType(), data_quality_errors=_TAGS, unique_scans_n=T.IntegerType(),
    rev=T.IntegerType(), last_modified_t=T.LongType(), source=T.StringType(),
)

INGREDIENT = _struct(canonical_name=T.StringType(), kind=T.StringType(), e_number=T.StringType())
EXTRACTION = _struct(ingredients=T.ArrayType(INGREDIENT), allergens=_TAGS, unreadable=T.BooleanType(), model_confidence=T.DoubleType())
PREDICTION = _struct(code=T.StringType(), system=T.StringType(), extraction=EXTRACTION, input_tokens=T.IntegerType(), output_tokens=T.IntegerType(), latency_s=T.DoubleType())
ALIAS = _struct(alias_key=T.StringType(), lang=T.StringType(), canonical_name=T.StringType(), kind=T.StringType(), line=T.IntegerType())

# Nutrient name in the sources -> column of the product table.
NUTRIENTS = {
    "energy-kcal": "energy_kcal_100g",
    "fat": "fat_100g",
    "saturated-fat": "saturated_fat_100g",
    "carbohydrates": "carbohydrates_100g",
    "sugars": "sugars_100g",
    "fiber": "fiber_100g",
    "proteins": "proteins_100g",
    "salt": "salt_100g",
    "sodium": "sodium_100g",
    "fruits-vegetables-nuts-estimate-from-ingredients": "fruits_vegetables_nuts_estimate_100g",
    "nutrition-score-fr": "nutrition_score_fr_100g",
}
# Kinds of ingredients, and why a text was not taken apart.
KINDS = ("base", "sugar", "fat", "additive", "flavouring", "preservative", "sweetener")
SKIP_REASONS = ("empty", "too_long", "output_limit", "model_unreadable")
# Languages and categories of the corpus.
LANGUAGES = ("en", "ru", "de", "fr", "pl")
CATEGORIES = (
    "en:sweet-snacks",
    "en:salty-snacks",
    "en:biscuits-and-cakes",
    "en:chocolates",
    "en:confectioneries",
    "en:sweetened-beverages",
    "en:yogurts",
    "en:cheeses",
    "en:breakfast-cereals",
)
