"""Readers: the nested Parquet dump, JSON-lines deltas with dynamic keys, the dictionary, typed record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions.products import clean_texts, multilang_map, nutriments
from larder.functions.text import corpus_code, normalize_key
from larder.schemas import DUMP, NUTRIENTS, RAW_PRODUCT
from larder.sources.sinks import workspace, write_table

_NONE = "array<string>"


class SourceError(RuntimeError):
    """A source that isn't there or can't be read."""


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The dump under its explicit schema: only these columns are read, and columns an old version lacks are null."""
    try:
        return spark.read.schema(DUMP).parquet(path)
    except Exception as e:
        raise SourceError(f"no dump at {path}") from e


def dump_versions(dump: DataFrame) -> DataFrame:
    """(name, dump_version) of a dump's files: size and time of change, which tell one state of a file from another."""
    at = F.unix_timestamp(F.col("_metadata.file_modification_time")).cast("string")
    version = F.concat(F.lit("size="), F.col("_metadata.file_size").cast("string"), F.lit(";modified="), at)
    return dump.select(F.col("_metadata.file_name").alias("name"), version.alias("dump_version")).distinct()


def from_dump(dump: DataFrame) -> DataFrame:
    """Dump rows to the canonical row; rows without a valid code are left out."""
    tags = lambda c: F.coalesce(c, F.array().cast(_NONE)).alias(c)
    rows = dump.select(
        corpus_code(F.col("code")).alias("code"), "lang", *[multilang_map(F.col(c)).alias(c) for c in ("ingredients_text", "product_name", "generic_name")],
        "brands", tags("categories_tags"), tags("labels_tags"), "nutriscore_grade", "nova_group", F.coalesce(nutriments(F.col("nutriments")), F.create_map().cast("map<string,double>")).alias("nutriments"),
        "no_nutrition_data", tags("additives_tags"), tags("allergens_tags"), "unknown_ingredients_n", "obsolete",
        F.coalesce("data_quality_errors_tags", F.array().cast(_NONE)).alias("data_quality_errors"), "unique_scans_n", "rev", "last_modified_t", F.lit("parquet").alias("source"),
    )
    return rows.where("code is not null").select([f.name for f in RAW_PRODUCT])


def read_delta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record map<string,string>, broken): one row per non-blank line; gzip is opened by its name."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return lines.select("value", record.alias("record")).withColumn("broken", F.col("record").isNull() | (F.size("record") == 0))


def delta_multilang(record: Column, prefix: str) -> Column:
    """Keys ``prefix_xx`` of two or three letters as a map by language; blanks are dropped."""
    held = F.map_filter(record, lambda k, v: k.rlike(rf"^{prefix}_\p{{L}}{{2,3}}$") & v.isNotNull() & (F.trim(v) != ""))
    return clean_texts(F.transform_keys(held, lambda k, v: F.substring(k, len(prefix) + 2, 9)))


def delta_nutriments(record: Column) -> Column:
    """Numeric ``name_100g`` values by name; what is no number is skipped."""
    values = F.from_json(record["nutriments"], "map<string,string>")
    held = F.map_filter(values, lambda k, v: k.endswith("_100g") & v.try_cast("double").isNotNull())
    return F.transform_values(F.transform_keys(held, lambda k, v: F.regexp_replace(k, "_100g$", "")), lambda k, v: v.try_cast("double"))


def from_delta(lines: DataFrame) -> DataFrame:
    """Delta records to the canonical row; broken lines and rows without a valid code are left out."""
    r = F.col("record")
    tags = lambda key, name: F.coalesce(F.from_json(r[key], _NONE), F.array().cast(_NONE)).alias(name)
    whole = lambda key, kind: r[key].try_cast(kind).alias(key)
    rows = lines.where(~F.col("broken")).select(
        corpus_code(r["code"]).alias("code"), r["lang"].alias("lang"), *[delta_multilang(r, c).alias(c) for c in ("ingredients_text", "product_name", "generic_name")],
        r["brands"].alias("brands"), tags("categories_tags", "categories_tags"), tags("labels_tags", "labels_tags"), r["nutriscore_grade"].alias("nutriscore_grade"), whole("nova_group", "int"),
        F.coalesce(delta_nutriments(r), F.create_map().cast("map<string,double>")).alias("nutriments"), whole("no_nutrition_data", "boolean"), tags("additives_tags", "additives_tags"), tags("allergens_tags", "allergens_tags"),
        whole("unknown_ingredients_n", "int"), whole("obsolete", "boolean"), tags("data_quality_errors_tags", "data_quality_errors"), whole("unique_scans_n", "int"), whole("rev", "int"), whole("last_modified_t", "bigint"), F.lit("delta").alias("source"),
    )
    return rows.where("code is not null").select([f.name for f in RAW_PRODUCT])


def parse_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, timestamp) of the delta files that an index lists, oldest first; the first 9 to 11 digits are the time."""
    names = spark.read.text(path).select(F.trim("value").alias("name")).where(F.col("name").endswith(".gz"))
    return names.withColumn("timestamp", F.regexp_extract("name", r"(\d{9,11})", 1).try_cast("bigint")).where("timestamp is not null").orderBy("timestamp")


def select_files(files: DataFrame, watermark: int | None) -> DataFrame:
    return files if watermark is None else files.where(F.col("timestamp") > watermark)


def retention_gap(files: DataFrame, watermark: int | None) -> DataFrame:
    """gap: whether the oldest file there is newer than the watermark, so that history is lost between them."""
    return files.agg(F.min("timestamp").alias("oldest")).withColumn("gap", F.coalesce(F.col("oldest") > F.lit(watermark).cast("bigint"), F.lit(False)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines from 1, whatever number of splits a file is read in.

    Within a split rows are numbered as they are read; a split begins where those before it end, which takes one row a
    split to know. Lines end at a line feed, and a carriage return before it is no part of them.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("value"))
    read = write_table(read.withColumn("turn", F.monotonically_increasing_id()), workspace(spark, "lines"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy("file", "split").agg(F.min("turn").alias("from"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return read.join(splits, ["file", "split"]).select("file", (F.col("turn") - F.col("from") + F.col("before") + 1).alias("line"), "value")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(alias_key, lang, canonical_name, kind, line) of a dictionary of JSON lines with // comments.

    Every canonical name is an alias under the language xx; a broken line is an error that names it.
    """
    lines = numbered_lines(spark, path).select(F.col("line").cast("int").alias("line"), "value")
    lines = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    entry = F.from_json("value", "canonical_name string, kind string, aliases map<string,array<string>>")
    parsed = lines.select("line", entry.alias("e")).withColumn("ok", F.coalesce(F.col("e.canonical_name").isNotNull(), F.lit(False)))
    checked = parsed.withColumn("line", F.when(F.col("ok"), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("broken dictionary line "), F.col("line").cast("string"))).cast("int")))
    given = checked.select("line", "e.canonical_name", "e.kind", F.explode(F.map_entries(F.col("e.aliases"))).alias("a")).select("line", "canonical_name", "kind", F.col("a.key").alias("lang"), F.explode("a.value").alias("alias"))
    own = checked.select("line", "e.canonical_name", "e.kind", F.lit("xx").alias("lang"), F.col("e.canonical_name").alias("alias"))
    return own.unionByName(given).select(normalize_key("alias").alias("alias_key"), "lang", "canonical_name", "kind", "line").where("alias_key <> ''")


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed JSON lines; a missing file is no rows, a broken line an error."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not spark._jvm.org.apache.hadoop.fs.FileSystem.get(jvm.toUri(), spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_by_line(log: DataFrame, key: str = "code", position: str = "position") -> DataFrame:
    """The last record of each key of a resume log."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return log.withColumn("__nth", place).where("__nth = 1").drop("__nth")


def write_records(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def missing_nutrients(found: DataFrame, name: str = "name") -> DataFrame:
    """Known nutrients that a probe did not find."""
    spark = found.sparkSession
    return spark.createDataFrame([(n,) for n in NUTRIENTS], "name string").join(found.select(F.col(name).alias("name")), "name", "left_anti")
