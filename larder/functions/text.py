"""Text functions as Column expressions; a Pandas UDF only where Spark has no Unicode normalisation or entity table."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


class _Letters(dict):
    """What each lower-case character counts for in a key: its letters and digits without accents, nothing for a mark, else a gap."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code))
        self[code] = out = "".join(c if c.isalnum() else " " for c in parts if not unicodedata.combining(c))
        return out


_LETTERS = _Letters()


def key_words(name: str | None) -> list[str]:
    """The words of a name's key. The rule is fixed by the dictionary: letters and digits count, the rest parts words."""
    return (name or "").lower().translate(_LETTERS).split()


@F.pandas_udf(T.StringType())
def normalize_key(names: pd.Series) -> pd.Series:
    """Dictionary key of a name: lower case, no combining marks, punctuation and dashes as single spaces."""
    return names.map(lambda name: " ".join(key_words(name)), na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def strip_markup(c: Column) -> Column:
    """Tags of up to 200 characters as spaces, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, "<[^>]{0,200}>", " "), rf"{WHITE}+", " "))


def max_text_length(context: int) -> int:
    return int(context * 0.4 * 3)


# What is cut off both ends of a composition, as the data model asks: white space, dashes and these marks.
EDGE_NOISE = r"[\s\-–—_*.,;:]+"


def prepare_text(c: Column, context: int = 8192) -> Column:
    """Struct (text, too_long, had_markup, is_usable) of a raw composition text."""
    raw = F.coalesce(c, F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(unescape_html(raw), "<[^>]+>", " "), rf"{WHITE}+", " ")
    edge = EDGE_NOISE
    text = F.regexp_replace(plain, f"^{edge}|{edge}$", "")
    long = F.length(text) > max_text_length(context)
    return F.struct(text.alias("text"), long.alias("too_long"), raw.rlike("<[^>]+>").alias("had_markup"), ((text != "") & ~long).alias("is_usable"))


def clean_category(tag: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(tag)), "^[a-z]{2}:", ""), F.lit("-"), F.lit(" "))


def first_brand(brands: Column) -> Column:
    return F.trim(F.split_part(brands, F.lit(","), F.lit(1)))


def strip_tag_prefix(tag: Column) -> Column:
    """What follows the first colon, the whole tag if that is empty."""
    after = F.regexp_replace(tag, "^[^:]*:", "")
    return F.lower(F.trim(F.replace(F.when(after == "", tag).otherwise(after), F.lit("-"), F.lit(" "))))


def short_hash(text: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def shuffle_key(code: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of codes."""
    return F.md5(F.concat(code.cast("string"), F.lit(str(seed))))


def script_letters(text: Column) -> tuple[Column, Column]:
    """Numbers of Cyrillic and of Latin letters."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[\x{0400}-\x{04FF}]")), F.regexp_count(t, F.lit("[A-Za-z]"))


def detect_language(text: Column, min_letters: int = 10) -> Column:
    """``ru`` or ``en`` by script; empty below min_letters or at a tie."""
    cyrillic, latin = script_letters(text)
    return F.when((cyrillic + latin < min_letters) | (cyrillic == latin), "").when(cyrillic > latin, "ru").otherwise("en")


def is_cyrillic(text: Column) -> Column:
    cyrillic, latin = script_letters(text)
    return (cyrillic > 0) & (cyrillic > latin)


def citations(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d{6,14})\]"), F.lit(1))))


def normalize_barcode(text: Column) -> Column:
    return F.when(strip(text).rlike(r"^\d{6,14}$"), strip(text))


def corpus_code(code: Column) -> Column:
    """A code of the corpus, 4 to 20 digits, else null."""
    return F.when(strip(code).rlike(r"^\d{4,20}$"), strip(code))


def alias_pattern(alias: Column) -> Column:
    """A word that starts with the alias, in any inflection; alias words may be apart by any white space."""
    return F.concat(F.lit(r"(?iu)(?<!\p{L})\s*\Q"), alias, F.lit(r"\E\p{L}*"))


def mentions_alias(text: Column, aliases: Column) -> Column:
    return F.exists(aliases, lambda a: F.rlike(text, alias_pattern(a)))


def tokens_present(text: Column, alias: Column) -> Column:
    """All of an alias's two or more words occur, in any order."""
    tokens = F.split(alias, " ")
    return (F.size(tokens) >= 2) & F.forall(tokens, lambda t: F.rlike(text, alias_pattern(t)))


def found_stems(text: Column, stems: list[str]) -> Column:
    """Which of the stems occur, lower case, sorted, each once."""
    pattern = "(?iu)(" + "|".join(re.escape(s) for s in stems) + ")"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower)))


def is_model_annotator(name: Column, prefixes: tuple[str, ...] = ("claude", "gpt", "llm", "model", "qwen")) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).rlike("^(" + "|".join(prefixes) + ")")


def parse_ingredients(line: Column) -> Column:
    """``name:kind, ...`` as an array of (canonical_name, kind); the kind is base unless given; blank names are dropped."""
    parts = F.filter(F.transform(F.split(line, ","), lambda p: F.trim(p)), lambda p: p != "")
    name = lambda p: F.trim(F.split_part(p, F.lit(":"), F.lit(1)))
    kind = lambda p: F.when(p.contains(":"), F.lower(F.trim(F.split_part(p, F.lit(":"), F.lit(2))))).otherwise(F.lit("base"))
    return F.transform(parts, lambda p: F.struct(name(p).alias("canonical_name"), kind(p).alias("kind")))


def as_number(c: Column) -> Column:
    """A log's number: null and blank count as 0, anything else that is no number is an error."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")).cast("double"), F.lit(0.0))
