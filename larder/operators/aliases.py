"""Ingredient names against the alias dictionary, and the three ways of counting sugar forms.

The dictionary is small as a rule (some hundred aliases of some dozen entities) and is checked before it is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping
from functools import cached_property, lru_cache
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.text import key_words, normalize_key
from larder.sources.sinks import workspace, write_table

#: Above so many aliases the dictionary is joined by shuffle.
MAX_BROADCAST = 200_000
#: Rows whose names are looked up together there; a power of two, so that no chunk has rows of two partitions.
CHUNK = 2_048


def small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else frame


def by_language(aliases: DataFrame) -> DataFrame:
    """One canonical name per (key, lang): the last line wins."""
    last = F.max_by(F.struct("canonical_name", "kind"), "line").alias("x")
    return aliases.groupBy("alias_key", "lang").agg(last).select("alias_key", "lang", "x.canonical_name", "x.kind")


def by_key(aliases: DataFrame) -> DataFrame:
    """One canonical name per key without language: the first line keeps the place."""
    first = F.min_by(F.struct("canonical_name", "kind"), "line").alias("x")
    return aliases.groupBy("alias_key").agg(first).select("alias_key", "x.canonical_name", "x.kind")


def conflicts(aliases: DataFrame) -> DataFrame:
    """Keys that name different entities in different lines."""
    return aliases.groupBy("alias_key").agg(F.array_sort(F.collect_set("canonical_name")).alias("names")).where(F.size("names") > 1)


def resolve(names: DataFrame, aliases: DataFrame, key: str = "name_key", lang: str = "lang") -> DataFrame:
    """names with dict_name, dict_kind, known: first by (language, key), then by key alone."""
    exact = small(by_language(aliases).toDF("__k", "__l", "__n1", "__d1"))
    loose = small(by_key(aliases).toDF("__k2", "__n2", "__d2"))
    out = names.join(exact, (F.col(key) == F.col("__k")) & (F.col(lang) == F.col("__l")), "left").join(loose, F.col(key) == F.col("__k2"), "left")
    out = out.withColumn("dict_name", F.coalesce("__n1", "__n2")).withColumn("dict_kind", F.when(F.col("__n1").isNotNull(), F.col("__d1")).otherwise(F.col("__d2")))
    return out.withColumn("known", F.col("dict_name").isNotNull()).drop("__k", "__l", "__n1", "__d1", "__k2", "__n2", "__d2")


def normalised(names: DataFrame, aliases: DataFrame, key: str = "name_key", lang: str = "lang") -> DataFrame:
    """resolve plus name and kind: the dictionary's where it knows the key, else the model's own."""
    out = resolve(names, aliases, key, lang)
    return out.withColumn("name", F.coalesce("dict_name", key)).withColumn("kind", F.when(F.col("known"), F.col("dict_kind")).otherwise(F.col("kind")))


def sugar_forms(named: DataFrame, by: list[str], way: str = "resolved") -> DataFrame:
    """Distinct sugar forms per row: ``resolved`` (dictionary over model), ``dictionary`` (known ones only)."""
    is_sugar = (F.col("kind") == "sugar") if way == "resolved" else (F.col("dict_kind") == "sugar")
    return named.groupBy(*by).agg(F.count_distinct(F.when(is_sugar, F.col("name"))).alias("sugar_forms"))


def unknown_names(named: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent names that the dictionary doesn't know, ties by name."""
    return named.where(~F.col("known")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(limit)


def known_share(named: DataFrame) -> DataFrame:
    return named.agg(F.count("*").alias("names"), F.count_if("known").alias("known"), F.coalesce(F.try_divide(F.count_if("known"), F.count("*")), F.lit(0.0)).alias("share"))


def grounded(names: Iterable[str], words: list[str], forms: Mapping[str, list[list[str]]]) -> list[str]:
    """Those canonical names that the words of a text mention; forms gives each name's aliases as lists of words.

    An alias stands where its words follow each other, the last one in any inflection (a longer word that starts with
    it). Names with the longest aliases choose first, and the words they take are gone for the others. An alias of
    several words that doesn't stand as such counts if all its words are left, in any order, and takes none. Negation
    is not understood.
    """
    order = sorted(range(len(words)), key=lambda at: (words[at], at))
    ordered, free = [words[at] for at in order], [True] * len(words)

    def starting(with_: str) -> list[int]:
        return [at for at in order[bisect_left(ordered, with_) : bisect_right(ordered, with_ + chr(0x10FFFF))] if free[at]]

    def standing(alias: list[str]) -> slice | None:
        head = alias[:-1]
        firsts = (last - len(head) for last in sorted(starting(alias[-1])))
        return next((slice(at, at + len(alias)) for at in firsts if at >= 0 and words[at : at + len(head)] == head and all(free[at : at + len(head)])), None)

    def taken(alias: list[str]) -> bool:
        if (place := standing(alias)) is not None:
            free[place] = [False] * len(alias)
            return True
        return len(alias) > 1 and all(map(starting, alias))

    spelt = lambda alias: (-len(" ".join(alias)), alias)
    by_length = {name: sorted(filter(None, forms[name]), key=spelt) for name in set(names) if name in forms}
    return sorted([name for name, own in sorted(by_length.items(), key=lambda x: (spelt(x[1][0]) if x[1] else (0, []), x[0])) if any(map(taken, own))])


def _sole(own: Iterable[str]) -> str | None:
    """The alias of a name that has one of one word, nothing for a name without aliases, None for the others."""
    some = list(filter(None, own))
    return None if len(some) > 1 or (some and " " in some[0]) else (some or [""])[0]


def plainly(names: Collection[str], words: list[str], sole: Mapping[str, str | None]) -> list[str] | None:
    """``grounded`` for names of one alias of one word each, all different; None for others.

    A word can be taken only by aliases that it starts with, longer ones first. So one that is an alias itself is free
    when its own name chooses. An alias that stands only as the beginning of longer words has one of those, unless
    longer aliases that begin with it take them all.
    """
    aliases = [sole[name] for name in names]
    if None in aliases or len(set(aliases) - {""}) < len(aliases) - aliases.count(""):
        return None
    present = set(words)
    absent = {alias: name for name, alias in zip(names, aliases, strict=True) if alias and alias not in present}
    out = [name for name, alias in zip(names, aliases, strict=True) if alias in present]
    return sorted(out + [absent[alias] for alias in begun(absent, words, lambda: aliases)])


def begun(absent: Collection[str], words: list[str], aliases: Callable[[], list[str]]) -> list[str]:
    """Those of the absent aliases (no word is one) that some longer word is left for; aliases gives all that choose, of one word each."""
    ordered, others, out = sorted(set(words)) if absent else [], None, []
    beginning = lambda alias, some: some[bisect_left(some, alias) : bisect_right(some, alias + chr(0x10FFFF))]
    for alias in absent:
        if longer_words := set(beginning(alias, ordered)):
            others = sorted(aliases()) if others is None else others
            longer = [other for other in beginning(alias, others) if other != alias]
            free = [w for w in words if w in longer_words] if longer else [alias]
            for other in sorted(longer, key=lambda x: (-len(x), x)):
                taken = next((at for at, w in enumerate(free) if w.startswith(other)), None)
                if taken is not None:
                    del free[taken]
            if free:
                out.append(alias)
    return out


class Forms:
    """``grounded`` by one pass over a text, however many aliases there are.

    An Aho-Corasick automaton holds every alias, and every word of an alias of several words, each after a space, so
    that it finds where they begin a word. Only what it finds is then judged, in the order of ``grounded``.
    """

    def __init__(self, forms: Mapping[str, Iterable[str]]) -> None:
        self.own = {name: sorted(filter(None, own), key=lambda alias: (-len(alias), alias)) for name, own in forms.items()}
        self.sole = {name: _sole(own) for name, own in self.own.items()}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for own in self.own.values():
            for alias in own:
                for pattern in {alias, *alias.split(" ")}:
                    out.add_word(" " + pattern, pattern)
        if len(out):
            out.make_automaton()
        return out

    def _places(self, words: list[str], wanted: set[str]) -> dict[str, list[int]]:
        """The numbers of the words at which each wanted pattern begins, ascending."""
        places: dict[str, list[int]] = {pattern: [] for pattern in wanted}
        if words and len(self.automaton):
            number = {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in words[:-1]), initial=0))}
            for end, pattern in self.automaton.iter(" " + " ".join(words)):
                if pattern in places:
                    places[pattern].append(number[end - len(pattern)])
        return places

    def mentioned(self, names: Iterable[str], words: list[str]) -> list[str]:
        """Those of the names that the words mention, sorted."""
        own = {name: self.own[name] for name in set(names) if name in self.own}
        if (plain := plainly(own, words, self.sole)) is not None:
            return plain
        places = self._places(words, {pattern for aliases in own.values() for alias in aliases for pattern in (alias, *alias.split(" "))})
        free = bytearray(b"\1") * len(words)

        def taken(alias: str) -> bool:
            parts = alias.split(" ")
            for at in places[alias]:
                if all(free[at : at + len(parts)]):
                    free[at : at + len(parts)] = bytes(len(parts))
                    return True
            return len(parts) > 1 and all(any(free[at] for at in places[part]) for part in parts)

        longest_first = sorted(own.items(), key=lambda x: (-len(x[1][0]) if x[1] else 0, x[1][:1], x[0]))
        return sorted(name for name, aliases in longest_first if any(map(taken, aliases)))


@lru_cache(1 << 16)
def _spelt_out(name: str | None) -> str:
    return " ".join(key_words(name))


def _key(name: str | None) -> str:
    return name.lower() if name and name.isascii() and name.isalnum() else _spelt_out(name)


def _lookups(aliases: DataFrame) -> DataFrame:
    """alias_key, lang, canonical_name, kind as ``resolve`` finds them; those for any language have a null lang."""
    loose = by_key(aliases).select("alias_key", F.lit(None).cast("string").alias("lang"), "canonical_name", "kind")
    return by_language(aliases).where("lang is not null").unionByName(loose)


def _forms(aliases: DataFrame) -> DataFrame:
    """Each canonical name's aliases, brought to keys."""
    return aliases.groupBy("canonical_name").agg(F.collect_set(normalize_key("alias_key")).alias("forms"))


def ground(rows: DataFrame, aliases: DataFrame, names_col: str = "names", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """rows with ``grounded``: the canonical sugars that the row's names mean and its own text mentions.

    Names are looked up by their keys as ``resolve`` does, by language first where lang_col names one; the text is
    brought to words by the same rule, and any language's alias may stand in it. Up to MAX_BROADCAST aliases are sent
    out as one automaton, and nothing is shuffled. Above that ``ground_by_shuffle`` gives the same. Null names, texts
    and languages are empty; no row is lost.
    """
    if aliases.limit(MAX_BROADCAST + 1).count() > MAX_BROADCAST:
        return ground_by_shuffle(rows, aliases, names_col, text_col, lang_col)
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col else F.lit("")
    entries = {(r["lang"], r["alias_key"]): (r["canonical_name"], r["kind"]) for r in _lookups(aliases).collect()}
    forms = {r["canonical_name"]: r["forms"] for r in _forms(aliases).collect()}
    sent = rows.sparkSession.sparkContext.broadcast((entries, forms))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def mentioned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        found, forms = sent.value
        dictionary = Forms(forms)

        def one(own, text, language) -> list[str]:
            keys = set(map(_key, own if own is not None else []))
            means = [found.get((language, key)) or found.get((None, key)) for key in keys]
            return dictionary.mentioned((e[0] for e in means if e and e[1] == "sugar"), key_words(text))

        for names, texts, langs in batches:
            yield pd.Series(list(map(one, names, texts, langs)), dtype=object)

    return rows.withColumn("grounded", mentioned(names_col, text_col, lang))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (chunk, language, key) of rows that lie chunk by chunk; what a chunk's other rows ask again elsewhere does no harm."""
    at, asked = None, defaultdict(set)

    def keys() -> Iterator[pa.RecordBatch]:
        for lang, names in asked.items():
            found = pa.array(set(map(_key, names)), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), pa.array([lang] * len(found), pa.string()), found], names=["chunk", "lang", "alias_key"])

    for batch in batches:
        place = np.stack([batch.column(c).dictionary_encode().indices.to_numpy() for c in ("chunk", "lang")])
        starts = np.flatnonzero((np.diff(place, prepend=-1) != 0).any(axis=0)).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            chunk, lang = (batch.column(c)[start].as_py() for c in ("chunk", "lang"))
            if chunk != at:
                yield from keys()
                at, asked = chunk, defaultdict(set)
            if len(names := batch.column("names").slice(start, end - start).flatten()):
                asked[lang].update(names.unique().to_numpy(zero_copy_only=False))
    yield from keys()


def _mentioned_of(rows: pa.Table, met: pa.Table) -> pa.Table:
    """A chunk's rows against the entries that its names met.

    Names and words are numbers here: a row's canonical names are held against the aliases that are words of its text.
    Only aliases that are none (``begun``), and rows whose names have other aliases too, are judged one by one.
    """
    by_key, forms = defaultdict(dict), {}
    entries = met["entry"].combine_chunks()
    parts, ends = entries.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(entries).to_numpy()).tolist()
    for lang, key, start, end in zip(met["lang"].to_numpy(), met["alias_key"].to_numpy(), [0, *ends], ends, strict=False):
        by_key[lang][key] = name = parts[start]
        forms[name] = parts[start + 1 : end].tolist()
    canonical = sorted(forms)
    number = {name: k for k, name in enumerate(canonical)}
    sole = [_sole(forms[name]) for name in canonical]
    aliases = sorted({alias for alias in sole if alias})
    alias_at = {alias: k for k, alias in enumerate(aliases)} | {"": -1, None: -2}
    alias_of = np.array([alias_at[alias] for alias in sole], np.int64)

    lists = rows["names"].combine_chunks()
    asked = lists.flatten().fill_null("").dictionary_encode()
    row_of = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).fill_null(0).to_numpy())
    which, keys = asked.indices.to_numpy(), [_key(name) for name in asked.dictionary.to_numpy(zero_copy_only=False)]
    means, langs = np.full(len(which), -1), rows["lang"].to_numpy()
    for lang, own in by_key.items():
        at = np.array([number[own[key]] if key in own else -1 for key in keys], np.int64)
        means = np.where((langs == lang)[row_of], at[which], means)

    pairs = np.sort((row_of * len(canonical) + means)[means >= 0])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    row, name = np.divmod(pairs, max(len(canonical), 1))
    alias = alias_of[name]
    named = np.bincount(row, minlength=len(rows))
    words = [key_words(text) if n else [] for text, n in zip(rows["text"].to_numpy(), named.tolist(), strict=True)]
    word = pc.index_in(pa.array(chain.from_iterable(words), pa.string()), value_set=pa.array(aliases, pa.string())).fill_null(-1).to_numpy()
    word_row = np.repeat(np.arange(len(rows)), [len(w) for w in words])
    stand = row * len(aliases) + alias
    found = (alias >= 0) & np.isin(stand, (word_row * len(aliases) + word)[word >= 0])

    other = np.bincount(row[alias == -2], minlength=len(rows)) > 0
    shared = np.sort(stand[alias >= 0])
    other[shared[1:][shared[1:] == shared[:-1]] // max(len(aliases), 1)] = True
    ends = np.cumsum(named).tolist()
    for r in np.unique(row[other[row] | ((alias >= 0) & ~found)]).tolist():
        own = slice(ends[r] - int(named[r]), ends[r])
        if other[r]:
            names = [canonical[k] for k in name[own].tolist()]
            here = set(Forms({k: forms[k] for k in names}).mentioned(names, words[r]))
            found[own] = [k in here for k in names]
        else:
            absent = {aliases[alias[k]]: k for k in (own.start + np.flatnonzero((alias[own] >= 0) & ~found[own])).tolist()}
            for here in begun(absent, words[r], lambda own=own: [aliases[k] for k in alias[own].tolist() if k >= 0]):
                found[absent[here]] = True

    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(rows)))]).astype(np.int32)
    grounded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(canonical, pa.string()).take(pa.array(name[found])))
    return pa.table({"row": rows["row"], "grounded": grounded})


def ground_by_shuffle(rows: DataFrame, aliases: DataFrame, names_col: str = "names", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``ground`` for a dictionary of any size: each chunk of CHUNK rows gets that part of it that its own names ask for.

    The dictionary's side is made ready first (a row a key, with the aliases of what it means). A chunk asks once for
    each different name, and judges its texts with what comes back. Rows are numbered and written to
    the shared folder first, as chunks are made of the numbers.
    """
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col else F.lit("")
    numbered = write_table(rows.withColumn("__row", F.monotonically_increasing_id()), workspace(rows.sparkSession, "grounding"))
    known = write_table(aliases.select("alias_key", "lang", "canonical_name", "kind", "line"), workspace(rows.sparkSession, "aliases"))
    means = _lookups(known).join(_forms(known), "canonical_name").select("alias_key", F.struct("lang", "kind", F.concat(F.array("canonical_name"), "forms").alias("entry")).alias("m"))
    dictionary = means.groupBy("alias_key").agg(F.collect_list("m").alias("means"))

    texts = numbered.select(F.shiftright("__row", CHUNK.bit_length() - 1).alias("chunk"), F.col("__row").alias("row"), lang.alias("lang"), F.col(names_col).alias("names"), F.col(text_col).alias("text"))
    asked = texts.select("chunk", "lang", "names").mapInArrow(_asked, "chunk long, lang string, alias_key string")
    of_lang = F.filter("means", lambda m: m["lang"] == F.col("lang"))
    anywhere = F.filter("means", lambda m: m["lang"].isNull())
    met = asked.join(dictionary, "alias_key").withColumn("m", F.get(F.concat(of_lang, anywhere), F.lit(0))).where("m.kind = 'sugar'").select("chunk", "lang", "alias_key", "m.entry")
    found = texts.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_mentioned_of, "row long, grounded array<string>")
    return numbered.join(found, numbered["__row"] == found["row"], "left").select(*[numbered[c] for c in rows.columns], found["grounded"])


def with_keys(frame: DataFrame, name: str = "name", key: str = "name_key") -> DataFrame:
    return frame.withColumn(key, normalize_key(F.col(name)))


def latest(versions: DataFrame, key: str = "code", *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(order or (F.desc("extracted_at"), F.desc("id")))))
    return versions.withColumn("__nth", place).where("__nth = 1").drop("__nth")
