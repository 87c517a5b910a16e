"""Personal data and what gives it away: pattern spans plus information-theoretic sanitisation. DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers. The sanitisation then asks of the
whole corpus how strongly a term reveals a protected entity, a value that occurs in several different texts: with
p(e), p(t), p(e, t) the shares of documents that hold them, the disclosure of e by t is PMI(e; t) over the entity's
information content,

    disclosure = log(p(e, t) / (p(e) * p(t))) / -log(p(e)),

1 where every document with the term has the entity. Terms at or over the threshold are generalised, and removed
where they disclose the entity wholly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

# What a match of each kind looks like. Possessive loops end where greedy ones do, as nothing follows
# them, but don't recurse on very long runs; \G|(?<!...) skips starts within a run whose own start has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM_GAP = r"[^\p{L}\p{N}]+"
#: Places whose running sums are taken at once.
STRETCH = 256
#: Code points that a text is cut into where spans are replaced.
CHUNK = 1024
#: Entities, and terms, of a text that meet in one task.
SQUARE = 1000
_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _each(numbers: Column, join: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out"))

    return F.aggregate(numbers, start, step, lambda acc: acc["out"])


def _running(numbers: Column, join: Callable[[Column, Column], Column] = add) -> Column:
    """Sums, or what join makes of longs from 0, of an array up to each place. They are taken in stretches, so that no array of all is copied at each place."""
    own = _let(numbers, lambda xs: F.transform(_stretches(xs), lambda i: _each(F.slice(xs, i, F.lit(STRETCH)), join)))

    def whole(parts: Column) -> Column:
        before = _each(F.transform(parts, lambda xs: F.element_at(xs, -1)), join)
        moved = F.zip_with(parts, F.concat(F.array(F.lit(0).cast("long")), before), lambda xs, at: F.transform(xs, lambda x: join(x, at)))
        return F.flatten(F.slice(moved, F.lit(1), F.size(parts)))

    return _let(own, whole)


def _stretches(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with code-point starts and ends: the pieces between matches give the places."""

    def spans(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = _running(F.zip_with(matches, gaps, lambda m, gap: (F.length(m) + F.length(gap)).cast("long")))
        return F.zip_with(matches, ends, lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).cast("long").alias("start"), end.alias("end"), m.alias("value")))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)


def base_spans(text: Column, kind: str) -> Column:
    """Valid spans of one kind; failing matches are dropped, not retried."""
    found = F.filter(located(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))
    held = text.contains(NEEDS[kind]) & F.rlike(text, F.lit("[0-9]")) if kind != "email" else text.contains("@")
    return F.when(held, found).otherwise(F.array().cast(_SPAN))


def _blanked(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), PATTERNS.values(), text)


def _terms(text: Column, least: int) -> Column:
    words = F.array_distinct(F.split(F.lower(text), _TERM_GAP))
    return F.filter(words, lambda w: (F.length(w) >= least) & w.rlike(r"\p{L}"))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. Many others are laid out by place first, in about as many stretches as each then holds."""
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    last = F.array_max(F.transform(others, lambda s: s["end"]))
    stretches = F.ceil(F.sqrt(F.size(others))).cast("long")

    def by_place(known: Column) -> Column:
        width, end = known["width"], lambda i: (i + 1) * known["width"]
        held = F.transform(F.sequence(F.lit(0).cast("long"), known["n"] - 1), lambda i: F.filter(others, lambda s: (s["start"] < end(i)) & (s["end"] > i * width)))
        floor = lambda at: F.floor(at / width).cast("int")

        def free(at: Column) -> Column:
            def clear(t: Column) -> Column:
                own = F.slice(at, floor(t["start"]) + 1, floor(t["end"] - 1) - floor(t["start"]) + 1)
                return ~F.exists(own, lambda group: F.exists(group, lambda s: overlap(s, t)))

            return F.filter(spans, clear)

        return _let(held, free)

    laid = _let(F.struct(stretches.alias("n"), (F.floor(last / stretches) + 1).cast("long").alias("width")), by_place)
    few = F.filter(spans, lambda t: ~F.exists(others, lambda s: overlap(s, t)))
    return F.when((F.size(spans) == 0) | (F.size(others) <= 16), few).otherwise(laid)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.97, support: int = 3, term_length: int = 4, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, text_hash, base (spans), terms (spans), each span (kind, start, end, value).

    Places are code points, end exclusive. base holds e-mails, then ips, cards and phones, each by start. terms
    (kind ``term``) are words of term_length or more letters or digits whose disclosure of an entity reaches the
    threshold, counted where term and entity meet in at least support different texts; occurrences within base spans
    are left out. The value of a term span is its text, and ``remove:`` stands before it where disclosure is whole.

    A null or empty text has no spans. Very long texts are read whole. Rows that repeat an id and text get equal
    rows; ids may be null. Other columns of docs are ignored, whatever their names; an empty table gives an empty
    result. Terms are broadcast only while there are no more than broadcast_rows of them.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spotted = plain.select("id", "text_hash", "text", F.concat(*(base_spans(F.col("text"), k) for k in PATTERNS)).alias("base"))
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    terms = F.when(F.size("base") > 0, _terms(_blanked(F.col("text")), term_length))
    found = scratch.put(spotted.select("id", "text_hash", "base", F.when(F.size("base") > 0, entities).alias("entities"), terms.alias("terms")), "found")

    # One row per different text that holds an entity, with the number of its copies.
    holders = scratch.put(found.where(F.size("base") > 0).groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "holders")
    held = holders.select("text_hash", "copies", F.explode("entities").alias("entity"))
    protected = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= support).select("entity", "n_e")
    protected = scratch.put(protected, "protected")
    rows, most = found.count(), protected.agg(F.max("n_e")).first()[0] or 0

    # A term in n_t documents can disclose an entity in n_e of rows only if n_t <= rows ** (1 - d) * n_e ** d, so terms
    # that are more common among the holders alone can't; nor can those that meet no protected entity in enough texts.
    near = scratch.put(held.join(protected, "entity").select("text_hash").distinct().withColumn("near", F.lit(True)), "near")
    spoken = holders.join(near, "text_hash", "left").select("text_hash", "copies", "near", F.size("entities").alias("entities"), F.size("terms").alias("terms"), F.explode("terms").alias("term"))
    likely = spoken.groupBy("term").agg(F.sum("copies").alias("n"), F.count("near").alias("texts")).where((F.col("texts") >= support) & (F.col("n") <= 1.000001 * max(rows, 1) ** (1 - disclosure) * most**disclosure))
    likely = scratch.put(likely.select("term", "n"), "likely")
    # A text with very many entities and terms is dealt out in squares of bounded size.
    square = lambda n: F.ceil(F.col(n) / SQUARE).cast("int")
    own = lambda value, n: F.pmod(F.xxhash64(value), square(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), square(n) - 1))
    linked = holders.select("text_hash", "copies", F.size("entities").alias("entities"), F.size("terms").alias("terms"), F.explode("entities").alias("entity")).where("terms > 0").join(protected, "entity")
    linked = linked.select("text_hash", "entity", "n_e", "copies", own("entity", "entities").alias("x"), every("terms").alias("y"))
    said = spoken.where("near").join(likely, "term").select("text_hash", "term", "n", every("entities").alias("x"), own("term", "terms").alias("y"))
    met = linked.join(said, ["text_hash", "x", "y"])
    met = met.groupBy("entity", "term").agg(F.max("n_e").alias("n_e"), F.max("n").alias("n"), F.sum("copies").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    # A term is in no fewer documents than holders, so with their number in its place a disclosure can only be larger.
    information = -F.log(F.col("n_e") / F.lit(float(max(rows, 1))))
    mutual = lambda n_t: F.log(F.col("n_et") * F.lit(float(max(rows, 1))) / (F.col("n_e") * F.col(n_t)))
    met = scratch.put(met.where((information > 0) & (mutual("n") / information >= disclosure - 1e-9)).select("entity", "term", "n_et", "n_e"), "met")

    def small(frame: DataFrame) -> bool:
        return frame.count() <= broadcast_rows

    # How common the candidate terms are in all documents; counted before they meet, unless few are asked for.
    asked = scratch.put(met.select("term").distinct(), "asked")
    everywhere = plain.select(F.explode(_terms(F.col("text"), term_length)).alias("term"))
    if small(asked):
        common = everywhere.join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        common = everywhere.groupBy("term").agg(F.count("*").alias("n_t")).join(asked, "term")
    scored = met.join(common, "term").select("term", (mutual("n_t") / information).alias("disclosure"))
    revealing = scratch.put(scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= disclosure), "revealing")

    # Where those terms stand.
    hits = plain.select("text_hash", F.explode(_terms(F.col("text"), term_length)).alias("term")).join(F.broadcast(revealing) if small(revealing) else revealing, "term")
    whole = F.collect_set(F.when(F.col("disclosure") >= 0.999999, F.col("term")))
    per_text = scratch.put(hits.groupBy("text_hash").agg(F.collect_set("term").alias("words"), whole.alias("whole")), "hits")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    removed = lambda s: F.when(F.array_contains("whole", F.lower(s["value"])), F.concat(F.lit("remove:"), s["value"])).otherwise(s["value"])
    standing = F.transform(located(F.col("text"), pattern, "term"), lambda s: s.withField("value", removed(s)))
    # Written before copies are left out, so that the join alone can be split where a text has very many of them.
    marked = plain.join(F.broadcast(per_text) if small(per_text) else per_text, "text_hash").select("text_hash", standing.alias("terms"))
    marked = scratch.put(marked, "marked").dropDuplicates(["text_hash"])
    out = found.select("id", "text_hash", "base").alias("f").join(marked.alias("m"), "text_hash", "left")
    free = _apart(F.coalesce(F.col("m.terms"), F.array().cast(_SPAN)), F.col("f.base"))
    return out.select(F.col("f.id").alias(id_col), "text_hash", F.col("f.base").alias("base"), free.alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans as [EMAIL], [IP], [CARD], [PHONE], terms as [TERM], or nothing where fully disclosing.

    Overlapping spans are covered as a whole, under the name of the one that starts first.
    """
    spans = F.array_sort(F.transform(F.concat(base, terms), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    tag = lambda s: F.when((s["kind"] == "term") & s["value"].startswith("remove:"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def clean(known: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """Code points a to b, from those chunks that hold them."""
            first, last = (F.floor(x / CHUNK).cast("int") for x in (a, F.greatest(b - 1, a)))
            return F.substring(F.array_join(F.slice(known["chunks"], first + 1, last - first + 1), ""), (a % CHUNK + 1).cast("int"), (b - a).cast("int"))

        ends = _running(F.transform(known["spans"], lambda s: s["end"]), F.greatest)

        def join(ends: Column) -> Column:
            before = F.slice(F.concat(F.array(F.lit(0).cast("long")), ends), F.lit(1), F.size(ends))
            pieces = F.zip_with(known["spans"], before, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(piece(at, s["start"]), tag(s))))
            return F.concat(F.array_join(pieces, ""), piece(F.element_at(ends, -1), F.length(text).cast("long")))

        return _let(ends, join)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    done = _let(F.struct(chunks.alias("chunks"), spans.alias("spans")), clean)
    return F.when(F.size(base) + F.size(terms) == 0, text).otherwise(done)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with text_col sanitised; every row and every other column stays. Null texts stay null."""
    spans = find_personal_data(docs, id_col, text_col, **options).select("text_hash", "base", "terms").where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["text_hash"])
    spans = spans.toDF("__hash", "__base", "__terms")
    joined = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).join(spans, "__hash", "left")
    clean = F.when(F.col("__base").isNull(), F.col(text_col)).otherwise(sanitised(F.col(text_col), F.col("__base"), F.col("__terms")))
    return joined.withColumn(text_col, clean).select(docs.columns)
