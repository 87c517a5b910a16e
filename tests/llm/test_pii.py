from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from larder.llm.pii import find_personal_data, sanitise, spans_text

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if x) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_python(spark):
    rnd = random.Random(5)
    parts = ["é", "a.b", "@", ".", "x@y.zz", "1.2.3.4", "300.1.2.3", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "12", "-", " ", "_", "%", "q@w", "a@b.c_d@e.f", "5500000000000004", "😀", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(600)]
    texts += [None, "", "9" * 30000, "a" * 30000 + "@", "a@" + "b." * 3000 + "c", "4" + " 1" * 8000, "1.1" * 2000]
    rows = list(enumerate(texts))
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", spans_text(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: base(t) for i, t in rows}


def brute_terms(rows, disclosure, support):
    n = len(rows)
    holds, has, texts = defaultdict(set), defaultdict(set), dict(rows)
    for i, t in rows:
        blank = t or ""
        for kind, p in PLAIN.items():
            for m in re.finditer(p, t or ""):
                if kind == "email":
                    holds[m[0]].add(i)
        for w in set(re.split(r"[\W_]+", (t or "").lower())):
            if len(w) >= 4 and re.search(r"[^\W\d_]", w):
                has[w].add(i)
    bad = set()
    for e, de in holds.items():
        if len({texts[i] for i in de}) < support:
            continue
        for w, dw in has.items():
            both = [i for i in dw & de if w in re.split(r"[\W_]+", re.sub(PLAIN["email"], " ", texts[i].lower()))]
            if len({texts[i] for i in both}) >= support and de and len(de) < n:
                if math.log(len(both) * n / len(de) / len(dw)) / -math.log(len(de) / n) >= disclosure:
                    bad.add(w)
    return bad


def test_terms_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(300):
        words = [f"common{rnd.randrange(30)}" for _ in range(20)]
        if i % 10 == 0:
            words += ["mail me: boss@corp.example", "Nickname", f"extra{i}"]
        if i % 10 == 0 or i % 3 == 0:
            words.append("halfway")
        if i == 7:
            words.append("nickname")
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, "")]
    bad = brute_terms(rows, 0.97, 3)
    assert bad == {"nickname", "mail"} or "nickname" in bad
    got = {r.doc_id: r.terms for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = [(m.start(), m.end()) for m in re.finditer(PLAIN["email"], t or "")]
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in bad and not any(a < m.end() and m.start() < b for a, b in spans)]
        assert [(s.start, s.end) for s in got[i]] == want
    clean = {r.doc_id: r.text for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "boss@corp" not in clean[0] and "[EMAIL]" in clean[0] and "ickname" not in clean[7] and "halfway" in clean[0] and clean[300] is None
    assert Counter(len(t or "") > 0 for t in clean.values())[True] == 300


def test_extra_columns_repeats_and_empty(spark):
    frame = spark.createDataFrame([(1, "x a@b.cc", "q", 1), (1, "x a@b.cc", "r", 2), (None, "+1 555 010 9999 a@b.cc", "s", 3)], "doc_id long, text string, base string, terms int")
    got = sanitise(frame).collect()
    assert sorted(r.text for r in got) == ["[PHONE] [EMAIL]", "x [EMAIL]", "x [EMAIL]"] and got[0].asDict().keys() == {"doc_id", "text", "base", "terms"}
    assert find_personal_data(frame.limit(0)).count() == 0 and sanitise(frame.limit(0)).count() == 0


def test_a_text_of_very_many_entities_and_terms_meets_in_squares(spark, monkeypatch):
    """Equal results however a text's entities and terms are dealt out."""
    from larder.llm import pii

    rnd = random.Random(5)
    rows = []
    for k in range(40):
        hosts = [f"10.0.{k % 4}.{n}" for n in range(40)] if k < 12 else []
        names = [f"secretname{k % 4}"] if k < 12 else []
        rows.append((k, " ".join([*hosts, *names, *[f"word{rnd.randrange(60)}" for _ in range(50)], f"only{k}"])))
    rows += [rows[0]] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for side in (1000, 7):
        monkeypatch.setattr(pii, "SQUARE", side)
        found[side] = sorted((r.doc_id, pii_spans) for r in find_personal_data(frame).collect() for pii_spans in [[(s.kind, s.start, s.value) for s in [*r.base, *r.terms]]])
        assert any(kind == "term" for _, spans in found[side] for kind, *_ in spans)
    assert found[1000] == found[7]


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"ué{i}@h{i % 7}.org, 10.0.{i % 300}.7" if i % 5 else f"Mondgestein{i}" for i in range(3000))
    frame = spark.createDataFrame([(1, text), (2, "x@y.zz")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in find_personal_data(frame).select("doc_id", spans_text(F.col("base")).alias("s")).collect()}
    assert got == {1: base(text), 2: base("x@y.zz")}
    want, at = [], 0
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in base(text).split(",")))
    for a, b, kind in spans:
        if a >= at:
            want += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    assert {r.doc_id: r.text for r in sanitise(frame).collect()} == {1: "".join(want) + text[at:], 2: "[EMAIL]"}


def test_spans_apart_equal_a_plain_loop(spark):
    from larder.llm.pii import _apart

    rnd = random.Random(3)
    span = lambda: (lambda a: ("k", a, a + rnd.randrange(1, 40), "v"))(rnd.randrange(400))
    rows = [(i, [span() for _ in range(rnd.choice([0, 1, 12]))], [span() for _ in range(rnd.choice([0, 3, 17, 30]))]) for i in range(150)]
    kind = "array<struct<kind:string,start:long,end:long,value:string>>"
    frame = spark.createDataFrame(rows, f"i long, spans {kind}, others {kind}")
    got = {r.i: [(s.start, s.end) for s in r.free] for r in frame.select("i", _apart(F.col("spans"), F.col("others")).alias("free")).collect()}
    assert got == {i: [s[1:3] for s in spans if not any(s[1] < o[2] and o[1] < s[2] for o in others)] for i, spans, others in rows}
