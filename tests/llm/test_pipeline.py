from __future__ import annotations

import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, rows = random.Random(4), []
    for i in range(240):
        w = ["".join(rnd.choice("abcdeilmnorst") for _ in range(rnd.randrange(3, 9))) for _ in range(60)]
        if i % 6 == 0:
            w[10], w[30], w[50] = "vokrat", "Vokrats", "vokrat!"
        elif i % 6 == 1:
            w = rows[-1][1].split() if i % 12 == 1 and "okrat" not in rows[-1][1] else w
            w[5] = "me@host.example"
        rows.append((i, " ".join(w), "en", f"s{i % 3}", len(" ".join(w))))
    for k in range(240, 270):
        base = rows[k - 238][1]
        rows.append((k, base.replace(" ", "  ") if k % 2 else base + " tail", "en", "copy", 1))
    rows += [(270, None, None, None, None), (271, "", "en", "s", 0), (272, " ", "en", "s", 1), (5, rows[5][1], "en", "s2", 9), (None, "no id here", "en", "s", 3)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(r[0], int("okrat" in (r[1] or ""))) for r in rows[:240]], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = rows_of(docs)
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        kept[name] = after = rows_of(docs)
        if name == "toxicity":
            clean = [r for r in before if "okrat" not in (r[1] or "").lower()]
            toxic = [r for r in before if r not in clean]
            assert sum(r not in after for r in clean) <= 3 and sum(r in after for r in toxic) <= 0.2 * len(toxic)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in before:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
            want = {(-len(r[1] or ""), r[0] is None, r[0] or 0): r for g in groups.values() for r in [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))]}
            assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in after) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in want.values())
        elif name == "near_dedup":
            sets = {r[0]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in before for w in [(r[1] or "").lower().split()] if w and r[0] is not None}
            root = {i: i for i in sets}
            for _ in range(5):
                for a in sets:
                    for b in sets:
                        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                            root[a] = root[b] = min(root[a], root[b])
            assert after == [r for r in before if r[0] not in root or root[r[0]] == r[0]] and len(after) < len(before)
        else:
            assert len(after) == len(before) and not any("@" in (r[1] or "") for r in after)
            assert [r for r in before if "@" not in (r[1] or "")] == [r for r in after if "[EMAIL]" not in (r[1] or "")]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = P.packing(spark, docs, folder).collect()
    assert sum(r.length for r in pieces) == sum(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in kept["personal_data"])
    assert len({r.sequence_id for r in pieces}) <= sum(r.length for r in pieces) // 900 + 2


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_is_the_stages(spark, folder):
    assert P.run(spark, folder).count() > 100 and [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]


def test_near_dedup_keeps_other_texts_of_repeated_ids(spark, folder):
    base, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (2, base + " x"), (2, other), (3, other + " x"), (2, other), (None, base), (None, base), (4, None), (4, None), (5, base + " y")]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], SCHEMA)
        got = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, folder).collect()]
        assert sorted(got, key=str) == sorted([(1, base), (2, other), (None, base), (None, base), (4, None)], key=str)
