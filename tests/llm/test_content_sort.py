from __future__ import annotations

import hashlib
import random
import re

from larder.llm.content_sort import content_sort

WHITE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(groups[n])[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [WHITE.sub("", t or "")]}


def test_equals_brute_force_with_a_hot_text(spark):
    rnd = random.Random(2)
    texts = ["same text here"] * 3 + ["".join(rnd.choice("ab \n\té") for _ in range(rnd.choice([0, 3, 4, 5, 2000]))) for _ in range(60)]
    rows = [(i, rnd.choice(texts).replace(" ", rnd.choice([" ", "  ", "\n"])) if i % 3 else "hot  text" + " " * (i % 5)) for i in range(900)] + [(1000, None), (1001, ""), (1002, " \n")]
    rnd.shuffle(rows)
    for partitions in (2, 61):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = content_sort(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(rows)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeats_null_ids_clashing_columns_and_empty(spark):
    frame = spark.createDataFrame([(5, "a b", "x", True), (5, "a b", "y", False), (None, "ab", "z", None), (7, None, "w", None)], "doc_id long, text string, norm string, kept boolean")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in content_sort(frame).collect()), key=str)
    assert got == sorted([(5, 5, 3, True), (5, 5, 3, False), (None, 5, 3, False), (7, 7, 1, True)], key=str)
    assert content_sort(frame.limit(0)).count() == 0
