from __future__ import annotations

import zlib
from collections import Counter

from larder.llm.ring import arcs, overflow, ring_shards


def by_rows(nodes, counts, shards):
    """One row at a time: the first shard clockwise that has room."""
    return {(arc, rank) for arc, n in enumerate(counts) for rank in range(n)}


def test_every_row_placed_once_within_one(spark):
    rows = [(i, "x" * (i % 50) + "é") for i in range(1013)] + [(None, "a"), (None, None), (3, None), (3, "xxxé")]
    got = ring_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=40).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_overflow_goes_clockwise_only_past_full_shards():
    nodes = arcs(7, 16)
    counts = [(k * 37) % 23 for k in range(len(nodes))]
    pieces = overflow(nodes, counts, 7)
    assert {(a, r) for a, lo, hi, _, _ in pieces for r in range(lo, hi)} == by_rows(nodes, counts, 7) and sum(p[2] - p[1] for p in pieces) == sum(counts)
    load = Counter()
    for _, lo, hi, shard, first in pieces:
        assert first == load[shard]
        load[shard] += hi - lo
    assert max(load.values()) - min(load.values()) <= 1
    for arc, _, _, shard, _ in pieces:  # each shard that an overflow passed is full in the end
        way = list(dict.fromkeys(nodes[(arc + j) % len(nodes)][1] for j in range(len(nodes))))
        assert all(load[s] >= sum(counts) // 7 for s in way[: way.index(shard)])


def test_movement_is_limited(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "'x' as shard")
    got = ring_shards(rows, shards=8, replicas=256).collect()
    assert sum(r.shard != r.home_shard for r in got) < 0.2 * len(got)
    grown = {r.doc_id: r.shard for r in ring_shards(rows, shards=9, replicas=256).collect()}
    moved = [grown[r.doc_id] for r in got if grown[r.doc_id] != r.shard]
    assert 4000 // 9 <= len(moved) < 0.3 * len(got) and sum(s == 8 for s in moved) > 0.5 * len(moved)
    assert ring_shards(rows.limit(0)).count() == 0


def test_one_key_on_most_rows_is_ranked_in_parts(spark, monkeypatch):
    from larder.llm import ranks, ring

    monkeypatch.setattr(ring, "class_ranks", lambda *a: ranks.class_ranks(*a, part=50))
    rows = [(7, "same")] * 900 + [(i, "x") for i in range(100)]
    got = ring_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=6).collect()
    per = Counter(r.shard for r in got)
    assert len(got) == 1000 and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))


def test_shards_do_not_depend_on_the_layout(spark, monkeypatch):
    from larder.llm import ranks, ring

    monkeypatch.setattr(ring, "class_ranks", lambda *a: ranks.class_ranks(*a, part=20))
    rows = [(7, "same")] * 300 + [(8, "y")] * 45 + [(None, None)] * 30 + [(i, "x" * (i % 9)) for i in range(1200)]
    seen = set()
    for files in (1, 4, 11):
        docs = spark.createDataFrame(rows[files:] + rows[:files], "doc_id long, text string").repartition(files)
        got = ring_shards(docs, shards=6, replicas=4).collect()
        assert len(got) == len(rows)
        seen.add(tuple(sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32, r.shard, r.slot) for r in got)))
    assert len(seen) == 1
