from __future__ import annotations

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm.packing import RoomTree, best_fit_decreasing, encoder, pack

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def one_by_one(lengths, capacity):
    """Room left in each sequence after best-fit decreasing, item by item."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_item_by_item(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100])
    items = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 400))]
    lengths = {n: items.count(n) for n in set(items)}
    room, seen, spans = defaultdict(lambda: capacity), defaultdict(set), defaultdict(list)
    for length, lo, hi, first, each, base in best_fit_decreasing(lengths, capacity):
        for rank in range(lo, hi):
            assert rank not in seen[length]
            seen[length].add(rank)
            s, at = first + (rank - lo) // each, base + (rank - lo) % each * length
            room[s] -= length
            spans[s].append((at, at + length))
    assert {n: len(x) for n, x in seen.items()} == lengths and sorted(room.values()) == one_by_one(items, capacity)
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_room_tree():
    tree, rnd, held = RoomTree(30), random.Random(1), []
    for _ in range(300):
        r = rnd.randrange(31)
        if r in held and rnd.random() < 0.6:
            held.remove(r)
            tree.add(r, -1)
        else:
            held.append(r)
            tree.add(r, 1)
        ask = rnd.randrange(31)
        assert tree.tightest(ask) == min((x for x in held if x >= ask), default=None)


def texts():
    rnd = random.Random(9)
    some = ["", None, "a" * 30000, " " * 40000 + "x", "😀é漢" * 500, "it's <|endoftext|> here", "\r\n\t   x", "Ab's 12345 --__ \x00"]
    return some + [" ".join("".join(rnd.choice("abcdeé'1.") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.choice([1, 10, 300, 3000]))) for _ in range(60)]


def test_ids_equal_tokenizers():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in texts():
        assert encoder(RANKS).encode_to_numpy(t or "", allowed_special="all").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_pack(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "no id")]
    got = pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(5), RANKS, with_ids=True).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    have, spans = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= 1024 and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        have[(r.doc_id, r.doc_tokens)][r.start] = r.ids
        spans[r.sequence_id].append((r.offset, r.offset + r.length))
    docs = sorted(([i, [x for s in sorted(p) for x in p[s]]] for (i, _), p in have.items()), key=str)
    assert docs == sorted(([i, ids] for i, all_ids in want.items() for ids in all_ids), key=str)
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    rests = [r.length for r in got]
    assert len(spans) == len(one_by_one(rests, 1024))
    assert pack(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0


def test_very_many_full_windows_are_ranked_in_parts(spark, monkeypatch):
    from larder.llm import packing, ranks

    monkeypatch.setattr(packing, "class_ranks", lambda *a: ranks.class_ranks(*a, part=7))
    got = pack(spark.createDataFrame([(k % 3, "a b " * 900, 1) for k in range(30)], "doc_id long, text string, sequence_id int").repartition(4), RANKS, capacity=64).collect()
    full = [r for r in got if r.length == 64]
    assert len(full) > 800 and len({r.sequence_id for r in full}) == len(full) and {r.offset for r in full} == {0}
    assert sum(r.length for r in got) == 30 * got[0].doc_tokens
