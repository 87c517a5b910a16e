"""Commits of keyed tables, deltas that break late, and late data in a stream."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from larder.sources import files as R
from larder.streaming import deltas as D
from larder.streaming import late as Y
from larder.streaming.manifest import CommitConflict, ManifestTable

SCHEMA = "code string, rev int, v string"


def plain(batches):
    """What the rules leave: by key the largest revision, of equal ones the later batch; null only where nothing is known."""
    held = {}
    for rows in batches:
        for code, rev, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            old = held.get(code)
            if old is None or old[0] is None or (rev is not None and rev >= old[0]):
                held[code] = (rev, v)
    return {(c, *x) for c, x in held.items()}


def batches(seed, n):
    rnd = random.Random(seed)
    return [[(f"k{rnd.randrange(20)}", rnd.choice([None, 1, 2, 3, 4]), f"b{k}-{j}") for j in range(rnd.randrange(12))] for k in range(n)]


def contents(table):
    return {tuple(r) for r in table.read().collect()}


def folders(path):
    return sorted(str(p.relative_to(path)) for p in (path / "data").glob("*/bucket=*"))


def test_batches_merge_and_folders_do_not_grow(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path), SCHEMA, "code", "rev", buckets=2, most=2)
    some, most = batches(3, 9), 0
    for k, rows in enumerate(some):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert table.apply(frame, k) and not table.apply(frame, k)
        assert contents(table) == plain(some[: k + 1])
        most = max(most, len(folders(tmp_path)))
    assert most <= 2 * 3 * 2 and len(table.versions()) == 2
    assert ManifestTable(spark, str(tmp_path), SCHEMA, "code", "rev", buckets=16).buckets == 2
    assert {tuple(r) for r in table.read(table.versions()[0]).collect()} == plain(some[:-1])


def test_a_crash_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    table = ManifestTable(spark, str(tmp_path), SCHEMA, "code", "rev", buckets=2)
    table.apply(spark.createDataFrame([("a", 1, "old")], SCHEMA), 0)
    before = folders(tmp_path)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="crash"):
        m.setattr(ManifestTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        table.apply(spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], SCHEMA), 1)
    assert len(folders(tmp_path)) > len(before) and contents(table) == {("a", 1, "old")}
    orphans = set(folders(tmp_path)) - set(before)
    assert table.apply(spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], SCHEMA), 1)
    assert contents(table) == {("a", 2, "new"), ("b", 1, "b")} and not orphans & set(folders(tmp_path))


def test_two_writers_conflict(spark, tmp_path, monkeypatch):
    table = ManifestTable(spark, str(tmp_path), SCHEMA, "code", "rev", buckets=2)
    table.apply(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    held = table.current()
    table.apply(spark.createDataFrame([("a", 2, "y")], SCHEMA), 1)
    monkeypatch.setattr(table, "current", lambda: held)
    with pytest.raises(CommitConflict):
        table.apply(spark.createDataFrame([("a", 3, "z")], SCHEMA), 1)
    monkeypatch.undo()
    assert contents(table) == {("a", 2, "y")}


def test_an_empty_table_and_an_empty_batch(spark, tmp_path):
    table = ManifestTable(spark, str(tmp_path), SCHEMA, "code", "rev")
    assert contents(table) == set() and table.current() is None
    assert table.apply(spark.createDataFrame([], SCHEMA), 5) and contents(table) == set() and not table.apply(spark.createDataFrame([("a", 1, "x")], SCHEMA), 4)


def test_a_file_that_breaks_late_leaves_the_one_before(spark, tmp_path):
    good = [[("a", 1, "a1"), ("b", 1, "b1")], [("a", 2, "a2")]]
    for k, rows in enumerate(good):
        spark.createDataFrame(rows, SCHEMA).write.json(str(tmp_path / f"f{k}"))
    broken = tmp_path / "f2"
    broken.mkdir()
    (broken / "part.json").write_text('{"code": "a", "rev": 9, "v": "never"}\n' * 50 + '{"code": \n')
    spark.createDataFrame([("c", 1, "c1")], SCHEMA).write.json(str(tmp_path / "f3"))
    read = lambda p: spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(p)
    state, mark = D.apply_files(spark.createDataFrame([], SCHEMA), [(k, str(tmp_path / f"f{k}")) for k in range(4)], read, None)
    assert mark == 1 and {tuple(r) for r in state.collect()} == plain(good)

    def wrong(path):
        raise TypeError("a mistake in the program")

    with pytest.raises(TypeError):
        D.apply_files(spark.createDataFrame([], SCHEMA), [(1, "x")], wrong, None)


def test_late_rows_are_counted_apart(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rnd = random.Random(8)
    arrivals = [[(rnd.randrange(4), rnd.randrange(1000), start + dt.timedelta(minutes=60 * k + rnd.randrange(-200, 60))) for _ in range(40)] + [(None, 1, start), (1, None, start + dt.timedelta(minutes=60 * k)), (2, 5, None)] for k in range(3)]
    mark, want = dt.datetime(1970, 1, 1), {}
    for rows in arrivals:
        known = [r for r in rows if r[0] is not None and r[2] is not None]
        for key, rev, ts in known:
            held = want.setdefault(key, [None, 0, 0])
            if ts < mark:
                held[2] += 1
            else:
                held[1] += 1
                held[0] = rev if held[0] is None else held[0] if rev is None else max(held[0], rev)
        mark = max([mark, *(ts - dt.timedelta(hours=1) for _, _, ts in known)])
    schema = "key long, rev long, ts timestamp"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in arrivals:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
            Y.arrive(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), "key", "rev", "ts", late="1 hour", idle_ms=600_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r["key"]: [r["rev"], r["merged"], r["late"]] for r in Y.totals(spark, str(tmp_path / "out")).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 5


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_lines_are_numbered_across_splits(spark, tmp_path, split):
    lines = [f"line {k} " + "x" * (k % 37) for k in range(300)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode() + b"\n")
    (tmp_path / "b.txt").write_bytes(b"\n\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in R.numbered_lines(spark, str(tmp_path)).collect()}
        assert split > 100 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.txt", k): v for k, v in enumerate(lines, 1)} | {("b.txt", 1): "", ("b.txt", 2): "", ("b.txt", 3): "last"}
