"""Streams with keyed state: restarts, faults, timers; tables that change as a whole."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siftline.operators import review
from siftline.plans import stored
from siftline.sources import files
from siftline.sources.versions import Versions
from siftline.streaming import stateful


def streamed(spark, at, parts, schema, made):
    """What a stream tells of parts that come one after the other, each by a new start; the rows told in all."""
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{at}/in")
        stateful.run_all(made(spark.readStream.schema(schema).parquet(f"{at}/in")), str(at))
    out = made(spark.readStream.schema(schema).parquet(f"{at}/in"))
    return sorted(map(tuple, stateful.told(out, str(at)).collect()), key=repr)


def test_nothing_is_told_twice_and_the_lacking_is_forgotten(spark, tmp_path):
    parts = [[(5, "a", 1), (5, "b", 7)], [(6, "a", 1), (6, "c", 2)], [(6, "a", 1), (7, "a", 3), (7, "b", 7), (7, "c", 1)], [(8, "c", 1)]]
    got = streamed(spark, tmp_path, parts, "run long, key string, value long", lambda rows: stateful.before_stream(rows).select("run", "key", "value", "old"))
    every = sorted({r for p in parts for r in p})
    assert got == sorted(map(tuple, stateful.before(spark.createDataFrame(every, "run long, key string, value long")).select("run", "key", "value", "old").collect()), key=repr)
    frame = spark.createDataFrame(got, "run long, key string, value long, old long")
    first = stateful.baseline(spark, str(tmp_path), 5)
    assert stateful.baseline(spark, str(tmp_path), 9) == first == 5
    assert {(r.run, r.key) for r in stateful.new_since(frame, first).collect()} == {(6, "c"), (7, "b")}
    assert {(r.run, r.key) for r in stateful.grown_since(frame, first).collect()} == {(6, "c"), (7, "a"), (7, "b")}
    assert {(r.run, r.key) for r in stateful.changed_since(frame).collect()} == {(5, "a"), (5, "b"), (6, "c"), (7, "a"), (7, "b"), (7, "c")}


DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def micros(hours):
    return int((at(hours) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_a_lock_is_told_by_its_timer(spark, tmp_path):
    """a is seen once, busy, and never again; b is free after three hours to the second; c and d are told once though busy for long, d in one batch."""
    parts = [[("a", at(1), True), ("b", at(1), True), ("c", at(0), True), ("d", at(0), True), ("d", at(2), True)], [("b", at(4), False), ("d", at(5), True), ("c", at(5), True), ("d", at(4), False)], [("c", at(9), True), ("e", at(9), False)]]
    schema = "key string, ts timestamp, busy boolean"
    got = streamed(spark, tmp_path, parts, schema, stateful.held_stream)
    assert got == [(k, micros(s), micros(s + 3)) for k, s in (("a", 1), ("c", 0), ("d", 0), ("d", 5))]
    batch = stateful.held(spark.createDataFrame([r for p in parts for r in p], schema))
    assert sorted(map(tuple, batch.collect()), key=repr) == got


def test_quiet_folders_are_claimed_by_a_timer(spark, tmp_path):
    parts = [[("x", at(0), True), ("x", at(0.1), False), ("y", at(0), False)], [("x", at(0.15), True), ("z", at(1), True)], [("x", at(2), True), ("w", at(5), True)]]
    schema = "folder string, ts timestamp, counts boolean"
    got = streamed(spark, tmp_path, parts, schema, lambda rows: stateful.claims_stream(rows, 10))
    assert got == [("x", 1, micros(0), micros(0.15), 3, 2), ("x", 2, micros(2), micros(2), 1, 1), ("z", 1, micros(1), micros(1), 1, 1)]
    batch = stateful.claims(spark.createDataFrame([r for p in parts for r in p], schema), 10)
    assert sorted(map(tuple, batch.collect()), key=repr) == got


def test_steps_go_on_after_a_fault(spark, tmp_path):
    parts = [[(1, 1, True), (1, 2, False), (2, 1, False)], [(1, 2, False), (1, 3, True), (2, 3, True)]]
    got = streamed(spark, tmp_path, parts, "batch long, run long, well boolean", stateful.steps_stream)
    assert got == [(1, 1, "claimed", "scanned"), (1, 3, "scanned", "deduped"), (2, 3, "claimed", "scanned")]


def test_a_batch_that_comes_again_after_a_fault_changes_nothing(spark, tmp_path):
    schema = "run long, path string, size double, mtime long"
    table = Versions(spark, str(tmp_path / "table"), "path", "path string, size double, mtime long, scanned long")
    runs = [[(0, "a", 1.0, 1), (0, "b", 1.0, 1), (0, "c", 1.0, 1)], [(1, "a", 1.0, 1), (1, "b", 2.0, 1)], [(2, "a", 1.0, 1), (2, "b", 2.0, 1), (2, "c", 1.0, 1)]]
    faults = {1}

    def take(frame, number):
        stored.rescan(table, frame, number)
        if number in faults:
            faults.discard(number)
            raise RuntimeError("lost after the change")

    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        listings = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        if k in faults:
            with pytest.raises(Exception, match="lost after the change"):
                stateful.rescans(listings, take, str(tmp_path))
            assert table.manifest()["version"] == k + 1
        stateful.rescans(listings, take, str(tmp_path))
    assert table.manifest()["version"] == 3
    assert sorted(map(tuple, table.read().collect())) == [("a", 1.0, 1, 0), ("b", 2.0, 1, 1), ("c", 1.0, 1, 2)]


def test_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "key long, v string")
    read = lambda: sorted(map(tuple, Versions(spark, path, "key", "key long, v string").read().collect()))
    assert files.all_or_nothing(rows((1, "a"), (2, "b")), F.col("v") == "bad", path)
    with pytest.raises(ValueError, match="nothing written"):
        files.all_or_nothing(rows((1, "new"), (3, "bad")), F.col("v") == "bad", path)
    assert read() == [(1, "a"), (2, "b")]
    with monkeypatch.context() as m:  # the rows are there, the manifest isn't
        m.setattr(Versions, "_put", lambda *x: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            files.all_or_nothing(rows((1, "new")), F.col("v") == "bad", path)
    assert read() == [(1, "a"), (2, "b")]
    assert files.all_or_nothing(rows((1, "new"), (4, "d")), F.col("v") == "bad", path, number=7)
    assert not files.all_or_nothing(rows((9, "late")), F.col("v") == "bad", path, number=7)
    assert read() == [(1, "new"), (2, "b"), (4, "d")]
    table = Versions(spark, path, "key", "key long, v string")
    with pytest.raises(FileExistsError):
        table._put(table.manifest())
    assert not [x for x in (tmp_path / "t" / "manifests").iterdir() if not x.name.endswith(".json")]


def test_judged(spark):
    queue = spark.createDataFrame([("a", "r1", False), ("b", None, False), ("c", "r3", True), ("d", "r4", None)], "key string, candidate string, imported boolean")
    asked = [("a", "approve", None, "x"), ("b", "approve", "", "x"), ("b", "skip", None, "x"), ("c", "skip", None, "x"), ("d", "asis", None, ""), ("e", "skip", None, "x"), ("a", "drop", None, "x"), (None, "skip", None, "x")]
    got = review.judged(spark.createDataFrame(asked, "key string, decision string, choice string, reason string"), queue).collect()
    assert {(r.key, r.decision): (r.choice, r.fault) for r in got} == {("a", "approve"): ("r1", "repeated"), ("b", "approve"): (None, "no_choice"), ("b", "skip"): (None, "repeated"), ("c", "skip"): (None, "imported"), ("d", "asis"): (None, "no_reason"), ("e", "skip"): (None, "unknown"), ("a", "drop"): (None, "kind"), (None, "skip"): (None, "unknown")}


class _Store:
    """What a processor needs of a store, for one key, with the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.lists, self.value = 0, set(), [], None

    def getListState(self, name, schema):
        return _List(self)

    def getValueState(self, name, schema):
        return _Value(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _List:
    def __init__(self, store):
        self.store = store

    def appendValue(self, row):
        self.store.calls += 1
        self.store.lists.append(row)

    def put(self, rows):
        self.store.calls += 1
        self.store.lists = list(rows)

    def clear(self):
        self.store.calls += 1
        self.store.lists = []

    def get(self):
        self.store.calls += 1
        return iter(list(self.store.lists))


class _Value:
    def __init__(self, store):
        self.store = store

    def exists(self):
        self.store.calls += 1
        return self.store.value is not None

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, row):
        self.store.calls += 1
        self.store.value = row

    def clear(self):
        self.store.calls += 1
        self.store.value = None


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


@pytest.mark.parametrize("made", [lambda: stateful._Held(3_600_000_000), lambda: stateful._Quiet(600_000_000)])
def test_a_keys_batch_costs_the_store_the_same_however_many_rows_it_has(made):
    """A thousand rows of a key, one an hour, of which the watermark then passes the first half, then all."""

    def calls(n):
        own, store = made(), _Store()
        own.init(store)
        rows = [Row(at=k * 3_600_000_000 + 1, busy=k % 5 > 0, counts=True) for k in range(n)]
        list(own.handleInputRows(("x",), iter(rows), _Now(0)))
        found = []
        for now in (n // 2 * 3_600_000 + 1800_000, (n + 2) * 3_600_000):
            for timer in sorted(t for t in store.timers if t <= now):
                found += own.handleExpiredTimer(("x",), _Now(now), None)
                store.timers.discard(timer)
        return store.calls, len(found)

    few, many = calls(20), calls(1000)
    assert many[1] == 50 * few[1] and few[1] > 3
    assert many[0] == few[0]
