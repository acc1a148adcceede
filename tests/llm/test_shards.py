"""Shards against a plain search, and on odd tables."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from siftline.llm import sharding

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, shard string, key string"


def plain_shards(rows, shards):
    """The capacity, by trying every one, and each row's (doc_id, size, shard, slot)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    order = sorted(groups, key=lambda t: min((i for i in groups[t] if i is not None), default=-1))
    sizes = [(len((t or "").encode()) + 1) * len(groups[t]) for t in order]

    def fits(c):
        n, left = 0, 0
        for s in sizes:
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= shards

    capacity = max(sizes, default=0)
    while not fits(capacity):
        capacity += 1
    return capacity


def checked(rows, got, shards):
    """Groups stay whole and in order, slots have no gaps, no shard is above the smallest capacity."""
    size, of, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    text = dict(rows)
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in rows)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r["size"]
        of[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in of.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values(), default=0) <= plain_shards(rows, shards)
    return size


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_minimax(spark, shards):
    rows = [(k, "x" * (k * 37 % 101)) for k in range(60)] + [(100 + k, "y" * 700) for k in range(2)] + [(None, "z"), (200, None), (201, None), (202, "")]
    frame = spark.createDataFrame([(*r, "s", "k") for r in rows], KINDS)
    size = checked(rows, sharding.assign(frame, shards=shards).collect(), shards)
    assert len(size) == shards


def test_one_text_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 64)
    rows = [(k, f"text {k}" if k % 3 else "the same") for k in range(1500)]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], KINDS)
    got = sharding.assign(frame).collect()
    checked(rows, got, 8)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order[:500]] == list(range(0, 1500, 3))


def test_repeated_rows_and_none(spark):
    frame = spark.createDataFrame([(1, "a", None, None)] * 50, KINDS)
    got = sharding.assign(frame).collect()
    assert {r.shard for r in got} == {got[0].shard} and sorted(r.slot for r in got) == list(range(50))
    assert sharding.assign(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="shards"):
        sharding.assign(frame, shards=0)


def test_native(spark):
    plan = sharding.op13(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "Cartesian", "NestedLoop"))
