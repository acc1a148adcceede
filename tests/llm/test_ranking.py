"""Ranked search against a plain one, and what blocks it leaves packed."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from siftline.llm import ranking

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [] if text is None else TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain_search(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * len(held)) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("parts", [{}, {"chunk_bytes": 20000}, {"chunk_bytes": 3000, "item_bytes": 2500}])
def test_same_as_plain(spark, parts):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()]
    long = "the " * 3000 + docs[5][1]
    docs += [(None, docs[3][1]), (None, docs[3][1]), (7000, None), (7001, ""), (7002, "..."), (7003, long), (7004, "ÄÖ ÄÖ äö x2")] + [(8000, "tied words here")] * 3 + [(k, "tied words here") for k in range(8101, 8120)]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()] + [(900, None), (901, ""), (902, "nowhere-at-all zzzzqq"), (903, "Tied TIED words"), (903, "äö Ö"), (None, docs[0][1][:300])]
    left = spark.createDataFrame([(*r, 0, "t") for r in docs], "doc_id long, text string, score int, item string")
    right = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, block int")
    got = sorted(map(tuple, ranking.search(left, right, **parts).collect()), key=repr)
    assert got == sorted(plain_search(docs, items), key=repr)


def test_nothing(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0


def built(n, kinds, rng):
    """A chunk of n documents, in which term t is in every kinds[t]-th or so."""
    lengths = rng.integers(20, 400, n)
    rows, hashes = [], []
    for t, every in enumerate(kinds, 1):
        own = np.flatnonzero(rng.random(n) < 1 / every)
        own = np.repeat(own, rng.geometric(0.6, len(own)))
        rows.append(own)
        hashes.append(np.full(len(own), t, np.uint64))
    row = dict(zip(ranking._FIELDS, ranking._indexed([np.arange(n)], [lengths], rows, hashes), strict=True))
    row["lengths"], row["terms"] = np.asarray(row["lengths"]), np.asarray(row["terms"])
    chunk = ranking.Chunk(row)
    chunk.weigh(n, int(lengths.sum()))
    every = np.zeros((len(kinds) + 1, n), np.int64)
    for own, h in zip(rows, hashes, strict=True):
        np.add.at(every, (h.astype(int), own), 1)
    m = 25 + (75 * lengths * n) // int(lengths.sum())
    return chunk, (10**9 * every) // (1000 * every + 8 * m)


def test_blocks_below_the_threshold_stay_packed():
    rng = np.random.default_rng(3)
    chunk, adds = built(60000, [2, 3, 400, 900], rng)
    hashes, weights = np.arange(1, 5, dtype=np.uint64), np.array([400, 900, 6000, 7000])
    got = chunk.search(hashes, weights, [], 10, 1)
    score = weights @ adds[1:]
    order = np.lexsort((np.arange(len(score)), -score))[:10]
    assert got == [(-int(score[i]), int(i)) for i in order]
    assert len(chunk.unpacked) < 0.7 * len(chunk.widths)
    again = ranking.Chunk.__new__(ranking.Chunk)
    again.__dict__ = chunk.__dict__ | {"unpacked": {}}
    assert again.search(hashes, weights, [], 10, -got[-1][0]) == got and len(again.unpacked) < len(chunk.unpacked)


@pytest.mark.parametrize("width", [0, 1, 5, 17, 31])
def test_packing(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 128)
    assert (ranking.unpack(np.frombuffer(ranking.pack(values, width), np.uint8), 128, width) == values).all()


def test_impacts():
    tf, n = np.array([3, 1, 3, 5, 2]), np.array([40, 10, 30, 90, 30])
    assert ranking.skyline(tf, n).tolist() == [[5, 90], [3, 30], [1, 10]]
