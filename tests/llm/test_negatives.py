"""Hard negatives against all products, and what the cells' bounds leave out."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import negatives

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<double>, label int, row string, cell int, vector string"


def plain(rows, asked, k=5):
    """rows: (vec_id, embedding, label) that take part."""
    held = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows})
    out = []
    for a in (h for h in held if asked(h[0])):
        scored = sorted((-sum(x * y for x, y in zip(a[2], h[2], strict=True)), h[0], h[1]) for h in held if h != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:k]:
            fit = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a[0], p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return out


def mined(spark, rows, asked, **also):
    frame = spark.createDataFrame([(*r, "r", 1, "v") for r in rows], KINDS)
    return sorted(map(tuple, negatives.mine(frame, asked, **also).collect()))


def test_clusters(spark):
    """Clusters of several labels, copies of one vector on a third of all rows, ties, labels of one row, negative and zero scores."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(0, 0.1, 8)).tolist(), int(rng.integers(0, 3))) for k in range(300)]
    rows += [(1000 + k, centres[3].tolist(), 1 if k % 5 else 2) for k in range(150)]
    rows += [(2000, [0.0] * 8, 1), (2001, [0.0] * 8, 1), (2002, [0.0] * 8, 2), (2010, [-1.0] * 8, 7), (2020, [1.0] * 8, 8)]
    odd = [(None, [1.0] * 8, 1), (3000, None, 1), (3010, [1.0] * 8, None), (3020, [1.0] * 7 + [None], 1), (3030, [float("nan")] * 8, 1), (3040, [float("inf")] * 8, 1), (3050, [1.0], 1), (3060, [1e300] * 8, 1)]
    got = mined(spark, rows + odd + rows[:20], F.col("vec_id") % 10 == 0, pivots=9)
    assert got == sorted(plain(rows, lambda i: i % 10 == 0)) and len(got) > 500


def test_one_id_on_several_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (0, [0.9, 0.1], 2), (1, [0.5, 0.5], 1), (2, [0.4, 0.6], 2)]
    assert mined(spark, rows, F.col("vec_id") == 0) == sorted(plain(rows, lambda i: i == 0))


def test_nothing(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame, F.col("vec_id") < 0).count() == 0
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], F.col("vec_id") == 0) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_lose_nothing_and_spare_clusters():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (20, 16))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 16))).astype(np.int64)
    q = x[::40]
    cells = negatives.Cells(centres.round().astype(np.int64), int((x * x).sum(1).max()))
    seen, (asked, plain) = cells.from_candidates(x), cells.from_anchors(q)
    score, norm = q @ x.T, (q * q).sum(1)
    cell = asked.argmin(1)
    sent = 0
    for c in set(cell.tolist()):
        own = np.flatnonzero(cell == c)
        least, top = 0.8 * np.sort(score[own], 1)[:, -5], np.sort(score[own], 1)[:, -1]
        outer = np.sqrt(np.maximum(norm[own] + cells.most - 2 * least, 0)).max()
        inner = np.sqrt(np.maximum(norm[own] + cells.most - 2 * top, 0)).min()
        served = cells.serves(*seen, c, asked[own, c].max(), inner, outer, plain[own, c].max(), least.min(), top.max())
        needed = ((score[own] >= least[:, None]) & (score[own] <= top[:, None])).any(0)
        assert not (needed & ~served).any()
        sent += served.sum()
    assert sent < 0.15 * len(x) * len(set(cell.tolist()))


@pytest.mark.parametrize("size", [3, 40000, 1 << 33])
def test_packing(size):
    import pyarrow as pa

    x = np.random.default_rng(1).integers(-size, size, (50, 6))
    assert (negatives._vectors(pa.array(negatives._packed(x), pa.binary()), 6) == x).all()
    assert negatives._products(x, x).tolist() == [[int(sum(int(a) * int(b) for a, b in zip(r, s, strict=True))) for s in x.tolist()] for r in x.tolist()] or size > 1 << 30


def test_hot_vector_is_few_candidates(spark):
    rows = negatives.prepared(spark.createDataFrame([(k, [1.0, 2.0], 1, "r", 1, "v") for k in range(500)] * 2, KINDS), "vec_id", "embedding", "label", 256)[0]
    assert rows.count() == 500 and Counter(bytes(r.vector) for r in rows.collect()).most_common(1)[0][1] == 500
    got = mined(spark, [(k, [1.0, 2.0], k % 2) for k in range(500)], F.col("vec_id") == 100)
    assert [(r[1], r[3]) for r in got if r[2] == 1] == [(p, 1) for p in (0, 2, 4, 6, 8)]
