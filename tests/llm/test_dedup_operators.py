"""Suffix arrays, near duplicates and neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontaminate, flat, neardup, neighbours, scatter, suffixes

DOCS = "doc_id long, text string, keys string, a string, score string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "k", "a", "s") for i, t in texts], DOCS)


# --- suffix arrays -------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "file_rows"), [(1 << 20, 1 << 24), (1, 1 << 24), (5, 0)])
def test_transform_and_prefixes(monkeypatch, tmp_path, block, file_rows):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "FILE_ROWS", file_rows)
    rng = random.Random(9)
    for _ in range(20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 7))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        columns = suffixes.construct(data, starts, ends, f"file://{tmp_path}")
        bwt, lcp, who = (np.concatenate(x).tolist() for x in zip(*columns.read(), strict=True))
        code = {c: k + 1 for k, c in enumerate(sorted(set("".join(texts))))}
        rows = sorted(([code[c] for c in t[i:]] + [-len(texts) + k], t, i, k) for k, t in enumerate(texts) for i in range(len(t) + 1))
        # A terminator is smaller than any symbol; those of different strings differ, in their order.
        rows.sort(key=lambda r: [(0, x) if x < 0 else (1, x) for x in r[0]])
        assert bwt == [code[t[i - 1]] if i else 0 for _, t, i, _ in rows]
        base = max(map(len, texts)) + 1
        assert who == [k * base + len(t) - i for _, t, i, k in rows]
        want = [0]
        for (a, *_), (b, *_) in zip(rows, rows[1:], strict=False):
            want.append(next(k for k in range(len(a)) if a[k] != b[k]))
        assert lcp == want
        columns.drop()
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_first_owners_are_brute_force(monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(0, 14, rng.integers(1, 12))
        text, ends, window = rng.integers(97, 100, sizes.sum()).astype(np.uint8), np.cumsum(sizes), int(rng.integers(1, 6))
        strings, owner, least = [bytes(text[e - n : e]) for e, n in zip(ends, sizes, strict=True)], rng.integers(0, 50, len(sizes)), {}
        for x, o in zip(strings, owner.tolist(), strict=True):
            for k in range(len(x) - window + 1):
                least[x[k : k + window]] = min(o, least.get(x[k : k + window], 99))
        want = [least[x[k : k + window]] for x in strings for k in range(len(x) - window + 1)]
        assert suffixes.first_owner(text, ends - sizes, ends, owner, window).tolist() == want


def plain_removal(texts, window=50):
    least = {}
    for i, t in texts:
        raw = (t or "").encode()
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            least[s] = min(least.get(s, math.inf), math.inf if i is None else i)
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - window + 1):
            if least[raw[p : p + window]] < (math.inf if i is None else i):
                gone[p : p + window] = [True] * window
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rng):
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 90, 300)]
    texts = [(k, say(rng.randint(0, 60)) + rng.choice(shared) + say(rng.randint(0, 60)) + rng.choice(shared)) for k in range(60)]
    return texts + [(5, texts[4][1]), (None, texts[3][1]), (70, None), (71, ""), (72, "x" * 400), (73, "x" * 70), (72, "x" * 400), (74, "ab" * 3000), (75, "ab" * 40)]


def test_removal_is_brute_force(spark):
    texts = passages(random.Random(11))
    got = suffixes.passages(documents(spark, texts)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_removal(texts))
    assert suffixes.passages(documents(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_removal_by_relays_and_hot_anchors(spark, hot):
    texts = passages(random.Random(17)) + [(80, "the same row again and again, " * 3)] * 30
    got = suffixes.passages(documents(spark, texts), hot=hot, chunk_bytes=600, bucket_bytes=300, fan=3).collect()
    assert Counter(map(tuple, got)) == Counter(plain_removal(texts))


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        suffixes.passages(documents(spark, []).withColumn("doc_id", F.lit("a")))


def test_messages_grow_in_proportion(spark):
    """When input, chunks and leaves all double, a chunk still sends at most `fan` messages on each level; without levels it would send one to each leaf."""
    for n in (3000, 6000):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.md5((F.col("id") * 31 + k).cast("string"))), " ").alias("text"))
        chunks, layout = scatter.chunked(docs, "text", "doc_id", chunk_bytes=20_000, bucket_bytes=20_000, fan=20)
        assert layout.levels == 2 and layout.chunks > 140 * n / 3000 and layout.leaves >= layout.chunks
        question = lambda table: neardup.counted(*flat.flat(table.column("text")))[0] << np.uint64(neardup.DROP)
        told, leaves = scatter.sums(chunks, lambda t: (question(t), np.ones(len(question(t)), np.int64)), layout, neardup.DROP)
        relays = -(-layout.chunks // layout.fan) * layout.fan
        assert told.count() <= 20 * layout.chunks and leaves.count() <= 20 * relays
        assert 20 * relays < layout.chunks * layout.leaves / 5


# --- near duplicates -----------------------------------------------------------------------------------


def plain_classes(texts, threshold=0.8, damping=neardup.DAMPING):
    vectors = []
    for _, t in texts:
        w = decontaminate.words_of((t or "").encode())
        vectors.append(Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))))
    df, n = Counter(s for v in vectors for s in v), len(texts)
    weigh = lambda v: {s: c * (1 + damping * math.log((1 + n) / (1 + df[s]))) for s, c in v.items()}
    weights = [weigh(v) for v in vectors]
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders, common, totals = defaultdict(list), defaultdict(float), [sum(w.values()) for w in weights]
    for k, w in enumerate(weights):
        for s in w:
            holders[s].append(k)
    for s, own in holders.items():
        for x in range(len(own)):
            for y in range(x):
                common[own[y], own[x]] += min(weights[own[y]][s], weights[own[x]][s])
    for (y, x), least in common.items():
        if least / (totals[x] + totals[y] - least) >= threshold - 1e-9:
            parent[root(x)] = root(y)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        ids[root(k)].append(i)
    return Counter((i, min(ids[root(k)])) for k, (i, _) in enumerate(texts))


def near_copies(rng):
    texts, k = [], 0
    for size in (1, 1, 2, 5, 12):
        base = [f"w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(80)] = f"x{rng.randrange(999)}"
            texts.append((k, " ".join(own)))
            k += 1
    return texts + [(100, None), (101, ""), (102, "one two"), (103, "ONE, two!"), (104, "one"), (105, texts[0][1]), (106, "..."), (107, texts[0][1])]


@pytest.mark.parametrize("damping", [1.0, 0.1])
def test_classes_are_brute_force(spark, damping):
    texts = near_copies(random.Random(13))
    got = neardup.class_ids(documents(spark, texts), damping=damping).collect()
    assert Counter(map(tuple, got)) == plain_classes(texts, damping=damping)


def test_classes_of_real_texts_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, neardup.class_ids(docs).collect())) == plain_classes([tuple(r) for r in docs.collect()])


def test_one_of_each_class_stays(spark):
    texts = near_copies(random.Random(14)) + [(0, "another text under the same number")]
    kept = neardup.distinct(documents(spark, [*texts, (None, texts[0][1]), (None, "alone and without a number")]))
    assert Counter(r.text for r in kept.where("doc_id is null").collect()) == {"alone and without a number": 1}
    kept = kept.where("doc_id is not null")
    assert kept.columns == ["doc_id", "text", "keys", "a", "score"]
    numbered = [*texts, (9998, texts[0][1]), (9999, "alone and without a number")]
    assert {r.doc_id for r in kept.collect()} == {i for i, c in plain_classes(numbered) if i == c} - {9999}
    assert neardup.class_ids(documents(spark, [])).count() == 0
    assert neardup.class_ids(documents(spark, [(1, None)])).collect() == [(1, 1)]


def test_large_groups_of_near_copies_stay_whole(spark):
    """Each member has words of its own, so what they share is the most frequent of all."""
    rng = random.Random(15)
    base, texts = [f"w{k}" for k in range(200)], []
    for k in range(60):
        own = list(base)
        own[rng.randrange(100)], own[100 + rng.randrange(100)] = f"x{k}", f"y{k}"
        texts.append((k, " ".join(own)))
    texts += [(100 + k, " ".join(f"z{rng.randrange(5000)}" for _ in range(50))) for k in range(40)]
    got = dict(map(tuple, neardup.class_ids(documents(spark, texts)).collect()))
    assert {got[k] for k in range(60)} == {0} and all(got[100 + k] == 100 + k for k in range(40))


def test_buckets_with_several_components_go_on(spark):
    """A bucket's leader is like none of the others, which are like one another."""
    node = lambda k: (k, 0)
    def row(k, keys):
        own = np.array(sorted(keys), np.uint64)
        return (k, k, 0, [7], bytearray(scatter.pack_sorted(own)), bytearray(np.ones(len(own), np.float32).tobytes()), float(len(own)))

    chain = [row(k + 1, range(100 + k, 120 + k)) for k in range(6)]
    table = spark.createDataFrame([row(0, range(5)), *chain], "doc_id long, a long, b long, bands array<long>, keys binary, weights binary, total double")
    for block in (100, 2):
        got = {tuple(r.node): tuple(r.root) for r in neardup.classes(table, block=block).collect()}
        assert {got.get(node(k), node(k)) for k in range(1, 7)} == {node(1)} and got.get(node(0), node(0)) == node(0)


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(1, 1 << 50, n).astype(np.uint64) for n in (300, 60, 60))
    agree = []
    for x in range(40):
        shift = np.uint64(x << 51)
        ka, kb = np.sort(np.concatenate([common, a]) + shift), np.sort(np.concatenate([common, b]) + shift)
        keys = np.concatenate([ka, kb])
        got = neardup.samples(keys, np.ones(len(keys)), np.array([0, len(ka), len(keys)]))
        agree.append((got[0] == got[1]).mean())
    assert np.mean(agree) == pytest.approx((300 / 420) ** neardup.ROWS, abs=0.06)


# --- neighbours ----------------------------------------------------------------------------------------


def test_neighbours_are_exact_on_a_small_table(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).astype(float).tolist(), 1) for k in range(300)]
    rows += [(300 + k, rows[7][1], 1) for k in range(15)]  # ties
    bad = [(400, None, 1), (401, [0.0] * 8, 1), (402, [1.0] * 7, 1), (403, [float("nan")] * 8, 1), (404, [None] * 8, 1), (None, [1.0] * 8, 1), (500, [float("inf")] + [1.0] * 7, 1)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x, ids = np.array([v for _, v, _ in rows]), np.array([k for k, _, _ in rows])
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        top = np.lexsort((ids, d))[:10]
        assert [i for i, _ in found] == ids[top].tolist() and [x for _, x in found] == pytest.approx(d[top].tolist(), rel=1e-14)


def test_neighbours_of_few_or_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_query_rows_are_one_query(spark):
    rows = [(k, [float(k), 1.0]) for k in range(60)]
    frame = spark.createDataFrame([*rows, rows[20], rows[20], rows[21]], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert [r.vec_id for r in got] == [19, 21, 21, 18, 22, 17, 23, 16, 24, 15]


def test_ids_of_several_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [9.0, 1.0]), (1, [1.0, 1.0]), (2, [9.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") == 0, k=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 1, 2, 1.0)]


@pytest.mark.parametrize(("shortlist", "least"), [(20, 0.55), (100, 0.85), (200, 0.9)])
def test_recall(spark, shortlist, least):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = defaultdict(set)
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0, shortlist=shortlist).collect():
        got[r.query_id].add(r.vec_id)
    rows = frame.collect()
    x, ids, right = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows]), 0
    for q, found in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        right += len(found & set(ids[np.argsort(d)[:10]].tolist()))
    assert right >= least * 10 * len(got)
