"""The pipeline's stages against plain versions, and on odd tables."""

from __future__ import annotations

import math

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_dedup_operators import plain_classes
from test_text_operators import plain_hits, plain_languages

import corpus_pipeline
from siftline.llm import bpe, decontaminate, shared

SF = "/root/testdata/sf0.001"


def plain_kept(texts, window=50):
    """Texts without the characters that lie wholly in windows of a text with a smaller number."""
    least = {}
    for i, t in texts:
        raw = t.encode()
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            least[s] = min(least.get(s, math.inf), i)
    for i, t in texts:
        raw = t.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - window + 1):
            if least[raw[p : p + window]] < i:
                gone[p : p + window] = [True] * window
        at, out = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        yield i, "".join(out)


def plain_clean(text, rows):
    """The text without benchmark passages; None if they are most of it."""
    first = True
    while True:
        n, hit, _ = plain_hits(text, rows)
        if not hit:
            return text
        if first and hit > 0.5 * n:
            return None
        first = False
        automaton = decontaminate.SuffixAutomaton([(str(k), decontaminate.words_of((t or "").encode())) for k, t in rows])
        import numpy as np

        raw = np.frombuffer(text.encode(), np.uint8)
        text = decontaminate.cut(text, [s[2:] for s in automaton.scan(raw, np.array([0, len(raw)]))[1][0]])


def test_the_whole_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    rows = docs.collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = " ".join(bench[0][1].split()[:14])
    extra = [(9000, f"{rows[0].text} {held} {rows[1].text}", "en"), (9001, rows[2].text, "en"), (9002, "12 3", None), (9003, held, "en")]
    kinds = "doc_id long, text string, lang string"
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, kinds))
    texts = [(r.doc_id, r.text, r.lang) for r in frame.collect()]
    kept = [(k, dict((i, t) for i, t, _ in texts)[k]) for k, lang, score in plain_languages([(i, t) for i, t, _ in texts], [(t, x) for _, t, x in texts if x and t]) if lang != "und" and score >= corpus_pipeline.LEAST_SHARE]
    ones = {i for i, c in plain_classes(kept) if i == c}
    cut = list(plain_kept([(i, t) for i, t in kept if i in ones]))
    clean = {i: c for i, t in cut if (c := plain_clean(t, bench)) is not None}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Encoder.load().ranks, special_tokens={})
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        now = shared.written(stage(spark, now, SF), name)
    got = {r.doc_id: list(r.tokens) for r in now.collect()}
    assert set(got) == set(clean) and 9001 not in got and 9002 not in got
    assert got == {i: encoding.encode_ordinary(t) for i, t in clean.items()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, name):
    """No rows; nulls in any column; the same row many times; clashing names beside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"tokens": F.lit("t"), "h": F.lit(1), "class_id": F.lit("c"), "_from": F.lit(2)})
    assert stage(spark, docs.limit(0), SF).count() == 0
    one = docs.where("length(text) between 200 and 900").limit(1)
    none = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)).limit(2)
    odd = shared.written(one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("k").unionByName(none), "odd")
    out = shared.written(stage(spark, odd, SF), "out")
    key = one.first().doc_id
    count = {"language_id": 40, "near_dedup": 1, "suffix_dedup": 40, "decontamination": 40, "byte_bpe": 40}[name]
    assert out.where(F.col("doc_id") == key).count() == count
    assert out.where("doc_id is null").count() == (0 if name == "language_id" else 1 if name == "near_dedup" else 2)
    if name != "byte_bpe":
        assert out.columns == docs.columns


#: Names that stages and their operators use inside, and one that differs by case only.
INSIDE = ["score", "lang_pred", "spans", "_h", "_id", "h", "n", "node", "class_id", "root", "a", "b", "bands", "keys", "weights", "total", "_chunk", "_round", "_from", "_to", "_place", "body", "tokens", "decoded", "n_tokens", "_text", "items", "n_words", "TEXT"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_inner_name(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 100 and 300").limit(30)
    wide = shared.written(docs, "few")
    wide = wide.select("*", *(F.lit(k).alias(f"made_{k}") for k in range(len(INSIDE)))).toDF(*wide.columns, *INSIDE)
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, SF)
    rows = out.collect()
    assert rows
    if name != "byte_bpe":
        assert out.columns == wide.columns and all(list(r)[-len(INSIDE) :] == list(range(len(INSIDE))) for r in rows)
