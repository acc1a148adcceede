"""URL filters, archives and the pipeline."""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from siftline.llm import shared, urls, warc


@pytest.mark.parametrize(("url", "host", "path"), [("http://WWW.Example.COM/en/7?x#y", "www.example.com", "/en/7"), ("a://h", "h", ""), ("a://h#/x", "h", ""), ("a://h/p#f?g", "h", "/p"), ("no scheme/en/", "", ""), ("", "", ""), (None, "", ""), ("x://y://z/w", "y:", "//z/w"), ("a://É.org/\nes/", "É.org", "/\nes/")])
def test_parts(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).first()
    assert tuple(row) == (host, path)


def plain_rule(host, path):
    best = (None, None)
    for verdict, rule in urls.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


@pytest.mark.parametrize(("url", "rule"), [("http://example.com/en/1", "com/en/"), ("http://a.example.com/en/71", "example.com/en/7"), ("http://xexample.com/en/71", "com/en/"), ("http://q.net/de/x", "net/de/"), ("http://b.example.net/de/8", "example.net/de/8"), ("http://x.org/es", None), ("http://x.org/es/", "org/es/"), ("http://com/en/", "com/en/")])
def test_rules(spark, url, rule):
    pages = spark.createDataFrame([(1, url, "h", "r")], "page_id long, url string, host string, rule string")
    assert urls.judge(pages).first().rule == rule


def test_every_page_is_judged(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").unionByName(spark.createDataFrame([(9001, None, None), (9001, None, None), (9002, "junk", None)], "page_id long, url string, html string"))
    got = urls.judge(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    plan = urls.op6(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_learner_on_held_out_urls(spark):
    """Labels of half of the hosts' paths are known; the other half is predicted."""
    rows = [(k, f"http://a{k % 7}.site.com/{'ads' if k % 2 else 'news'}/{k}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block" if d % 2 else "allow", f"a{h}.site.com/{'ads' if d % 2 else 'news'}/") for h in range(3) for d in range(2)]
    got = urls.judge(pages, rules=rules).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(open_) > 100 and all((r.verdict == "block") == (r.page_id % 2 == 1) for r in open_)


def test_accuracy_on_the_table(spark):
    """Every second host's labels are known; the learner judges the others, whose rules say what is right."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url is not null").select("page_id", "url")
    every = urls.judge(pages).where("rule is not null").select("page_id", "host", "verdict").collect()
    right = {r.page_id: r.verdict for r in every}
    ids = spark.createDataFrame([(r.page_id,) for r in every], "page_id long")
    known = pages.join(ids, "page_id")
    hosts = sorted({r.host for r in every})
    half = {h for h in hosts if zlib.crc32(h.encode()) % 2}
    parts = known.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    hidden = parts.where(~F.col("host").isin(*half))
    p = urls.learned(parts.where(F.col("host").isin(*half)), hidden, urls.ruled(urls.RULES, F.col("host"), F.col("path"))[1])
    found = [(r.page_id, "block" if r.p_block > 0.5 else "allow") for r in p.collect()]
    assert len(found) > 100 and sum(right[i] == v for i, v in found) / len(found) > 0.9


def test_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://x/y")], "page_id long, url string")
    assert urls.judge(pages).first().verdict == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files(tmp_path, zip64):
    sink = io.BytesIO()
    z = warc.ZipWriter(sink, zip64)
    for name, parts in (("a/é", [b"one", b"two"]), ("empty", []), ("b", [b"x" * 1000])):
        z.begin(name)
        for p in parts:
            z.write(p)
        z.end()
    z.close()
    with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as own:
        assert own.testzip() is None and own.read("a/é") == b"onetwo" and own.namelist() == ["a/é", "empty", "b"]
    (tmp_path / "z.zip").write_bytes(sink.getvalue())
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "z.zip")) as file:
        found = warc.members(file, len(sink.getvalue()))
        assert {k: file.read_at(n, at) for k, (at, n) in found.items()} == {"a/é": b"onetwo", "empty": b"", "b": b"x" * 1000}


def test_foreign_archives_and_damage(tmp_path):
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        found = warc.members(file, path.stat().st_size)
        assert list(found) == ["stored"] and file.read_at(3, found["stored"][0]) == b"abc"
    (tmp_path / "bad").write_bytes(b"nothing" * 9)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as file, pytest.raises(ValueError, match="not a ZIP"):
        warc.members(file, 63)


@pytest.mark.parametrize(("min_bytes", "hot"), [(0, 10_000), (3, 10_000), (0, 2)])
def test_records_round_trip(spark, min_bytes, hot):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u\nv", ""), (5, "u", "é\r\n\r\nx"), (6, "u", "ab"), (7, "u", "ab"), (8, "u", "same"), (8, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    folder = shared.folder(spark, "warc")
    warc.write(warc.plan(pages, min_bytes=min_bytes, hot_rows=hot), folder, archive_bytes=300, zip64=True)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        to = last[html] if len(html.encode()) >= min_bytes and r.page_id != last[html] else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(html.encode()), warc.base32_sha1(html.encode()), to)
        assert r.record_type == ("response" if to is None else "revisit") and bytes(r.payload) == (html.encode() if to is None else b"")


def test_no_pages(spark):
    folder = shared.folder(spark, "warc")
    warc.write(warc.plan(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert warc.read(spark, folder).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "123 !", None, None, 5), (9003, "only a few clean words here", None, None, 27)], docs.schema)
    docs = docs.unionByName(odd).withColumn("tokens", F.lit("clash"))
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
        if name != "byte_bpe":
            assert docs.columns == columns
    assert 9001 not in kept and 9002 not in kept and 9003 in kept
    assert len(corpus_pipeline.STAGES) == 5 and docs.count() == len(kept)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_two_urls_on_many_rows(spark):
    """One URL that is blocked and one that is allowed, ten thousand times each, and one that no rule decides."""
    for seed in range(3):
        urls_ = [f"http://x{seed}.com/en/1", f"http://y{seed}.net/de/1"]
        pages = spark.range(20000).select(F.col("id").alias("page_id"), F.element_at(F.array(*map(F.lit, urls_)), (F.col("id") % 2 + 1).cast("int")).alias("url"))
        pages = pages.unionByName(spark.createDataFrame([(99999, f"http://x{seed}.com/en-2/1")], "page_id long, url string"))
        got = urls.judge(pages)
        assert {tuple(r) for r in got.groupBy("verdict").count().collect()} == {("block", 10001), ("allow", 10000)}
        parts = pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"), F.lit("block").alias("said"))
        assert urls.training(parts, 2).count() == 1 and urls.training(parts).count() == 3
    long = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 200000), (2, "http://b.net/de/")] * 3, "page_id long, url string")
    assert urls.judge(long).count() == 6
