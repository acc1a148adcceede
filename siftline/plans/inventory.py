"""Summaries of an inventory and a library, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import report
from siftline.plans.registry import query, table

_DOCS = "d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _files(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@query(f"""WITH {_DOCS}, t AS (SELECT count(*) AS n FROM d), m(name, value) AS (SELECT 'files', CAST(n AS DOUBLE) FROM t UNION ALL SELECT 'bytes', CAST(sum(n_chars) AS DOUBLE) FROM d UNION ALL SELECT 'hours', round(coalesce(sum(n_chars), 0) / 3600, 1) FROM d UNION ALL SELECT 'tops', CAST(count(DISTINCT source) FILTER (source <> '') AS DOUBLE) FROM d UNION ALL SELECT 'loose', CAST(count(*) FILTER (source = '') AS DOUBLE) FROM d
UNION ALL SELECT 'lossless_bytes', CAST(coalesce(sum(n_chars) FILTER (quality = 1), 0) AS DOUBLE) FROM d UNION ALL SELECT 'errors', CAST(count(toxic) AS DOUBLE) FROM d UNION ALL SELECT 'lang', round(100 * count(*) FILTER (lang <> '') / (SELECT n FROM t), 1) FROM d UNION ALL SELECT 'quality', round(100 * count(quality) / (SELECT n FROM t), 1) FROM d)
SELECT * FROM m""")
def inventory_numbers(spark, sf):
    """DOM-67, AGG-01, AGG-02: one pass over the files, a row for each number; tags as percentages."""
    d, size = _files(spark, sf), F.col("n_chars")
    n, count = F.count("*"), lambda x: F.count(F.when(x, 1))
    share = lambda x: F.round(100 * count(x) / n, 1)
    return report.numbers(d, {"files": n, "bytes": F.sum(size), "hours": F.round(F.coalesce(F.sum(size), F.lit(0)) / 3600, 1), "tops": F.count_distinct(F.when(F.col("source") != "", F.col("source"))), "loose": count(F.col("source") == ""), "lossless_bytes": F.coalesce(F.sum(F.when(F.col("quality") == 1, size)), F.lit(0)), "errors": F.count("toxic"), "lang": share(F.col("lang") != ""), "quality": share(F.col("quality").isNotNull())})


@query(f"""WITH {_DOCS}, r AS (SELECT 'codec' AS panel, coalesce(lang, '?') AS value, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM d GROUP BY 2 UNION ALL SELECT 'rate', CASE WHEN quality = 1 THEN 'VBR' WHEN n_chars >= 3200 THEN '320' WHEN n_chars >= 2560 THEN '256-319' WHEN n_chars >= 1920 THEN '192-255' WHEN n_chars >= 1280 THEN '128-191' ELSE '<128' END, count(*), CAST(sum(n_chars) AS BIGINT) FROM d WHERE lang = 'en' GROUP BY 2)
SELECT * FROM r""")
def inventory_panels(spark, sf):
    """DOM-67, AGG-03, PRJ-06: files and bytes by codec, and by bit rate."""
    from siftline.functions import expr

    d = _files(spark, sf)
    rate = expr.rate_bucket(F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars") / 10)
    return report.panels(d, {"codec": (F.coalesce("lang", F.lit("?")), F.lit(True)), "rate": (rate, F.col("lang") == "en")}, "n_chars")


_LIBRARY = "a AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 > 0 THEN 'A' || (o_custkey % 40) ELSE 'Various Artists' END AS artist, o_custkey % 9 = 0 AS comp, year(o_orderdate) AS year, o_orderpriority AS genre, o_orderstatus AS type, o_orderdate AS added FROM orders), i AS (SELECT l_orderkey AS album, l_quantity * 10 AS length, l_returnflag AS format FROM lineitem)"


def _library(spark, sf):
    o, c = table(spark, sf, "orders"), F.col("o_custkey")
    of = o.select(F.col("o_orderkey").alias("id"), F.when(c % 10 > 0, F.concat(F.lit("A"), (c % 40).cast("string"))).otherwise("Various Artists").alias("artist"), (c % 9 == 0).alias("comp"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("genre"), F.col("o_orderstatus").alias("type"), F.col("o_orderdate").alias("added"))
    return of, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("album"), (F.col("l_quantity") * 10).alias("length"), F.col("l_returnflag").alias("format"))


@query(f"""WITH {_LIBRARY}, r AS (SELECT 'artists' AS panel, artist AS value, count(*) AS n FROM a WHERE NOT comp AND artist <> 'Various Artists' GROUP BY 2 UNION ALL SELECT 'genres', genre, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'types', type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'years', CAST(year AS VARCHAR), count(*) FROM a GROUP BY 2)
SELECT panel, value, n FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, value) AS k FROM r) WHERE k <= CASE panel WHEN 'artists' THEN 20 WHEN 'genres' THEN 15 WHEN 'types' THEN 10 ELSE 1000 END""")
def library_panels(spark, sf):
    """DOM-64, AGG-12: the commonest artists (no compilations), genres, types, and years."""
    of, _ = _library(spark, sf)
    return report.commonest(of, {"artists": (F.when(~F.col("comp") & (F.col("artist") != "Various Artists"), F.col("artist")), 20), "genres": (F.col("genre"), 15), "types": (F.col("type"), 10), "years": (F.col("year").cast("string"), 1000)})


@query(f"""WITH {_LIBRARY}, l AS (SELECT id, year, artist, coalesce(sum(length), 0) AS seconds, count(album) AS tracks, coalesce(max(length), 0) AS longest FROM a LEFT JOIN i ON album = id GROUP BY 1, 2, 3)
SELECT 'oldest' AS record, arg_min(id, (year, id)) AS id FROM l UNION ALL SELECT 'longest_album', arg_min(id, (-seconds, id)) FROM l UNION ALL SELECT 'most_tracks', arg_min(id, (-tracks, id)) FROM l UNION ALL SELECT 'longest_track', arg_min(id, (-longest, id)) FROM l""")
def library_records(spark, sf):
    """DOM-64, AGG-13."""
    of, items = _library(spark, sf)
    return report.records(of, items)


@query(f"""WITH {_LIBRARY} SELECT (SELECT count(*) FROM a) AS albums, (SELECT count(*) FROM i) AS tracks, (SELECT count(DISTINCT artist) FROM a) AS artists, (SELECT CAST(round(sum(length)) AS BIGINT) FROM i JOIN a ON album = id) AS seconds, (SELECT count(*) FROM a WHERE comp) AS compilations, (SELECT count(genre) FROM a) AS with_genre""")
def library_totals(spark, sf):
    """DOM-64."""
    return report.totals(*_library(spark, sf))
