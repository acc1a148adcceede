"""The library and its audit, bound to the test tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import albums, audit, identity, report, review, similarity
from siftline.plans import collection
from siftline.plans.registry import query, table
from siftline.sources import files as sources


def _text(*parts):
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


_MODE = "(SELECT album, arg_min({0}, (-n, seen)) AS {0} FROM (SELECT album, {0}, count(*) AS n, min((id, name)) AS seen FROM f WHERE {0} IS NOT NULL AND {0} <> '' GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH f AS (SELECT l_orderkey AS album, l_partkey AS id, 'n' || l_linenumber || l_suppkey || l_quantity || l_extendedprice AS name, CASE WHEN l_partkey % 4 > 0 THEN '' ELSE l_linestatus END AS albumartist, l_returnflag AS artist, CASE WHEN l_partkey % 3 > 0 THEN 'T' || (l_partkey % 5) END AS title, CAST(year(l_shipdate) AS VARCHAR) AS date, l_linestatus AS codec, l_quantity / 4 AS minutes, CASE WHEN l_suppkey % 3 = 0 THEN 'confirmed' WHEN l_suppkey % 3 = 1 THEN 'mismatch' END AS verdict FROM lineitem),
s AS (SELECT album, string_agg(k || ':' || name, ';' ORDER BY k) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY album ORDER BY id, name) AS k FROM f) WHERE k <= 8 GROUP BY 1)
SELECT album, count(*) AS files, round(sum(minutes), 1) AS minutes, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'mismatch') AS mismatch, count(*) FILTER (verdict IS NULL) AS "none", any_value(coalesce(b.albumartist, a.artist)) AS artist, any_value(t.title) AS title, any_value(d.date) AS date, any_value(c.codec) AS codec, any_value(sample) AS sample
FROM f JOIN s USING (album) LEFT JOIN {_MODE.format('albumartist')} b USING (album) LEFT JOIN {_MODE.format('artist')} a USING (album) LEFT JOIN {_MODE.format('title')} t USING (album) LEFT JOIN {_MODE.format('date')} d USING (album) LEFT JOIN {_MODE.format('codec')} c USING (album) GROUP BY 1""")
def local_evidence(spark, sf):
    """DOM-20: each album's commonest tags, minutes, verdicts and first files."""
    l, part = table(spark, sf, "lineitem"), F.col("l_partkey")
    verdict = F.when(F.col("l_suppkey") % 3 == 0, "confirmed").when(F.col("l_suppkey") % 3 == 1, "mismatch")
    name = _text("n", F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"))
    return albums.evidence(l.select(F.col("l_orderkey").alias("album"), part.alias("id"), name.alias("name"), F.when(part % 4 > 0, "").otherwise(F.col("l_linestatus")).alias("albumartist"), F.col("l_returnflag").alias("artist"), F.when(part % 3 > 0, _text("T", part % 5)).alias("title"), F.year("l_shipdate").cast("string").alias("date"), F.col("l_linestatus").alias("codec"), (F.col("l_quantity") / 4).alias("minutes"), verdict.alias("verdict")))


@query("""WITH f AS (SELECT l_orderkey AS album, l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 3 WHEN 0 THEN 'My Album ' || l_linenumber WHEN 1 THEN '01 (full album)' ELSE 'track' END AS name, CASE WHEN l_partkey % 5 = 0 THEN 'Full Album' ELSE 'Song' END AS title, CASE WHEN l_orderkey % 2 = 0 THEN 'My album' ELSE '' END AS t, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 > 0 THEN l_quantity * 30 ELSE l_quantity END AS s, l_linestatus, l_suppkey FROM lineitem),
w AS (SELECT *, sum(s) OVER (PARTITION BY album) - s AS others, count(*) OVER (PARTITION BY album) - 1 AS n FROM f)
SELECT album, id FROM w WHERE n >= 4 AND s >= 0.8 * others AND l_suppkey % 4 > 0 AND (title = 'Full Album' OR (t <> '' AND starts_with(name, 'My Album')) OR contains(name, 'full album'))""")
def whole_album_files(spark, sf):
    """FLT-13, WIN-05: by length, number of others, name and verdict."""
    l, part, n = table(spark, sf, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    order = F.col("l_orderkey")
    name = F.when(part % 3 == 0, _text("My Album ", n)).when(part % 3 == 1, "01 (full album)").otherwise("track")
    rows = l.select(order.alias("album"), (order * 10 + n).alias("id"), name.alias("name"), F.when(part % 5 == 0, "Full Album").otherwise("Song").alias("title"), F.when(order % 2 == 0, "My album").otherwise("").alias("album_title"), F.when((n == 1) & (order % 3 > 0), F.col("l_quantity") * 30).otherwise(F.col("l_quantity")).alias("seconds"), F.when(F.col("l_suppkey") % 4 == 0, "confirmed").alias("verdict"))
    return albums.whole_album_files(rows)


_GROUPS = """m AS (SELECT DISTINCT o_custkey % 30 AS g, 'd' || o_orderkey AS folder, CASE WHEN o_orderkey % 2 = 0 THEN 'keep' ELSE 'drop' END AS role, o_orderkey AS k FROM orders), a AS (SELECT 'd' || o_orderkey AS folder, o_orderkey AS album, o_orderkey % 5 = 0 AS imported, CASE WHEN o_orderkey % 7 = 0 THEN 'skip' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'auto' ELSE 'review' END AS action FROM orders WHERE o_orderkey % 11 > 0),
o AS (SELECT m.*, album, CASE WHEN album IS NULL THEN 'no match row' WHEN imported THEN 'imported' WHEN decision IS NOT NULL THEN 'decided: ' || decision WHEN action = 'review' THEN 'open' ELSE action END AS status FROM m LEFT JOIN a USING (folder)), i AS (SELECT DISTINCT g, album, l_suppkey AS item FROM o JOIN lineitem ON l_orderkey = album),
n AS (SELECT g, album, count(*) AS n FROM (SELECT g, item, min(album) AS album FROM i GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1, 2)"""


@query(f'WITH {_GROUPS} SELECT g AS "group", folder, role, status, coalesce(n, 0) AS only_here FROM o LEFT JOIN n USING (g, album)')
def groups_side_by_side(spark, sf):
    """DOM-22, SET-05, JOIN-08: duplicate groups with the status of each member and what only it has."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    members = o.select((F.col("o_custkey") % 30).alias("group"), _text("d", key).alias("folder"), F.when(key % 2 == 0, "keep").otherwise("drop").alias("role"))
    of = o.where("o_orderkey % 11 > 0").select(_text("d", key).alias("folder"), key.alias("album"), (key % 5 == 0).alias("imported"), F.when(key % 7 == 0, "skip").alias("decision"), F.when(key % 3 == 0, "auto").otherwise("review").alias("action"))
    return albums.groups_side_by_side(members, of, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("album"), F.col("l_suppkey").alias("item")))


@query("""WITH c AS (SELECT l_orderkey AS album, l_partkey % 50 AS release, min(l_discount) AS distance FROM lineitem GROUP BY 1, 2), b AS (SELECT album, min(distance) AS best FROM c GROUP BY 1), i AS (SELECT s_suppkey % 50 AS release, min(s_suppkey) AS theirs FROM supplier GROUP BY 1)
SELECT album AS ours, min(theirs) AS already FROM c JOIN b USING (album) JOIN i USING (release) WHERE distance <= best + 0.05 AND (album + theirs) % 3 > 0 GROUP BY 1""")
def already_there(spark, sf):
    """DOM-21: albums of which a near candidate is imported and shares their audio."""
    l = table(spark, sf, "lineitem")
    candidates = l.groupBy(F.col("l_orderkey").alias("album"), (F.col("l_partkey") % 50).alias("release")).agg(F.min("l_discount").alias("distance"))
    imported = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 50).alias("release")).agg(F.min("s_suppkey").alias("theirs"))
    sharing = candidates.join(imported, "release").select(F.col("album").alias("ours"), "theirs").distinct().withColumn("shares", (F.col("ours") + F.col("theirs")) % 3 > 0)
    return albums.in_library(candidates, imported, sharing)


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 10 < 5 THEN 'near_candidate' END, CASE WHEN o_orderkey % 7 = 0 THEN 'in_library' END, CASE WHEN o_orderkey % 9 = 0 THEN 'video' END, CASE WHEN o_orderkey % 4 = 0 THEN 'same_title' END], lambda x: x IS NOT NULL), '; ') AS why FROM orders""")
def no_candidate(spark, sf):
    """DOM-25, STR-05: albums that go on as they are, and why others don't."""
    key = F.col("o_orderkey")
    titles = F.when(key % 4 == 0, F.array(F.lit("the small ring and more"))).otherwise(F.array(F.lit("other")))
    return table(spark, sf, "orders").select(key.alias("id"), review.no_candidate_rule(F.when(key % 10 < 5, 0.4).otherwise(0.6), key % 7 == 0, key % 9 == 0, F.lit("the small ring"), titles).alias("why"))


@query("""SELECT c_custkey AS album FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 30 > 7)""")
def art_due(spark, sf):
    """DOM-63: albums whose pictures weren't looked for, or more than a week ago."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    checks = c.where(key % 3 > 0).select(key.alias("album"), F.when(key % 3 == 1, now - F.make_dt_interval(days=(key % 30).cast("int"))).otherwise(now).alias("checked_at"))
    return collection.art_due(c.select(key.alias("album")), checks, now)


@query("SELECT p_partkey AS album FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0")
def no_art(spark, sf):
    """DOM-69: albums without a picture in their folder: none is known, or it isn't there."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    return albums.no_art(p.select(key.alias("album"), F.when(key % 3 > 0, _text("art/", key)).alias("art")), p.where("p_partkey % 4 > 0").select(_text("art/", key).alias("path")))


@query("SELECT DISTINCT l_suppkey AS release FROM lineitem WHERE l_quantity < 0.9 * 20 AND l_suppkey % 4 > 0")
def length_queue(spark, sf):
    """DOM-71: releases of short files whose lengths aren't known."""
    l = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("decoded"), F.lit(20.0).alias("expected"), F.col("l_suppkey").alias("release"))
    return collection.length_queue(l, table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("release")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 > 0 THEN CASE WHEN l_partkey % 3 = 1 THEN l_quantity END ELSE l_tax END AS expected FROM lineitem")
def expected_lengths(spark, sf):
    """DOM-72."""
    part = F.col("l_partkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", audit.expected_length(F.when(part % 3 > 0, True), F.when(part % 3 == 1, F.col("l_quantity")), F.col("l_tax")).alias("expected"))


@query("""SELECT p_partkey AS album FROM part WHERE p_partkey % 6 = 0 OR p_partkey % 10 = 3""")
def foreign_scripts(spark, sf):
    """DOM-68, FLT-11."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    return albums.foreign_script(p.select(key.alias("album"), F.when(key % 6 == 0, "Песня").otherwise(F.col("p_name")).alias("title")), p.select(key.alias("album"), F.when(key % 10 == 3, "日本").otherwise("plain é").alias("title")))


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' ELSE 'unknown' END ELSE 'old' END AS verdict FROM customer""")
def scoped_verdicts(spark, sf):
    """DOM-02, FLT-04: verdicts below some folders made anew, the others left as they were."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.select(key.alias("id"), _text("in/", F.col("c_nationkey") % 2, "/", key).alias("path"), F.lit("old").alias("verdict"))
    fresh = lambda rows: rows.withColumn("verdict", F.when(F.col("id") % 3 == 0, "confirmed").otherwise("unknown"))
    return identity.recomputed(old, "in/0", fresh).select("id", "verdict")


@query("""WITH d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 0 ELSE c_custkey % 9 END AS changes, c_custkey % 5 = 0 AS left_before FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT CASE WHEN changes IS NULL THEN 'not_found' WHEN changes = 0 THEN 'same' WHEN left_before THEN 'left' ELSE 'changed' END AS status, count(*) AS albums FROM d GROUP BY 1""")
def proposal_states(spark, sf):
    """DOM-53: what becomes of a check: proposals that were left stay left while they are the same."""
    key = F.col("c_custkey")
    changes = F.when(key % 4 == 1, 0).when(key % 4 > 1, key % 9)
    digest = F.when(changes > 0, expr.digest16(_text("x", changes)))
    left = F.when(key % 5 == 0, expr.digest16(_text("x", F.coalesce(changes, F.lit(0)))))
    rows = table(spark, sf, "customer").where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(audit.proposal_state(changes.isNotNull(), digest, left).alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("albums"))


@query("""SELECT 'beets_missing' AS problem, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n UNION ALL SELECT 'damaged', (SELECT count(*) FROM lineitem WHERE l_quantity < 3) UNION ALL SELECT 'no_art', (SELECT count(*) FROM part WHERE p_size % 10 = 0)""")
def audit_summary(spark, sf):
    """DOM-54: the headline numbers of an audit, a row for each."""
    lines = table(spark, sf, "lineitem")
    missing = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return audit.summary({"beets_missing": missing, "damaged": lines.where("l_quantity < 3"), "no_art": table(spark, sf, "part").where("p_size % 10 = 0")})


_WANTED = """a AS (SELECT l_suppkey AS f, count(*) AS n, avg(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END) AS share, avg(l_extendedprice / 450) AS kbps FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1), h AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS p, l_suppkey % 2 = 0 AS u FROM lineitem WHERE l_quantity = 1), k AS (SELECT f, count(*) AS hurt FROM h WHERE NOT u GROUP BY 1)"""


@query(f"""WITH {_WANTED} SELECT 'low_bitrate:' || f AS key, 'low_bitrate' AS kind, CAST(round(kbps) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS of_n FROM a WHERE NOT (share > 0.5) AND kbps < 120 UNION ALL SELECT 'damaged_file:' || f || '/' || p, 'damaged_file', 1, NULL FROM h WHERE u UNION ALL SELECT 'damaged:' || f, 'damaged', hurt, a.n FROM k LEFT JOIN a USING (f)""")
def wanted_findings(spark, sf):
    """DOM-55: damaged albums and how many of their files are, damaged files by themselves, low bit rates."""
    l = table(spark, sf, "lineitem")
    folder = F.col("l_suppkey").cast("string").alias("folder")
    of = l.where("l_suppkey % 5 > 0").groupBy(folder).agg(F.count("*").alias("items"), F.avg(F.when(F.col("l_linenumber") == 1, 1.0).otherwise(0.0)).alias("lossless_share"), F.avg(F.col("l_extendedprice") / 450).alias("kbps"))
    hurt = l.where("l_quantity = 1").select(folder, _text(F.col("l_suppkey"), "/", F.col("l_partkey")).alias("path"), (F.col("l_suppkey") % 2 == 0).alias("unsorted")).distinct()
    return audit.wanted_findings(of, hurt)


@query("""WITH c AS (SELECT s_suppkey AS id, 'manual:brand ' || (s_suppkey % 25) || '|red widget' AS key, CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' ELSE 'fulfilled' END AS status FROM supplier WHERE s_suppkey <= 25), q AS (SELECT DISTINCT 'manual:brand ' || (p_partkey % 50) || '|red widget' AS key FROM part WHERE p_partkey % 7 = 0)
SELECT key, 'open' AS status FROM q UNION ALL SELECT key, CASE WHEN status = 'open' AND id % 2 = 0 THEN 'dismissed' ELSE status END FROM c WHERE key NOT IN (FROM q)""")
def wanted_by_hand(spark, sf):
    """DOM-57: entries that a user adds or dismisses."""
    s, p = F.col("s_suppkey"), F.col("p_partkey")
    asked = table(spark, sf, "part").where("p_partkey % 7 = 0").select(_text("The Brand ", p % 50).alias("artist"), F.lit("Réd-Widget!").alias("title"))
    current = table(spark, sf, "supplier").where("s_suppkey <= 25").select(s.alias("id"), _text("manual:brand ", s % 25, "|red widget").alias("key"), F.when(s % 3 == 0, "open").when(s % 3 == 1, "dismissed").otherwise("fulfilled").alias("status"))
    return albums.wanted_by_hand(asked, current, current.where("id % 2 = 0").select("id"))


@query("""WITH e AS (SELECT o_orderkey AS id, ['low_bitrate', 'manual', 'damaged', 'damaged_file'][1 + o_custkey % 4] AS kind, 'A' || (o_custkey % 9) AS name, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT id, kind, name, CAST(row_number() OVER (ORDER BY list_position(['manual', 'damaged', 'damaged_file', 'low_bitrate'], kind), name, k) AS INTEGER) AS place FROM e""")
def wanted_list(spark, sf):
    """DOM-58, SRT-06: open entries by kind, name and title; the list is what a page shows, so it is one sorted run."""
    o, kinds = table(spark, sf, "orders").where("o_orderstatus = 'P'"), ["low_bitrate", "manual", "damaged", "damaged_file"]
    rows = o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, kinds)), (1 + F.col("o_custkey") % 4).cast("int")).alias("kind"), _text("A", F.col("o_custkey") % 9).alias("name"))
    return report.placed(rows, [report.kind_order(F.col("kind"), ["manual", "damaged", "damaged_file", "low_bitrate"]), F.col("name"), F.col("id")])


@query("""SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_custkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1 AND l_returnflag = 'R')""")
def damaged_keys(spark, sf):
    """DOM-58: keys of the files of open entries."""
    entries = table(spark, sf, "lineitem").where("l_quantity = 1").groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("l_partkey").alias("files")).select(F.when(F.col("l_returnflag") == "R", "open").otherwise("dismissed").alias("status"), "files")  # an entry's files
    return albums.damaged_keys(entries, table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("key")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN [CAST(p_partkey % 1024 AS BIGINT), xor(CAST(p_partkey % 1024 AS BIGINT), CAST(2147483648 AS BIGINT))] END AS items FROM part")
def decoded_prints(spark, sf):
    """DOM-09: fingerprints of two items, made here as other programs make them; texts that aren't one give null."""
    key = F.col("p_partkey") % 1024
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(F.call_function("shiftright", key, i).bitwiseAND(1) == 1, i + 1)), lambda x: x.isNotNull())
    gaps = F.transform(bits, lambda x, i: x - F.when(i > 0, F.element_at(bits, F.greatest(i, F.lit(1)))).otherwise(0))
    steps = F.concat(gaps, F.array(F.lit(0), F.lit(32), F.lit(0)))  # the second item differs in its highest bit
    low, high = F.transform(steps, lambda s: F.least(s, F.lit(7))), F.transform(F.filter(steps, lambda s: s >= 7), lambda s: s - 7)
    binary = lambda values, width: F.array_join(F.transform(values, lambda v: F.reverse(F.lpad(F.bin(v), width, F.lit("0")))), "")
    packed = lambda text: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 8).cast("int")), lambda i: F.lpad(F.conv(F.reverse(F.rpad(F.substring(text, i * 8 + 1, F.lit(8)), 8, F.lit("0"))), 2, 16), 2, F.lit("0"))), "")
    whole = F.unhex(F.concat(F.lit("01000002"), packed(binary(low, 3)), packed(binary(high, 5))))
    text = F.when(F.col("p_partkey") % 3 > 0, F.rtrim(F.translate(F.base64(whole), "+/\r\n", "-_"), F.lit("="))).otherwise("not one!")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), similarity.decode(text).alias("items"))


@query("""WITH p AS (SELECT page_id, 'lib/' || (page_id % 7) || '/' || page_id AS path, page_id % 3 > 0 AS known, page_id % 5 > 0 AS seen FROM pages) SELECT path, CASE WHEN seen AND page_id % 7 < 3 THEN 'new' ELSE 'old' END AS state FROM p WHERE (seen AND page_id % 7 < 3) OR (known AND page_id % 7 >= 3)""")
def scanned_root(spark, sf):
    """DOM-80, SNK-02, SNK-06: a scan below one root: found files put in or over, those that are gone taken out, the rest untouched."""
    p, key = table(spark, sf, "pages"), F.col("page_id")
    path = _text("lib/", key % 7, "/", key)
    known = p.where("page_id % 3 > 0").select(path.alias("path"), F.lit("old").alias("state"))
    found = p.where("page_id % 5 > 0 and page_id % 7 < 3").select(path.alias("path"), F.lit("new").alias("state"))
    for root in ("lib/0/", "lib/1/", "lib/2/"):
        known = sources.seen_again(known, found, "path", root)
    return sources.upserted(known, found, "path")
