"""The operators bound to the test tables, each with SQL that says the same. A binding is a stand-in: documents are
folders whose lines are tracks, events are a log, orders are albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import albums, audit, dedupe, identity, matching, overlap, placement, report, review, similarity
from siftline.plans import collection
from siftline.plans.registry import query, table
from siftline.sources import files
from siftline.streaming import streams

# --- inventory and reports -----------------------------------------------------------------------------


@query("""SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(DISTINCT lang) AS kinds, count(DISTINCT source) AS tops, max(n_chars) AS largest,
  count(*) FILTER (text IS NULL OR text = '') AS empty, CAST(coalesce(sum(n_chars) FILTER (lang = 'en'), 0) AS BIGINT) AS english, count(*) FILTER (n_chars >= 10000) AS long FROM documents""")
def inventory_summary(spark, sf):
    """AGG-01, AGG-02, DOM-67: one pass."""
    d = table(spark, sf, "documents")
    long = F.count_if(F.col("n_chars") >= 10000)
    return d.agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.count_distinct("lang").alias("kinds"), F.count_distinct("source").alias("tops"), F.max("n_chars").alias("largest"), F.count_if(~expr.filled(F.col("text"))).alias("empty"), F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0)).alias("english"), long.alias("long"))


@query("SELECT coalesce(lang, '?') AS codec, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def codec_rollup(spark, sf):
    """AGG-03, PRJ-09."""
    return table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("codec")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@query("""WITH x AS (SELECT l_extendedprice / 200 AS k, l_returnflag = 'R' AS l, l_linestatus = 'O' AS v FROM lineitem)
SELECT CASE WHEN l THEN 6 WHEN k >= 300 THEN 5 WHEN k >= 230 THEN 4 WHEN k >= 180 THEN 3 WHEN k >= 120 THEN 2 ELSE 1 END AS quality,
  CASE WHEN l THEN 'lossless' WHEN k >= 256 THEN '256k+' WHEN k >= 192 THEN '192k' WHEN k >= 128 THEN '128k' ELSE 'under 128k' END AS tier,
  CASE WHEN v THEN 'VBR' WHEN k >= 320 THEN '320' WHEN k >= 256 THEN '256-319' WHEN k >= 192 THEN '192-255' WHEN k >= 128 THEN '128-191' ELSE '<128' END AS bucket, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def bitrate_buckets(spark, sf):
    """PRJ-04 to PRJ-06."""
    kbps, lossless = F.col("l_extendedprice") / 200, F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").groupBy(expr.quality_tier(lossless, kbps).alias("quality"), expr.stats_tier(lossless, kbps).alias("tier"), expr.rate_bucket(F.col("l_linestatus") == "O", kbps).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS waste FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hash_groups(spark, sf):
    """AGG-04, HSH-01."""
    return dedupe.exact_groups(table(spark, sf, "documents"), F.sha2("text", 256), F.col("n_chars"))


@query("""WITH g AS (SELECT sha256(text) AS digest, count(*) AS copies, sum(n_chars) - max(n_chars) AS waste FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS groups, CAST(sum(copies) AS BIGINT) AS files, CAST(sum(copies - 1) AS BIGINT) AS extra, CAST(sum(waste) AS BIGINT) AS waste FROM g""")
def duplicate_totals(spark, sf):
    """AGG-05: an aggregate of aggregates."""
    return duplicate_hash_groups(spark, sf).agg(F.count("*").alias("groups"), F.sum("copies").alias("files"), F.sum(F.col("copies") - 1).alias("extra"), F.sum("waste").alias("waste"))


@query("""SELECT digest, copies, waste, list_sort(ids)[1:6] AS examples FROM (SELECT sha256(text) AS digest, count(*) AS copies, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS waste, list(doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1)
ORDER BY waste DESC, digest LIMIT 10""")
def duplicate_examples(spark, sf):
    """AGG-06, SRT-01, PRJ-18: the ten largest groups, with the first six of each."""
    d = table(spark, sf, "documents").withColumn("digest", F.sha2("text", 256))
    best = dedupe.exact_groups(d, F.col("digest"), F.col("n_chars")).orderBy(F.desc("waste"), "digest").limit(10)
    first = d.join(F.broadcast(best.select("digest")), "digest").withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))).where("k <= 6")
    return best.join(first.groupBy("digest").agg(F.array_sort(F.collect_list("doc_id")).alias("examples")), "digest")


@query("SELECT year(o_orderdate) AS year, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def records(spark, sf):
    """AGG-13."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.max_by(key, F.struct(price, -key)).alias("dearest"), F.min_by(key, F.struct(price, key)).alias("cheapest"))


@query("SELECT CAST(day AS DATE) AS day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total FROM (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n FROM orders GROUP BY 1)")
def growth(spark, sf):
    """WIN-03, DT-02."""
    return report.growth(table(spark, sf, "orders"), F.to_date("o_orderdate"))


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_k(spark, sf):
    """AGG-12."""
    return report.top(table(spark, sf, "part"), F.col("p_brand"), 10)


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n, max_by(year(o_orderdate), (o_totalprice, -o_orderkey)) AS year_of_dearest FROM orders GROUP BY 1")
def decades(spark, sf):
    """AGG-20, AGG-21, MTH-02."""
    year = F.year("o_orderdate")
    return table(spark, sf, "orders").groupBy((F.floor(year / 10) * 10).alias("decade")).agg(F.count("*").alias("n"), F.max_by(year, F.struct("o_totalprice", -F.col("o_orderkey"))).alias("year_of_dearest"))


@query("""WITH c AS (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)
SELECT CASE WHEN k <= 3 THEN v ELSE 'rest' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top3_rest(spark, sf):
    """AGG-20."""
    return report.top_and_rest(table(spark, sf, "part"), F.col("p_type"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def health_panel(spark, sf):
    """DOM-54, DOM-65: one row of numbers from several tables."""
    missing = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").agg(F.count("*"))
    errors = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error"))
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders")).select("open_orders", missing.scalar().alias("unlabelled"), errors.scalar().alias("errors"))


@query("SELECT source AS folder, count(*) FILTER (lang = 'en') AS audio, count(*) FILTER (lang <> 'en') AS other, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def folder_tally(spark, sf):
    """SRC-19, AGG-11."""
    d = table(spark, sf, "documents")
    return files.tally(d.select(F.col("source").alias("folder"), F.when(F.col("lang") == "en", "audio").otherwise("other").alias("kind"), F.col("n_chars").alias("size")))


# --- joins ---------------------------------------------------------------------------------------------


@query("SELECT lang, quality, count(*) AS n, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def left_lookup(spark, sf):
    """JOIN-01, JOIN-02, AGG-07."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT DISTINCT lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e USING (doc_id) WHERE l.toxic = 1 AND e.lang = d.lang AND e.source = d.source)")
def pending_lookup(spark, sf):
    """JOIN-06, SET-06, DOM-78: what hasn't been looked up, by a key of two columns."""
    known = table(spark, sf, "labels").where("toxic = 1").join(table(spark, sf, "documents"), "doc_id")
    return identity.lookup_queue(table(spark, sf, "documents"), known, ["lang", "source"])


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 0 WHERE l_orderkey IS NULL")
def anti_by_outer(spark, sf):
    """JOIN-05, as the anti-join that it is."""
    lines = table(spark, sf, "lineitem").where("l_quantity > 0")
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark, sf):
    """JOIN-07, JOIN-09."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT n_name, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def inner_chain(spark, sf):
    """JOIN-03, JOIN-04, JOIN-19: Spark decides by their sizes which sides are small enough to broadcast."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "p_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS order_key FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def array_containment(spark, sf):
    """JOIN-08, JSN-01: orders whose JSON array of parts has one of some parts."""
    arrays = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_partkey")).alias("parts"))  # an order has few lines
    wanted = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("part"))
    return arrays.select(F.col("l_orderkey").alias("order_key"), F.explode(F.from_json("parts", "array<long>")).alias("part")).join(wanted, "part", "left_semi").select("order_key").distinct()


@query("""WITH m AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM m) WHERE k = 1""")
def majority_value(spark, sf):
    """AGG-10."""
    return matching.majority(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("""WITH o AS (SELECT p_partkey AS id, p_brand || p_type || p_size AS k1, p_brand || p_size AS k2 FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey AS id, p_brand || p_type || p_size AS k1, p_brand || p_size AS k2 FROM part WHERE p_partkey % 3 <> 0),
a AS (SELECT x.id AS old_id, y.id AS new_id, 1 AS pass FROM (SELECT k1, min(id) AS id FROM o GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT k1, min(id) AS id FROM n GROUP BY 1 HAVING count(*) = 1) y USING (k1)),
b AS (SELECT x.id AS old_id, y.id AS new_id, 2 AS pass FROM (SELECT k2, min(id) AS id FROM o WHERE id NOT IN (SELECT old_id FROM a) GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT k2, min(id) AS id FROM n WHERE id NOT IN (SELECT new_id FROM a) GROUP BY 1 HAVING count(*) = 1) y USING (k2))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def unique_relink(spark, sf):
    """JOIN-16, DOM-74."""
    p = table(spark, sf, "part")
    old, new = (p.where(c).withColumnRenamed("p_partkey", name) for c, name in (("p_partkey % 3 = 0", "old_id"), ("p_partkey % 3 <> 0", "new_id")))
    k1, k2 = F.concat("p_brand", "p_type", F.col("p_size").cast("string")), F.concat("p_brand", F.col("p_size").cast("string"))
    return matching.unique_pairs(old, new, [(k1, k1), (k2, k2)])


# --- identity ------------------------------------------------------------------------------------------

_EVIDENCE = """e AS (SELECT doc_id, source, CASE WHEN doc_id % 7 > 0 THEN lang END AS tag, quality AS status, CASE WHEN quality = 1 THEN lang ELSE 'xx' END AS rec, 0.5 + 0.1 * (doc_id % 6) AS score FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, CASE WHEN status IS NULL THEN 'no_lookup' WHEN tag IS NULL THEN CASE WHEN score >= 0.8 THEN 'suggest' ELSE 'unknown' END WHEN score < 0.8 THEN 'unverifiable' WHEN rec = tag THEN 'confirmed' ELSE 'mismatch' END AS verdict FROM e)"""


def _verdicts(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("tag", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    score = F.expr("CAST(0.5 + 0.1 * (doc_id % 6) AS DOUBLE)")
    recs = F.when(F.col("quality").isNotNull(), F.array(F.struct(F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx").alias("id"), score.alias("score"))))
    return d.withColumn("verdict", identity.verdict(F.col("tag"), F.col("quality"), recs))


@query(f"WITH {_EVIDENCE} SELECT verdict, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS percent FROM v GROUP BY 1".replace("100.0 *", "100.0::DOUBLE *"))
def verdicts(spark, sf):
    """DOM-01, AGG-14."""
    out = _verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))
    total = table(spark, sf, "documents").agg(F.count("*")).scalar()
    return out.select("verdict", "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))


@query(f"""WITH {_EVIDENCE}, s AS (SELECT source, count(*) AS files, count(*) FILTER (verdict = 'mismatch') AS mismatches, count(tag) - count(DISTINCT tag) AS repeats FROM v GROUP BY 1)
SELECT * FROM s WHERE (mismatches > 0 OR repeats > 0) AND 2 * (mismatches + repeats) >= files""")
def suspect_folders(spark, sf):
    """DOM-66, AGG-08, AGG-09."""
    return identity.suspects(_verdicts(spark, sf), "source", "tag")


@query("""SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(lower(p_name), '[(\\[{].*?[)\\]}]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS name, regexp_replace(lower(p_name), '[^a-z0-9_]+', '', 'g') AS key FROM part""")
def normal_titles(spark, sf):
    """STR-01, STR-03, STR-04."""
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", "p_name", expr.norm_title(name).alias("norm"), expr.norm_name(name).alias("name"), expr.name_key(name).alias("key"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE regexp_extract(url, '^(.*/)', 1) END AS folder, CASE WHEN contains(url, '/') THEN split_part(url, '/', 1) ELSE '' END AS top, TRY_CAST(nullif(regexp_extract(list_last(string_split(url, '/')), '[0-9]+'), '') AS INTEGER) AS number, lower(regexp_extract(list_last(string_split(url, '/')), '.\\.([^.]*)$', 1)) AS ext, length(url) AS length FROM pages""")
def path_parts(spark, sf):
    """PRJ-01 to PRJ-03, PRJ-07, STR-06, SRC-02."""
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", expr.folder(url).alias("folder"), expr.top_dir(url).alias("top"), expr.first_number(url).alias("number"), expr.extension(url).alias("ext"), expr.path_order(url)["length"].cast("long").alias("length"))


@query("""SELECT doc_id, regexp_matches(text, '[\\p{Greek}\\p{Cyrillic}\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}\\p{Arabic}\\p{Hebrew}\\p{Thai}]') AS other_script, substr(sha1(text), 1, 16) AS digest, CASE WHEN lang IS NOT NULL AND lang <> '' THEN 'aid:' || lang ELSE 'sha:' || sha256(text) END AS identity FROM documents""")
def document_keys(spark, sf):
    """FLT-11, HSH-01, PRJ-08."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", expr.non_latin(text).alias("other_script"), expr.digest16(text).alias("digest"), expr.identity(F.col("lang"), F.sha2(text, 256)).alias("identity"))


@query("""WITH t AS (SELECT DISTINCT p_size AS block, left(p_name || ' ' || p_type, 4 + p_partkey % 14) AS title FROM part)
SELECT a.block, a.title AS a, b.title AS b, length(a.title) >= 8 AND contains(' ' || b.title || ' ', ' ' || a.title || ' ') AS inside FROM t a JOIN t b ON a.block = b.block AND left(a.title, 3) = left(b.title, 3) AND a.title < b.title
WHERE least(length(a.title), length(b.title)) >= 8 AND (starts_with(a.title, b.title) OR starts_with(b.title, a.title))""")
def titles_agree(spark, sf):
    """STR-02, STR-05, blocked by size and the first three letters: cut titles against whole ones."""
    t = table(spark, sf, "part").select(F.col("p_size").alias("block"), F.substring(F.concat_ws(" ", "p_name", "p_type"), F.lit(1), (4 + F.col("p_partkey") % 14).cast("int")).alias("title")).distinct().withColumn("start", F.substring("title", 1, 3))
    two = t.withColumnRenamed("title", "a").join(t.withColumnRenamed("title", "b"), ["block", "start"]).where("a < b")
    return two.where(expr.titles_agree(F.col("a"), F.col("b"))).select("block", "a", "b", expr.whole_words(F.col("b"), F.col("a")).alias("inside"))


# --- dedupe --------------------------------------------------------------------------------------------

_LINES = "k AS (SELECT DISTINCT doc_id AS s, unnest(string_split(text, chr(10))) AS key FROM documents), m AS (SELECT s, key FROM k WHERE key <> ''), z AS (SELECT s, count(*) AS n FROM m GROUP BY 1), f AS (SELECT key FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), r AS (SELECT m.* FROM m JOIN f USING (key))"
_PAIRS = _LINES + ", q AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM r x JOIN r y ON x.key = y.key AND x.s < y.s GROUP BY 1, 2), p AS (SELECT a, b, shared, u.n AS size_a, w.n AS size_b, shared / least(u.n, w.n) AS containment FROM q JOIN z u ON a = u.s JOIN z w ON b = w.s WHERE shared / least(u.n, w.n) >= 0.9)"
_CLUSTERS = _PAIRS.replace("k AS (", "RECURSIVE k AS (", 1) + ", e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), c AS (SELECT x AS node, x AS other FROM e UNION SELECT c.node, e.y FROM c JOIN e ON c.other = e.x), g AS (SELECT node, min(other) AS root FROM c GROUP BY 1)"
_COVER = _CLUSTERS + """, o AS (SELECT g.root, g.node AS s, m.key, row_number() OVER (PARTITION BY g.root, m.key ORDER BY d.n_chars DESC, d.doc_id) AS k, row_number() OVER (PARTITION BY g.root ORDER BY d.n_chars DESC, d.doc_id) AS t FROM g JOIN m ON g.node = m.s JOIN documents d ON d.doc_id = g.node),
h AS (SELECT root, s, min(t) AS t, count(*) AS size, count(*) FILTER (k = 1) AS own FROM o GROUP BY 1, 2), v AS (SELECT root, s AS set, first_value(s) OVER (PARTITION BY root ORDER BY t) AS keeper, CASE WHEN own > 0 OR row_number() OVER (PARTITION BY root ORDER BY t) = 1 THEN 'keep' ELSE 'drop' END AS role, round((size - own) / size, 3) AS coverage FROM h)"""


def _members(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("set"), F.explode(F.split("text", "\n")).alias("key"))
    return lines.where("key <> ''").distinct()


def _pairs(spark, sf):
    return dedupe.containment_pairs(_members(spark, sf))


@query(f"WITH {_PAIRS} SELECT * FROM p")
def containment_pairs(spark, sf):
    """DOM-03, JOIN-10: documents of which one holds nine tenths of the other's lines."""
    return _pairs(spark, sf)


@query(f"WITH {_CLUSTERS} SELECT * FROM g")
def duplicate_clusters(spark, sf):
    """DOM-04: connected components."""
    return dedupe.components(_pairs(spark, sf))


def _rank(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("set"), F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("earlier")).alias("rank"))


def _cover(spark, sf):
    members = dedupe.written(_members(spark, sf), "members")
    return dedupe.greedy_cover(members, dedupe.components(dedupe.containment_pairs(members)), _rank(spark, sf))


@query(f"WITH {_COVER} SELECT * FROM v")
def greedy_cover(spark, sf):
    """DOM-04, WIN-06."""
    return _cover(spark, sf)


_GROUPS = _COVER + """, u AS (SELECT v.*, n_chars, doc_id % 4 / 4 AS ok, first_value(doc_id % 4 / 4) OVER (PARTITION BY root ORDER BY (set = keeper) DESC) AS kept FROM v JOIN documents ON doc_id = set),
w AS (SELECT root, keeper, count(*) AS members, CASE WHEN bool_or(role = 'keep' AND coverage > 0) THEN 'review' ELSE 'auto' END AS action, CAST(coalesce(sum(n_chars) FILTER (role = 'drop'), 0) AS BIGINT) AS reclaimable, arg_max(set, (n_chars, -set)) FILTER (role = 'drop' AND ok > kept + 0.2) AS carry FROM u GROUP BY 1, 2)"""


def _groups(spark, sf) -> tuple[DataFrame, DataFrame]:
    cover = dedupe.written(_cover(spark, sf), "cover")
    info = table(spark, sf, "documents").select(F.col("doc_id").alias("set"), F.col("n_chars").alias("bytes"), (F.col("doc_id") % 4 / 4).alias("verified"), F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("earlier")).alias("rank"))
    return dedupe.cluster_groups(cover, info), cover


@query(f"WITH {_GROUPS} SELECT * FROM w")
def cluster_groups(spark, sf):
    """DOM-04: clusters with their keepers, and whose tags the keeper takes over."""
    return _groups(spark, sf)[0]


@query(f"""WITH {_GROUPS}, t AS (SELECT *, CASE action WHEN 'auto' THEN 1 ELSE 2 END AS tier FROM w), best AS (SELECT tier, root AS "group", reclaimable, CAST(row_number() OVER (PARTITION BY tier ORDER BY reclaimable DESC, root) AS INTEGER) AS k FROM t) SELECT best.*, v.set AS path, v.role FROM best JOIN v ON v.root = best."group" WHERE k <= 5""")
def group_examples(spark, sf):
    """DOM-08: the groups that free most, with their members."""
    groups, cover = _groups(spark, sf)
    tier = F.when(F.col("action") == "auto", 1).otherwise(2)
    return dedupe.examples(groups.select(tier.alias("tier"), F.col("root").alias("group"), "reclaimable"), cover.select(F.col("root").alias("group"), F.col("set").alias("path"), "role"))


@query(f"""WITH {_PAIRS} SELECT CASE WHEN (x.n_chars, -x.doc_id) > (y.n_chars, -y.doc_id) THEN a ELSE b END AS keeper, CASE WHEN (x.n_chars, -x.doc_id) > (y.n_chars, -y.doc_id) THEN b ELSE a END AS other,
  round(shared / CASE WHEN (x.n_chars, -x.doc_id) > (y.n_chars, -y.doc_id) THEN size_b ELSE size_a END, 3) AS coverage FROM p JOIN documents x ON a = x.doc_id JOIN documents y ON b = y.doc_id WHERE x.source <> y.source""")
def edition_pairs(spark, sf):
    """DOM-05."""
    release = table(spark, sf, "documents").select(F.col("doc_id").alias("set"), F.col("source").alias("release"))
    return dedupe.edition_pairs(_pairs(spark, sf), release, _rank(spark, sf))


@query(f"""WITH {_CLUSTERS} SELECT sha256(text) AS digest, min_by(doc_id, (n_chars, doc_id)) AS keeper, count(*) AS copies, CAST(sum(n_chars) - min_by(n_chars, (n_chars, doc_id)) AS BIGINT) AS reclaimable FROM documents LEFT JOIN g ON doc_id = node GROUP BY 1 HAVING count(*) > 1 AND NOT bool_and(node IS NOT NULL)""")
def identical_outside_clusters(spark, sf):
    """DOM-06."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("bytes"), F.struct("n_chars", "doc_id").alias("order"))
    return dedupe.identical_groups(d, dedupe.components(_pairs(spark, sf)).select(F.col("node").alias("id")))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_orderkey % 3 AS album, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber END AS number FROM lineitem WHERE l_suppkey % 10 > 0),
w AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, abs(l_quantity - first_value(l_quantity) OVER w) AS gap FROM l WINDOW w AS (PARTITION BY album, l_partkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate, l_suppkey)),
c AS (SELECT *, coalesce(min(number) OVER (PARTITION BY album, l_partkey) < max(number) OVER (PARTITION BY album, l_partkey), false) AS d FROM w WHERE place = 1 OR gap < 2)
SELECT l_orderkey, l_partkey, l_linenumber, place, gap, CASE WHEN d THEN 'review' ELSE 'auto' END AS action FROM c WHERE place > 1""")
def in_group_second_copy(spark, sf):
    """DOM-07, WIN-02, PRJ-03: without what was dropped before; differing numbers are for review."""
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_shipdate"), F.asc("l_suppkey")]
    l = table(spark, sf, "lineitem").withColumns({"album": F.col("l_orderkey") % 3, "number": F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linenumber")), "id": F.col("l_suppkey")})
    gone = table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"))
    return dedupe.second_copies(l, ["album", "l_partkey"], order, "l_quantity", 2.0, gone).select("l_orderkey", "l_partkey", "l_linenumber", "place", "gap", "action")


@query(f"""WITH {_LINES}, q AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM r x JOIN r y ON x.key = y.key AND x.s <> y.s GROUP BY 1, 2)
SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM q) WHERE k = 1""")
def best_match(spark, sf):
    """JOIN-14, JOIN-15: for each document the one that shares most lines."""
    pairs = dedupe.containment_pairs(_members(spark, sf), 0.0).select("a", "b", "shared")
    return matching.best_match(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared")), "a", "b", "shared")


# --- similarity and overlap ----------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS m, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings)
SELECT label, x.vec_id AS vec_id_1, y.vec_id AS vec_id_2, round(1 - CAST(list_sum(list_transform(list_zip(x.s, y.s), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS DOUBLE) / 64, 3) AS similarity FROM e x JOIN e y USING (label) WHERE x.vec_id < y.vec_id AND abs(x.m - y.m) <= 0.01 AND CAST(list_sum(list_transform(list_zip(x.s, y.s), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS DOUBLE) / 64 <= 0.5""")
def near_vectors(spark, sf):
    """JOIN-12, MTH-01: pairs of one label whose measures are close and whose sign bits mostly agree."""
    e = table(spark, sf, "embeddings")
    bits = lambda first: F.aggregate(F.zip_with(F.slice("embedding", first, 32), F.sequence(F.lit(0), F.lit(31)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    rows = e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("m"), bits(1).alias("low"), bits(33).alias("high"))
    wrong = F.bit_count(F.col("low_1").bitwiseXOR(F.col("low_2"))) + F.bit_count(F.col("high_1").bitwiseXOR(F.col("high_2")))
    near = similarity.near_in_range(rows, rows, ["label"], "m", 0.01).where("vec_id_1 < vec_id_2").withColumn("wrong", wrong).where("wrong <= 32")
    return near.select("label", "vec_id_1", "vec_id_2", F.round(1 - F.col("wrong") / 64, 3).alias("similarity"))


@query(f"""WITH {_PAIRS}, i AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^ \\n]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)) AS v FROM documents WHERE doc_id IN (SELECT a FROM p UNION SELECT b FROM p)),
o AS (SELECT a, b, x.v AS x, y.v AS y, unnest(range(-10, 11)) AS k FROM p JOIN i x ON a = x.doc_id JOIN i y ON b = y.doc_id),
s AS (SELECT a, b, x[greatest(1, 1 - k):] AS x, y[greatest(1, 1 + k):] AS y FROM o),
t AS (SELECT a, b, CASE WHEN least(len(x), len(y)) >= 50 THEN 1 - list_sum(list_transform(range(1, least(len(x), len(y)) + 1), lambda j: bit_count(xor(x[j], y[j])))) / (32 * least(len(x), len(y))) ELSE 0.0 END AS r FROM s)
SELECT a, b, round(max(r), 3) AS similarity FROM t GROUP BY 1, 2""")
def fingerprint_pairs(spark, sf):
    """DOM-10: similarity at the best shift, of candidates only."""
    pairs = _pairs(spark, sf).select("a", "b")
    words = F.transform(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    own = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(table(spark, sf, "documents"), "doc_id").select("doc_id", words.alias("v"))
    two = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("v").alias("x")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("v").alias("y")), "b")
    return two.select("a", "b", similarity.similarity(F.col("x"), F.col("y")).alias("similarity"))


_BATCH = "b AS (SELECT DISTINCT o_orderkey AS s, l_partkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'), l AS (SELECT DISTINCT o_orderkey AS s, l_partkey AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"
_OVERLAPS = _BATCH + """, nb AS (SELECT s, count(*) AS n FROM b GROUP BY 1), nl AS (SELECT s, count(*) AS n FROM l GROUP BY 1), q AS (SELECT b.s AS ours, l.s AS theirs, count(*) AS shared FROM b JOIN l USING (key) GROUP BY 1, 2),
o AS (SELECT ours, theirs, shared, nb.n AS size_ours, nl.n AS size_theirs, round(shared / least(nb.n, nl.n), 3) AS share, shared / least(nb.n, nl.n) >= 0.9 AS certain FROM q JOIN nb ON ours = nb.s JOIN nl ON theirs = nl.s WHERE shared / least(nb.n, nl.n) >= 0.5)"""


def _tracks(spark, sf, status: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == status).join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("set"), F.col("l_partkey").alias("key")).distinct()


def _overlaps(spark, sf) -> DataFrame:
    return overlap.overlaps(_tracks(spark, sf, "P"), _tracks(spark, sf, "F"))


@query(f"WITH {_OVERLAPS} SELECT * FROM o")
def batch_overlaps(spark, sf):
    """DOM-11: pending orders against finished ones, by their parts."""
    return _overlaps(spark, sf)


@query(f"""WITH {_OVERLAPS}, t AS (SELECT p_partkey AS key, p_size * 10.0 AS seconds, p_size % 4 * 65535 AS print FROM part), g AS (SELECT ours, theirs FROM o WHERE NOT certain),
x AS (SELECT ours, theirs, b.key FROM g JOIN b ON b.s = ours ANTI JOIN l ON l.s = theirs AND l.key = b.key), y AS (SELECT ours, theirs, l.key FROM g JOIN l ON l.s = theirs ANTI JOIN b ON b.s = ours AND b.key = l.key),
m AS (SELECT x.ours, x.theirs, count(DISTINCT x.key) AS n FROM x JOIN y ON x.ours = y.ours AND x.theirs = y.theirs JOIN t u ON u.key = x.key JOIN t v ON v.key = y.key WHERE abs(u.seconds - v.seconds) <= 10 AND 1 - bit_count(xor(u.print, v.print)) / 32 >= 0.75 GROUP BY 1, 2),
r AS (SELECT ours, theirs, shared + coalesce(n, 0) AS shared, size_ours, size_theirs FROM o LEFT JOIN m USING (ours, theirs))
SELECT ours, theirs, shared, round(shared / size_ours, 3) AS share_ours, round(shared / size_theirs, 3) AS share_theirs FROM r WHERE shared / least(size_ours, size_theirs) >= 0.9""")
def refined_overlaps(spark, sf):
    """DOM-11: where shares leave it open, other tracks are compared by length and fingerprint."""
    return _refined(spark, sf)


def _printed(spark, sf, status: str, name: str) -> DataFrame:
    """Tracks with lengths and prints. A part's row is a few bytes in its file and half a KB with its print: prints are made after the join, and
    parts are dealt by key, as Spark would judge by the file whether to send them all to every task."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size").hint("merge")
    own = {"set": F.col("set"), "key": F.col("key"), "seconds": F.col("p_size") * 10.0, "print": F.array_repeat((F.col("p_size") % 4 * 65535).cast("long"), 60)}
    return _tracks(spark, sf, status).join(part, "key").select(*(c.alias(f"{name}_{n}") for n, c in own.items()))


def _refined(spark, sf) -> DataFrame:
    return overlap.refined(_overlaps(spark, sf), _printed(spark, sf, "P", "ours"), _printed(spark, sf, "F", "theirs"), similarity.similarity(F.col("ours_print"), F.col("theirs_print")))


_SAME = """x AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority ELSE '' END AS t, o_totalprice / 100 AS s, o_orderstatus AS k FROM orders),
d AS (SELECT DISTINCT o.c AS block, o.id AS ours_item, o.id % 100 AS ours_set, p.id % 100 AS theirs_set, p.id AS theirs_item FROM x o JOIN x p ON o.c = p.c WHERE o.k = 'P' AND p.k = 'F' AND (o.id % 97 = p.id % 97 OR (o.t = p.t AND o.t <> '' AND abs(o.s - p.s) <= 3)))"""


def _same(spark, sf) -> DataFrame:
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")

    def side(name: str, status: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("block"), key.alias(f"{name}_item"), (key % 100).alias(f"{name}_set"), (key % 97).alias(f"{name}_key"), F.when(key % 10 > 0, F.col("o_orderpriority")).otherwise("").alias(f"{name}_title"), (F.col("o_totalprice") / 100).alias(f"{name}_seconds"))

    return overlap.same_recordings(side("ours", "P"), side("theirs", "F"), ["block"])


@query("""WITH x AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS k, o_totalprice / 1000 AS s, o_orderkey % 5 * 4095 AS print FROM orders)
SELECT DISTINCT o.c AS block, o.id % 100 AS ours_set, p.id % 100 AS theirs_set, o.id AS ours_item, p.id AS theirs_item FROM x o JOIN x p ON o.c = p.c WHERE o.k = 'P' AND p.k = 'F' AND (o.id % 97 = p.id % 97 OR (abs(o.s - p.s) <= 10 AND 1 - bit_count(xor(o.print, p.print)) / 32 >= 0.75))""")
def same_prints(spark, sf):
    """DOM-12, JOIN-11: the same by key, or by fingerprint with at most ten seconds between them."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")

    def side(name: str, status: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("block"), key.alias(f"{name}_item"), (key % 100).alias(f"{name}_set"), (key % 97).alias(f"{name}_key"), F.lit("").alias(f"{name}_title"), (F.col("o_totalprice") / 1000).alias(f"{name}_seconds"), F.array_repeat((key % 5 * 4095).cast("long"), 60).alias(f"{name}_print"))

    return overlap.same_recordings(side("ours", "P"), side("theirs", "F"), ["block"], similarity.similarity(F.col("ours_print"), F.col("theirs_print")))


@query(f"WITH {_SAME} SELECT * FROM d")
def same_recordings(spark, sf):
    """DOM-12, JOIN-11, JOIN-14: blocked by customer; tracks without a title are the same by key only."""
    return _same(spark, sf)


@query(f"""WITH {_SAME}, n AS (SELECT DISTINCT id % 100 AS g, count(*) FILTER (k = 'P') OVER (PARTITION BY id % 100) AS a, count(*) FILTER (k = 'F') OVER (PARTITION BY id % 100) AS b FROM x), q AS (SELECT ours_set, theirs_set, count(DISTINCT ours_item) / max(u.a) AS p, greatest(count(DISTINCT ours_item) / max(u.a), count(DISTINCT theirs_item) / max(w.b)) AS share FROM d JOIN n u ON u.g = ours_set JOIN n w ON w.g = theirs_set GROUP BY 1, 2)
SELECT ours_set, theirs_set, round(p, 3) AS covered, share >= 0.9 AS held FROM (SELECT *, row_number() OVER (PARTITION BY ours_set ORDER BY share DESC, theirs_set) AS k FROM q) WHERE k = 1""")
def same_names(spark, sf):
    """DOM-12: the best partner of the same name."""
    sizes = lambda status: table(spark, sf, "orders").where(F.col("o_orderstatus") == status).groupBy((F.col("o_orderkey") % 100).alias("set")).agg(F.count("*").alias("size"))
    return overlap.named(_same(spark, sf), sizes("P"), sizes("F"))


@query("""SELECT kind, CASE WHEN kind = 'duplicate' THEN 'skip' ELSE 'review' END AS outcome, count(*) AS n FROM (SELECT CASE WHEN l_returnflag <> l_linestatus AND l_linenumber = 1 THEN 'edition' WHEN l_quantity > 45 AND l_suppkey % 5 > 0 AND l_discount >= l_tax THEN 'upgrade' WHEN l_quantity > 45 THEN 'wanted' WHEN l_discount > l_tax THEN 'upgrade' WHEN l_quantity < 5 THEN 'extra_tracks' ELSE 'duplicate' END AS kind FROM lineitem) GROUP BY 1, 2""")
def overlap_outcomes(spark, sf):
    """DOM-13."""
    first = F.col("l_linenumber") == 1
    result, kind = overlap.outcome(F.when(first, F.col("l_returnflag")).otherwise(""), F.col("l_linestatus"), (F.col("l_quantity") > 45).cast("int"), F.col("l_suppkey") % 5 == 0, F.col("l_discount"), F.col("l_tax"), (F.col("l_quantity") < 5).cast("int"))
    return table(spark, sf, "lineitem").select(kind.alias("kind"), result.alias("outcome")).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS release, o_custkey % 40 + 12 AS tracks FROM orders), l AS (SELECT DISTINCT l_orderkey % 3000 AS release, l_orderkey AS part, l_partkey AS item FROM lineitem), p AS (SELECT release, part, count(*) AS files FROM l GROUP BY 1, 2),
g AS (SELECT release, count(*) AS parts, CAST(sum(files) AS BIGINT) AS files, max(tracks) AS tracks FROM p JOIN o USING (release) GROUP BY 1 HAVING count(*) > 1 AND sum(files) <= max(tracks) + 2),
s AS (SELECT DISTINCT release FROM (SELECT l.release, item FROM l JOIN o USING (release) GROUP BY 1, 2 HAVING count(*) > 1))
SELECT * FROM g WHERE release NOT IN (SELECT release FROM s)""")
def merge_suggestions(spark, sf):
    """DOM-30."""
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3000).alias("release"), F.col("l_orderkey").alias("part"), F.col("l_partkey").alias("item")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("release"), (F.col("o_custkey") % 40 + 12).alias("tracks"))
    parts = l.groupBy("release", "part").agg(F.count("*").alias("files")).join(o, "release")
    return matching.merge_suggestions(parts, l.select("part", "item"))


# --- logs ----------------------------------------------------------------------------------------------


def _log(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), (F.floor("value").cast("long") % 50).alias("dest"), F.col("event_type").alias("action"))


@query("""WITH l AS (SELECT event_id AS id, user_id AS source, CAST(floor(value) AS BIGINT) % 50 AS dest, event_type AS action FROM events), p AS (SELECT source, arg_max(dest, id) AS dest, arg_max(action, id) AS action, max(id) AS id FROM l WHERE action <> 'error' GROUP BY 1), g AS (SELECT dest, max(id) AS gone FROM l WHERE action = 'error' GROUP BY 1)
SELECT source, dest, action, id FROM p LEFT JOIN g USING (dest) WHERE gone IS NULL OR gone < id""")
def placement_replay(spark, sf):
    """DOM-16, WIN-04."""
    return placement.placements(_log(spark, sf), F.col("action") == "error")


_WHERE = """f AS (SELECT p_partkey AS source FROM part), g AS (SELECT event_id AS id, event_id % (SELECT max(p_partkey) FROM part) + 1 AS source, CASE event_type WHEN 'purchase' THEN 'import_album' WHEN 'error' THEN 'remove_from_library' WHEN 'signup' THEN 'skip_extra' WHEN 'click' THEN 'retag_by_fingerprint' ELSE 'note' END AS action, 'e' || event_id AS detail FROM events WHERE value > 40),
s AS (SELECT *, CASE WHEN action IN ('import_album', 'retag_by_fingerprint') THEN 'imported' WHEN action = 'skip_extra' THEN 'skipped' WHEN action = 'remove_from_library' THEN 'removed' END AS status FROM g),
m AS (SELECT p_partkey AS source, p_size < 5 AS imported, ['auto', 'unsorted', 'review'][1 + p_size % 3] AS action, CASE WHEN p_size % 7 = 0 THEN 'asis' END AS decision, p_type AS detail FROM part WHERE p_partkey % 2 = 0), c AS (SELECT p_partkey AS source, p_brand AS detail FROM part WHERE p_partkey % 5 = 0)"""


def _whereabouts(spark, sf) -> tuple:
    p, key, size = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    last, kind = p.agg(F.max("p_partkey")).scalar(), F.col("event_type")
    log = table(spark, sf, "events").where("value > 40").select(F.col("event_id").alias("id"), (F.col("event_id") % last + 1).alias("source"), F.when(kind == "purchase", "import_album").when(kind == "error", "remove_from_library").when(kind == "signup", "skip_extra").when(kind == "click", "retag_by_fingerprint").otherwise("note").alias("action"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("detail"))
    matches = p.where("p_partkey % 2 = 0").select(key.alias("source"), (size < 5).alias("imported"), F.element_at(F.array(F.lit("auto"), F.lit("unsorted"), F.lit("review")), (1 + size % 3).cast("int")).alias("action"), F.when(size % 7 == 0, "asis").alias("decision"), F.col("p_type").alias("detail"))
    return p.select(key.alias("source")), log, matches, p.where("p_partkey % 5 = 0").select(key.alias("source"), F.col("p_brand").alias("detail"))


@query(f"""WITH {_WHERE}, l AS (SELECT source, status, detail FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE status WHEN 'removed' THEN 3 WHEN 'skipped' THEN 2 ELSE 1 END DESC, id DESC) AS k FROM s WHERE status IS NOT NULL) WHERE k = 1),
r AS (SELECT source, CASE WHEN l.status IS NOT NULL THEN l.status WHEN m.imported THEN 'imported' WHEN m.action IN ('auto', 'unsorted') THEN 'pending' ELSE m.action END AS status, CASE WHEN l.status IS NOT NULL THEN l.detail ELSE m.detail END AS detail FROM f LEFT JOIN l USING (source) LEFT JOIN m USING (source))
SELECT r.source, CASE WHEN c.source IS NOT NULL AND r.status IS DISTINCT FROM 'imported' THEN 'duplicate' ELSE coalesce(status, 'unmatched') END AS status, CASE WHEN c.source IS NOT NULL AND r.status IS DISTINCT FROM 'imported' THEN c.detail ELSE r.detail END AS detail FROM r LEFT JOIN c USING (source)""")
def not_imported(spark, sf):
    """DOM-17, FLT-05: a removal counts before a skip and that before an import, and copies before all but imports."""
    return placement.whereabouts(*_whereabouts(spark, sf))


@query(f"""WITH {_WHERE}, l AS (SELECT source, arg_max(status, id) AS status, arg_max(detail, id) AS detail FROM s WHERE status IS NOT NULL GROUP BY 1), q AS (SELECT source, CASE WHEN imported THEN 'imported' WHEN decision IS NOT NULL THEN 'decided:' || decision WHEN action IN ('auto', 'unsorted') THEN 'pending' ELSE action END AS status, detail FROM m)
SELECT source, coalesce(l.status, CASE WHEN c.source IS NOT NULL THEN 'duplicate' END, q.status, 'unmatched') AS status, CASE WHEN l.status IS NOT NULL THEN l.detail WHEN c.source IS NOT NULL THEN c.detail ELSE q.detail END AS detail FROM f LEFT JOIN l USING (source) LEFT JOIN c USING (source) LEFT JOIN q USING (source)""")
def batch_manifest(spark, sf):
    """DOM-18: the same for one batch, in the order of the log."""
    return placement.manifest(*_whereabouts(spark, sf))


@query("""WITH l AS (SELECT event_id AS id, user_id AS source, CAST(floor(value) AS BIGINT) % 50 AS dest, event_type AS action FROM events), p AS (SELECT source, arg_max(dest, id) AS dest, max(id) AS id FROM l WHERE action <> 'error' GROUP BY 1), g AS (SELECT dest, max(id) AS gone FROM l WHERE action = 'error' GROUP BY 1),
w AS (SELECT source, dest AS path FROM p LEFT JOIN g USING (dest) WHERE gone IS NULL OR gone < id), r AS (SELECT user_id AS source, max(event_type) AS release FROM events WHERE value > 99 GROUP BY 1)
SELECT source AS origin, path, c_name AS key, coalesce(release, c_mktsegment) AS album FROM w JOIN customer ON c_custkey = source LEFT JOIN r USING (source)""")
def library_rows(spark, sf):
    """DOM-15: library files as their originals are, under the release that they were imported as."""
    placed = placement.placements(_log(spark, sf), F.col("action") == "error").select("source", "dest")
    files_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("album"))
    releases = table(spark, sf, "events").where("value > 99").select(F.col("event_type").alias("release"), F.array("user_id").alias("sources"))
    return placement.library_rows(placed, files_, releases)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 3 OR (o_orderkey % 10 = 7 AND o_orderkey % 4 > 0)")
def incremental_scan(spark, sf):
    """STM-01, FLT-08: what is new or changed against what is known."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    known = o.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") + 1).when(F.col("o_orderkey") % 10 != 7, F.col("o_totalprice")))
    return placement.increment(o, known, "o_orderkey", ~F.col("old_o_totalprice").eqNullSafe(F.col("o_totalprice")))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def upsert(spark, sf):
    """SNK-01 to SNK-03."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    state = lambda rows, name: rows.select("key", F.lit(name).alias("state"), "value")
    return files.upserted(state(o.where("key % 2 = 0"), "old"), state(o.where("key % 3 = 0"), "new"), "key")


@query("SELECT page_id, url FROM pages WHERE url IS NULL OR NOT starts_with(url, 'http://') OR page_id % 2 = 0")
def prune_unseen(spark, sf):
    """SNK-06, FLT-03, DOM-80."""
    p = table(spark, sf, "pages").select("page_id", "url")
    return files.seen_again(p, p.where("page_id % 2 = 0").select("page_id"), "url", "http://", "page_id")


# --- review --------------------------------------------------------------------------------------------

_KINDS = """k AS (SELECT *, CASE WHEN l_linestatus = 'X' THEN 'error' WHEN l_linenumber = 7 THEN 'dupe' WHEN l_discount * 8 < 0.1 THEN 'close' WHEN l_discount * 8 < 0.5 THEN 'weak' ELSE 'none' END AS kind FROM lineitem)"""


def _kinds(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("distance", F.col("l_discount") * 8)
    return l.withColumn("kind", review.kind(F.when(F.col("l_linestatus") == "X", "error").otherwise("review"), F.col("l_linenumber") == 7, F.col("distance")))


@query(f"WITH {_KINDS} SELECT kind, count(*) AS n, min(l_discount) AS least, max(l_discount) AS most FROM k GROUP BY 1")
def review_kinds(spark, sf):
    """FLT-07, AGG-19."""
    return _kinds(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"))


@query(f"WITH {_KINDS} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount FROM k WHERE kind = 'close' ORDER BY l_discount NULLS FIRST, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20 OFFSET 40")
def queue_page(spark, sf):
    """SRT-02: the third page of twenty."""
    keys = ["l_discount", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return review.page(_kinds(spark, sf).where("kind = 'close'"), [F.asc_nulls_first(k) for k in keys], 40, 20).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")


@query(f"WITH {_KINDS} SELECT kind, count(*) FILTER (l_returnflag = 'A') AS approve, count(*) FILTER (l_returnflag = 'N') AS skip, count(*) FILTER (l_returnflag = 'R') AS asis FROM k GROUP BY 1")
def queue_stats(spark, sf):
    """DOM-29."""
    return _kinds(spark, sf).groupBy("kind").agg(*(F.count_if(F.col("l_returnflag") == v).alias(n) for v, n in (("A", "approve"), ("N", "skip"), ("R", "asis"))))


_ALBUMS = """a AS (SELECT o_orderkey AS id, (o_orderkey % 20) / 100.0::DOUBLE AS d, (o_custkey % 10) / 20.0::DOUBLE AS gap, count(l_orderkey) AS files, count(*) FILTER (l_returnflag <> 'R') AS confirmed, count(*) FILTER (l_linenumber = 7) AS mismatch, o_custkey % 3 AS missing, o_custkey % 5 AS extra, o_orderpriority = '1-URGENT' AS structural, o_orderstatus = 'P' AS rival, o_totalprice > 400000 AS bad FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def _albums(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    of = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"), F.count_if(F.col("l_returnflag") != "R").alias("confirmed"), F.count_if(F.col("l_linenumber") == 7).alias("mismatch"))
    penalties = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("media"), F.lit("structure"), F.lit("order"))).otherwise(F.array(F.lit("media"), F.lit("year")))
    return o.join(of, "o_orderkey").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 20) / 100).alias("d"), ((F.col("o_custkey") % 10) / 20).alias("gap"), "files", "confirmed", "mismatch", (F.col("o_custkey") % 3).alias("missing"), (F.col("o_custkey") % 5).alias("extra"), penalties.alias("penalties"), (F.col("o_orderstatus") == "P").alias("rival"), (F.col("o_totalprice") > 400000).alias("bad"))


@query(f"""WITH {_ALBUMS}, c AS (SELECT *, list_filter([CASE WHEN d >= 0.1 THEN printf('distance=%.3f', d) END, CASE WHEN gap < 0.15 THEN printf('gap=%.2f', gap) END, CASE WHEN confirmed / files < 0.9 THEN printf('confirmed=%d/%d', confirmed, files) END, CASE WHEN mismatch > 1 THEN printf('mismatch=%d', mismatch) END, CASE WHEN missing > 1 THEN printf('missing=%d', missing) END, CASE WHEN extra > 2 THEN printf('extra=%d', extra) END,
  CASE WHEN structural THEN 'penalties=order,structure' END, CASE WHEN rival AND d + gap < 0.35 AND (missing > 0 OR extra > 0) THEN 'rival' END, CASE WHEN bad THEN 'bad_file' END], lambda x: x IS NOT NULL) AS why FROM a),
r AS (SELECT c.*, array_to_string(why, '; ') AS text, CASE WHEN d < 0.2 AND missing = 0 AND extra = 0 AND gap >= 0.3 AND mismatch = 0 AND NOT structural AND NOT bad THEN CASE WHEN d < 0.1 THEN 'D22' ELSE 'D26' END END AS exact FROM c),
q AS (SELECT *, CASE WHEN id % 11 = 0 THEN NULL WHEN text = '' THEN 'D21' ELSE exact END AS rule FROM r)
SELECT id, text AS why, rule, rule || printf(' distance=%.3f gap=%.2f confirmed=%d/%d missing=%d extra=%d', d, gap, confirmed, files, missing, extra) AS approval FROM q""")
def rule_checks(spark, sf):
    """DOM-23, DOM-24, DOM-26, DOM-27, SET-04."""
    c = F.col
    rival = review.rival_fits(c("d") + c("gap"), F.when(c("rival"), 0).otherwise(1), F.lit(0))
    why = review.close_rule(c("d"), c("gap"), c("confirmed"), c("files"), c("mismatch"), c("missing"), c("extra"), c("penalties"), rival, c("bad"))
    exact = review.exact_rule(c("d"), c("gap"), c("mismatch"), c("missing"), c("extra"), c("penalties"), c("bad"))
    rule = review.decision(F.lit(None).cast("string"), c("id") % 11 == 0, why, exact)
    return _albums(spark, sf).select("id", why.alias("why"), rule.alias("rule"), review.approval(rule, c("d"), c("gap"), c("confirmed"), c("files"), c("missing"), c("extra")).alias("approval"))


@query(f"""WITH {_ALBUMS} SELECT CASE WHEN d < 0.1 THEN 'close' ELSE 'weak' END AS kind, CASE WHEN d < 0.1 AND gap >= 0.15 AND NOT structural AND extra = 0 AND missing = 0 THEN 'approve' ELSE 'look' END AS suggestion, count(*) AS n FROM a GROUP BY 1, 2""")
def suggestions(spark, sf):
    """DOM-19, PRJ-13."""
    c = F.col
    kind = review.kind(F.lit("review"), F.lit(False), c("d"))
    return _albums(spark, sf).select(kind.alias("kind"), review.suggestion(kind, F.lit(2), c("gap"), c("penalties"), c("extra"), c("missing")).alias("suggestion")).groupBy("kind", "suggestion").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey * 20 AS key FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def unknown_decisions(spark, sf):
    """DOM-28, SNK-10."""
    return review.unknown_keys(table(spark, sf, "supplier").select((F.col("s_suppkey") * 20).alias("key")), table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key")


# --- audit ---------------------------------------------------------------------------------------------


@query("""SELECT key, bool_or(x = 'o') AS ordered, bool_or(x = 'l') AS delivered, bool_or(x = 'c') AS customer FROM (SELECT o_orderkey AS key, 'o' AS x FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem UNION ALL SELECT c_custkey, 'c' FROM customer) GROUP BY 1""")
def three_way_reconcile(spark, sf):
    """DOM-47."""
    keys = lambda name, col: table(spark, sf, name).select(F.col(col).alias("key"))
    return audit.presence({"ordered": keys("orders", "o_orderkey"), "delivered": keys("lineitem", "l_orderkey"), "customer": keys("customer", "c_custkey")}, "key")


@query("""WITH n AS (SELECT o_orderkey AS id, o_custkey AS size, o_totalprice AS mtime, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice + (o_orderkey % 7) * 100 END AS known FROM orders), b AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS size, o_totalprice AS mtime FROM orders WHERE o_orderkey % 3 > 0)
SELECT n.id, CASE WHEN b.id IS NULL THEN coalesce(abs(n.mtime - known) > 300, false) WHEN b.size = n.size AND b.mtime = n.mtime THEN false ELSE known IS NULL OR abs(n.mtime - known) > 5 END AS flagged FROM n LEFT JOIN b USING (id)""")
def baseline_drift(spark, sf):
    """DOM-48."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    now = o.select(key.alias("id"), F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime"), F.when(key % 5 > 0, F.col("o_totalprice") + (key % 7) * 100).alias("known_mtime"))
    base = o.where(key % 3 > 0).select(key.alias("id"), (F.col("o_custkey") + F.when(key % 6 == 0, 1).otherwise(0)).alias("size"), F.col("o_totalprice").alias("mtime"))
    return audit.drifted(now, base, "id").select("id", "flagged")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def originals(spark, sf):
    """DOM-49."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime"))
    found = o.where("id % 5 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("id") % 7 == 0, 0.5).otherwise(0.0))
    return audit.missing_or_changed(o, found, "id")


_SNAP = """b AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_nationkey END AS nation, c_mktsegment AS segment FROM customer),
d AS (SELECT id, unnest([{'field': 'name', 'before': b.name, 'after': a.name}, {'field': 'nation', 'before': CAST(b.nation AS VARCHAR), 'after': CAST(a.nation AS VARCHAR)}, {'field': 'segment', 'before': b.segment, 'after': a.segment}]) AS x FROM b JOIN a USING (id)), f AS (SELECT id, x.field AS field, x.before AS before, x.after AS after FROM d WHERE x.before IS DISTINCT FROM x.after)"""


def _differences(spark, sf):
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    a = b.withColumns({"name": F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name")), "nation": F.when(F.col("id") % 6 != 0, F.col("nation"))})
    return audit.differences(b, a, "id", ["name", "nation", "segment"])


@query(f"WITH {_SNAP} SELECT * FROM f")
def field_diff(spark, sf):
    """DOM-51."""
    return _differences(spark, sf)


@query(f"WITH {_SNAP} SELECT id, count(*) AS fields, substr(sha1(string_agg(field || '=' || coalesce(before, '') || '=' || coalesce(after, ''), ';' ORDER BY field)), 1, 16) AS digest FROM f GROUP BY 1")
def diff_digests(spark, sf):
    """DOM-52."""
    return audit.digests(_differences(spark, sf), "id")


@query(f"WITH {_SNAP} SELECT field, count(DISTINCT id) AS albums FROM f GROUP BY 1")
def changed_fields(spark, sf):
    """AGG-17, DOM-53."""
    return _differences(spark, sf).groupBy("field").agg(F.count_distinct("id").alias("albums"))


@query("""SELECT l_orderkey, l_partkey, CASE WHEN l_quantity < 0.9 * coalesce(nullif(l_suppkey % 40, 0), 30) THEN 'damaged' ELSE 'header wrong' END AS finding FROM lineitem WHERE l_quantity < 0.9 * 30""")
def decode_findings(spark, sf):
    """DOM-50, FLT-09."""
    l = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_partkey").alias("path"), F.lit(30.0).alias("expected"), (F.col("l_suppkey") % 40).cast("double").alias("mb_length"), F.col("l_quantity").alias("decoded"))
    return audit.decode_findings(l).select("path.l_orderkey", "path.l_partkey", "finding")


@query("""WITH f AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal < 3000), c AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'fulfilled' ELSE 'dismissed' END AS status FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(f.key, c.key) AS key, status, CASE WHEN f.key IS NOT NULL AND status IS NULL THEN 'insert' WHEN f.key IS NOT NULL AND status = 'fulfilled' THEN 'reopen' WHEN f.key IS NOT NULL AND status = 'open' THEN 'update' WHEN status = 'open' THEN 'fulfil' ELSE 'keep' END AS action FROM f FULL JOIN c ON f.key = c.key""")
def wanted_reconcile(spark, sf):
    """DOM-56."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    current = c.where(key % 2 == 0).select(key.alias("key"), F.when(key % 3 == 0, "open").when(key % 3 == 1, "fulfilled").otherwise("dismissed").alias("status"))
    return audit.reconciled(c.where("c_acctbal < 3000").select(key.alias("key")), current, "key")


# --- plans ---------------------------------------------------------------------------------------------


@query("""SELECT mode, count(DISTINCT id) AS albums, count(*) AS files, CAST(sum(l_quantity) AS DOUBLE) AS bytes FROM (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'apply' WHEN o_orderpriority = '2-HIGH' THEN 'asis' WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' THEN 'apply' WHEN o_orderstatus = 'O' THEN 'asis' END AS mode FROM orders WHERE o_orderkey % 6 > 0) JOIN lineitem ON id = l_orderkey WHERE mode IS NOT NULL GROUP BY 1""")
def import_plan(spark, sf):
    """DOM-35, DOM-36, JOIN-05."""
    o, p = table(spark, sf, "orders"), F.col("o_orderpriority")
    matches = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "auto").when(F.col("o_orderstatus") == "O", "unsorted").otherwise("review").alias("action"), F.when(p == "1-URGENT", "approve").when(p == "2-HIGH", "asis").when(p == "5-LOW", "skip").alias("decision"))
    own = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("size"))
    return collection.import_plan(collection.selected(matches, o.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("id"))), own)


@query("""WITH c AS (SELECT l_suppkey AS album, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'A' AS picked, l_linestatus = 'F' AS exact FROM lineitem) SELECT album, CASE WHEN bool_or(picked) THEN min(id) FILTER (picked) ELSE min(id) END AS id FROM c WHERE picked OR exact GROUP BY 1""")
def art_plan(spark, sf):
    """DOM-62."""
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("album"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linestatus") == "F", "exact").otherwise("search").alias("kind"), (F.col("l_returnflag") == "A").alias("picked"))
    return collection.art_plan(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("album")), l)


@query("""SELECT page_id, url FROM pages WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(url, '^[^/]*//[^/]*/[^/]*/') AS f FROM pages WHERE page_id % 10 = 0) WHERE f <> '' AND starts_with(url, f))""")
def under_folders(spark, sf):
    """JOIN-13, DOM-76."""
    p = table(spark, sf, "pages").select("page_id", "url")
    top = p.where("page_id % 10 = 0").select(F.regexp_extract("url", "^[^/]*//[^/]*/[^/]*/", 0).alias("folder")).where("folder <> ''").distinct()
    return collection.under(p.withColumnRenamed("url", "path"), top).withColumnRenamed("path", "url")


# --- streams -------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w <= ts - INTERVAL 600 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY user_id, s""")
def quiet_sessions(spark, sf):
    """STM-02."""
    return streams.quiet_sessions(table(spark, sf, "events"), "user_id", "ts", 600).drop("session")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
def settled(spark, sf):
    """STM-02, AGG-16, DT-03."""
    e = table(spark, sf, "events")
    return report.newest_settled(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), F.make_dt_interval(hours=F.lit(12)))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN s ELSE CASE s WHEN 'claimed' THEN 'scanned' WHEN 'scanned' THEN 'deduped' WHEN 'deduped' THEN 'matched' WHEN 'matched' THEN 'imported' ELSE s END END AS state, count(*) AS n FROM (SELECT o_orderkey, ['claimed', 'scanned', 'deduped', 'matched', 'imported'][1 + o_custkey % 5] AS s FROM orders) GROUP BY 1")
def next_states(spark, sf):
    """STM-03."""
    state = F.element_at(F.array(*map(F.lit, ["claimed", "scanned", "deduped", "matched", "imported"])), (1 + F.col("o_custkey") % 5).cast("int"))
    return table(spark, sf, "orders").groupBy(streams.next_state(state, F.col("o_orderkey") % 4 != 0).alias("state")).agg(F.count("*").alias("n"))


# --- albums --------------------------------------------------------------------------------------------


def _lines(spark, sf):
    return table(spark, sf, "lineitem").withColumns({"album": F.col("l_orderkey"), "item": F.col("l_partkey")})


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS album, l_suppkey AS item FROM lineitem), p AS (SELECT o_orderkey AS ours, o_orderkey + 1 AS theirs FROM orders WHERE o_orderkey % 2 = 0), z AS (SELECT album, count(*) AS n FROM i GROUP BY 1), c AS (SELECT ours, theirs, count(*) AS n FROM p JOIN i x ON x.album = ours JOIN i y ON y.album = theirs AND x.item = y.item GROUP BY 1, 2)
SELECT ours, theirs, CASE WHEN u.n IS NULL OR w.n IS NULL THEN true ELSE coalesce(c.n, 0) >= 0.5 * u.n END AS shares FROM p LEFT JOIN z u ON u.album = ours LEFT JOIN z w ON w.album = theirs LEFT JOIN c USING (ours, theirs)""")
def shared_audio(spark, sf):
    """JOIN-20, DOM-21."""
    pairs = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ours"), (F.col("o_orderkey") + 1).alias("theirs"))
    return albums.shared_audio(pairs, _lines(spark, sf).select("album", F.col("l_suppkey").alias("item")))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS g, o_orderkey AS album, l_suppkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), a AS (SELECT g, item, min(album) AS album FROM m GROUP BY 1, 2 HAVING count(*) = 1)
SELECT g AS "group", album, count(*) AS only_here FROM a GROUP BY 1, 2""")
def only_here(spark, sf):
    """SET-05, DOM-22."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("album"), F.col("o_custkey").alias("group"))
    return albums.only_here(_lines(spark, sf).select("album", F.col("l_suppkey").alias("item")).join(o, "album").select("group", "album", "item"))


@query("""SELECT o_orderkey AS album, o_custkey % 8 - count(*) AS missing, o_custkey % 4 - count(DISTINCT l_returnflag) AS missing_discs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey HAVING count(*) < o_custkey % 8 OR count(DISTINCT l_returnflag) < o_custkey % 4""")
def incomplete_albums(spark, sf):
    """FLT-15."""
    of = table(spark, sf, "orders").select(F.col("o_orderkey").alias("album"), (F.col("o_custkey") % 8).alias("tracks"), (F.col("o_custkey") % 4).alias("discs"))
    return albums.incomplete(of, _lines(spark, sf).select("album", F.col("l_returnflag").alias("disc")))


@query("SELECT count(DISTINCT regexp_extract(url, '^(.*/)', 1)) AS folders, count(*) AS files FROM pages")
def unsorted_counts(spark, sf):
    """DOM-70."""
    return albums.unsorted_counts(table(spark, sf, "pages"), expr.folder(F.col("url")))


@query("""SELECT c_custkey AS album, CASE WHEN c_custkey % 3 = 0 THEN 'never checked' WHEN c_custkey % 3 = 1 THEN 'nothing proposed' ELSE 'left' END AS result FROM customer WHERE c_custkey % 2 = 0""")
def leave_proposals(spark, sf):
    """DOM-73."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    proposals = c.where(key % 3 > 0).select(key.alias("album"), F.when(key % 3 == 1, "same").otherwise("changed").alias("status"))
    return albums.left_or_skipped(c.where(key % 2 == 0).select(key.alias("album")), proposals)


@query("""SELECT DISTINCT source AS folder, CASE WHEN source IN ('src1', 'src2') THEN 'imported' ELSE 'waiting' END AS state FROM documents""")
def inbox_listing(spark, sf):
    """DOM-75."""
    d = table(spark, sf, "documents").select(F.col("source").alias("folder")).distinct()
    return albums.inbox(d, d.where(F.col("folder").isin("src1", "src2")).withColumn("status", F.lit("imported")))


@query("""WITH l AS (SELECT p_partkey AS album, 'brand ' || p_brand || ' ' || (p_partkey % 300) AS a FROM part), w AS (SELECT c_custkey AS key, 'brand Brand#' || (c_custkey % 25 + 1) || ' ' || (c_custkey % 300) AS a FROM customer), h AS (SELECT p_partkey AS album, p_partkey - 1 AS key FROM part)
SELECT key, min(album) AS album FROM w JOIN l ON lower(replace(w.a, '#', ' ')) = lower(replace(l.a, '#', ' ')) WHERE (key, album) NOT IN (SELECT (key, album) FROM h) GROUP BY 1""")
def wanted_arrivals(spark, sf):
    """DOM-57, STR-03: names are matched without case, accents and marks; what a user had when adding an entry isn't an arrival."""
    p, c = F.col("p_partkey"), F.col("c_custkey")
    lib = table(spark, sf, "part").select(p.alias("album"), F.concat(F.lit("The Bränd "), F.col("p_brand"), F.lit(" "), (p % 300).cast("string")).alias("artist"), F.lit("Red Widget").alias("title"))
    want = table(spark, sf, "customer").select(c.alias("key"), F.concat(F.lit("BRAND Brand "), (c % 25 + 1).cast("string"), F.lit(" "), (c % 300).cast("string")).alias("artist"), F.lit("réd-widget").alias("title"))
    return albums.arrivals(want, lib, table(spark, sf, "part").select((p - 1).alias("key"), p.alias("album")))
