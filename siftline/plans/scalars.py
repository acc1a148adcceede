"""Expressions, orders, sets, readings and writings, each over a table, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe, identity, report
from siftline.plans.registry import query, table
from siftline.sources import files
from siftline.streaming import streams


@query("""SELECT p_partkey, lower(trim(p_name || ' ')) AS trimmed, round(p_size / nullif(p_partkey % 9, 0), 3) AS share, regexp_replace(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' [disc 2]' ELSE '' END, ' \\[[^\\]]*\\]$', '') AS plain,
  CASE WHEN p_partkey % 4 > 0 THEN p_brand || ' - ' || p_name ELSE p_name END AS label, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' (' || (p_partkey % 5 + 1) || ')' END AS free, CASE WHEN p_size = 1 THEN '1 album' ELSE p_size || ' albums' END AS albums FROM part""")
def names(spark, sf):
    """PRJ-10, PRJ-11, PRJ-15, PRJ-16, PRJ-19, STR-07."""
    key, name = F.col("p_partkey"), F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", expr.trimmed(F.concat(name, F.lit(" "))).alias("trimmed"), expr.share(F.col("p_size"), F.nullif(key % 9, F.lit(0))).alias("share"), expr.without_suffix(F.concat(name, F.when(key % 3 == 0, " [disc 2]").otherwise(""))).alias("plain"), expr.label(F.when(key % 4 > 0, F.col("p_brand")), name).alias("label"), expr.free_name(name, (key % 5).cast("int")).alias("free"), expr.number_files(F.col("p_size"), "album", "albums").alias("albums"))


@query("""WITH a AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS v FROM lineitem GROUP BY 1)
SELECT id, CASE WHEN len(v) <= 3 THEN array_to_string(v, ', ') ELSE array_to_string(v[1:3], ', ') || ' and ' || (len(v) - 3) || ' more' END AS names, v[1] AS best FROM a""")
def name_lists(spark, sf):
    """PRJ-12, PRJ-17."""
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("v"))  # a few flags
    return lists.select("id", expr.names_list(F.col("v")).alias("names"), expr.best(F.col("v")).alias("best"))


@query("""WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'in/.processed/2024-01-0' || (page_id % 9) || '/' || url ELSE url END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '/', ' - ') ELSE replace(path, '/', ' - ') END AS name FROM p WHERE url IS NOT NULL AND NOT contains(url, chr(10))""")
def unsorted_names(spark, sf):
    """PRJ-14."""
    p = table(spark, sf, "pages").where(F.col("url").isNotNull() & ~F.contains("url", F.lit("\n")))
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("in/.processed/2024-01-0"), (F.col("page_id") % 9).cast("string"), F.lit("/"), F.col("url"))).otherwise(F.col("url"))
    return p.select("page_id", expr.unsorted_name(path).alias("name"))


@query("""SELECT page_id, starts_with(url, 'http://') AS below, url IS NOT NULL AND url <> '' AS filled, contains(url, 'www') AS holds, page_id % 4 IN (1, 2) AS listed, page_id % 5 > 0 AND (page_id % 3 = 0 OR (page_id % 50) < 0.5 * (page_id % 3) * 40) AS damaged,
  CASE WHEN page_id % 2 = 0 THEN 'JPEG' WHEN page_id % 7 = 0 THEN 'GIF' ELSE 'PNG' END IN ('JPEG', 'PNG') AND least(page_id % 400, 300) >= 200 AS usable FROM pages WHERE url IS NOT NULL""")
def path_filters(spark, sf):
    """FLT-01, FLT-02, FLT-04 to FLT-06, FLT-10, FLT-14."""
    url, key = F.col("url"), F.col("page_id")
    kind = F.when(key % 2 == 0, "JPEG").when(key % 7 == 0, "GIF").otherwise("PNG")
    damaged = expr.damaged_at_import(F.when(key % 5 > 0, "bad header"), (key % 50).cast("double"), ((key % 3) * 40).cast("double"))
    return table(spark, sf, "pages").where(url.isNotNull()).select("page_id", expr.inside(url, "http:/").alias("below"), expr.filled(url).alias("filled"), F.contains(url, F.lit("www")).alias("holds"), (key % 4).isin(1, 2).alias("listed"), damaged.alias("damaged"), expr.usable_image(kind, key % 400, F.lit(300)).alias("usable"))


@query("""WITH p AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' (Instrumental)' WHEN 1 THEN ' acapella' ELSE '' END AS here, p_name || CASE p_partkey % 2 WHEN 0 THEN ' (instrumental)' ELSE '' END AS there FROM part)
SELECT p_partkey, CASE WHEN contains(lower(here), 'instrumental') <> contains(lower(there), 'instrumental') THEN 'instrumental' WHEN contains(lower(here), 'acapella') <> contains(lower(there), 'acapella') THEN 'acapella' END AS word FROM p""")
def version_words(spark, sf):
    """FLT-12."""
    key, name = F.col("p_partkey"), F.col("p_name")
    here = F.concat(name, F.when(key % 3 == 0, " (Instrumental)").when(key % 3 == 1, " acapella").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", expr.version_word(here, F.concat(name, F.when(key % 2 == 0, " (instrumental)").otherwise(""))).alias("word"))


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS a, list(l_quantity) AS q FROM lineitem GROUP BY 1), t AS (SELECT id, a, q, ['AO', 'NO', 'RF'] AS c FROM s)
SELECT id, array_to_string(list_sort(list_distinct(a || c)), ',') AS either, CAST(len(list_intersect(a, c)) AS INTEGER) AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(c, x))), ',') AS only_ours, len(list_filter(q, lambda x: x > 49)) > 0 AS any_large, len(list_filter(q, lambda x: x > 5)) = len(q) AS all_large FROM t""")
def set_operations(spark, sf):
    """SET-01 to SET-03, ARR-01."""
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("a"), F.collect_list("l_quantity").alias("q"))  # an order has few lines
    known, join = F.array(F.lit("AO"), F.lit("NO"), F.lit("RF")), lambda x: F.array_join(F.array_sort(x), ",")
    return own.select("id", join(F.array_union("a", known)).alias("either"), F.size(F.array_intersect("a", known)).alias("both"), join(F.array_except("a", known)).alias("only_ours"), F.exists("q", lambda x: x > 49).alias("any_large"), F.forall("q", lambda x: x > 5).alias("all_large"))


@query("""SELECT o_custkey AS batch, CAST(sum(n) AS BIGINT) AS files FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def files_of_albums(spark, sf):
    """AGG-15: the sum of array lengths."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("files"))  # an order has few lines
    return table(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("batch")).agg(F.sum(F.size("files")).alias("files"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS k, l_partkey AS rec, l_discount AS score FROM lineitem WHERE l_linenumber <= 6), a AS (SELECT id, k // 3 AS result, max(score) AS score FROM r GROUP BY 1, 2), x AS (SELECT r.id, rec, a.score, a.result, r.k FROM r JOIN a ON r.id = a.id AND r.k // 3 = a.result)
SELECT id, rec, max(score) AS score FROM x GROUP BY 1, 2""")
def parsed_lookups(spark, sf):
    """DOM-79, SET-07: each recording once, at the score of its best result."""
    l = table(spark, sf, "lineitem").where("l_linenumber <= 6")
    results = l.groupBy("l_orderkey", F.floor(F.col("l_linenumber") / 3).alias("result")).agg(F.max("l_discount").alias("score"), F.collect_list(F.col("l_partkey").cast("string")).alias("recordings"))  # an order has few lines
    answers = results.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("result").cast("string").alias("id"), "score", "recordings")).alias("results"))
    one = answers.select(F.col("l_orderkey").alias("id"), F.explode(identity.parsed(F.col("results"))).alias("r"))
    return one.select("id", F.col("r.id").cast("long").alias("rec"), F.col("r.score").alias("score"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 50")
def largest_first(spark, sf):
    """SRT-04, SRT-07: some keys downwards, others upwards; a slice after a total order."""
    return table(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").limit(50).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("""SELECT c_custkey AS album, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS checked FROM customer ORDER BY c_custkey % 3 > 0, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, c_custkey LIMIT 40""")
def due_slice(spark, sf):
    """SRT-05, STM-08, DOM-53: those never checked, then those checked longest ago; so many in a run."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("album"), F.when(key % 3 > 0, F.col("c_acctbal")).alias("checked"))
    return report.due(rows, "checked", "album", 40)


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 0 END, event_id) AS k FROM events) WHERE k = 1""")
def kind_order(spark, sf):
    """SRT-06: kinds in an order of their own; others come first."""
    order = report.kind_order(F.col("event_type"), ["purchase", "signup", "error"])
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct(order, F.col("event_id"))).alias("event_id"))


@query("""SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 25""")
def sample(spark, sf):
    """SRT-03: a sample that a seed repeats."""
    return report.sampled(table(spark, sf, "customer"), F.col("c_custkey").cast("string"), 7, 25).select("c_custkey")


@query("""SELECT o_orderkey, CAST((o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 60 + 0.5 AS DOUBLE) AS seconds, TIMESTAMP '2024-06-01 12:00:00' - to_days(CAST(o_orderkey % 20 AS INTEGER)) < TIMESTAMP '2024-06-01 12:00:00' - INTERVAL 7 DAY AS old FROM orders""")
def times(spark, sf):
    """DT-01, DT-04: a given present, and clock texts."""
    key, now = F.col("o_orderkey"), F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    clock = F.format_string("%d:%02d:%02d.5", key % 5, key % 60, key % 60)
    return table(spark, sf, "orders").select("o_orderkey", expr.clock_seconds(clock).alias("seconds"), (now - F.make_dt_interval(days=(key % 20).cast("int")) < now - F.make_dt_interval(days=F.lit(7))).alias("old"))


@query("SELECT doc_id, text AS decoded FROM documents WHERE text IS NOT NULL AND length(text) < 300")
def url_base64(spark, sf):
    """B64-01: there and back."""
    d = table(spark, sf, "documents").where("text is not null and length(text) < 300")
    sent = F.rtrim(F.translate(F.base64(F.encode("text", "utf-8")), "+/\r\n", "-_"), F.lit("="))
    return d.select("doc_id", F.decode(expr.from_url_base64(sent), "utf-8").alias("decoded"))


_RAW = """r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'TXXX:Artist' WHEN p_partkey % 3 = 1 THEN 'WM/Artist' ELSE 'author' END AS name, trim(p_brand || ' ') || CASE WHEN p_partkey % 4 = 0 THEN '; ' || p_type ELSE '' END AS artist, CASE p_partkey % 6 WHEN 0 THEN 'EasyMP3' WHEN 1 THEN 'OggOpus' WHEN 2 THEN 'EasyMP4' WHEN 3 THEN 'FLAC' WHEN 4 THEN 'Musepack' ELSE NULL END AS kind FROM part)"""


@query(f"""WITH {_RAW}, c AS (SELECT *, CASE kind WHEN 'EasyMP3' THEN 'mp3' WHEN 'OggOpus' THEN 'opus' WHEN 'EasyMP4' THEN CASE WHEN id % 4 = 0 THEN 'alac' ELSE 'aac' END WHEN 'FLAC' THEN 'flac' WHEN 'Musepack' THEN 'mpc' ELSE 'wma' END AS codec FROM r)
SELECT id, artist, CASE WHEN id % 5 > 0 THEN 'T' || id END AS mb_trackid, codec, codec IN ('flac', 'alac') AS lossless, nullif(concat_ws(' | ', CASE WHEN id % 7 = 0 THEN 'tags: HeaderError: ' || id END, CASE WHEN id % 11 = 0 THEN 'fingerprint: no audio' END), '') AS error, CAST(1 + CASE WHEN id % 5 > 0 THEN 1 ELSE 0 END AS INTEGER) AS names FROM c""")
def tag_fields(spark, sf):
    """SRC-04 to SRC-06, SRC-08, MAP-01: raw names of three containers, values that aren't text, pictures, and readings that failed."""
    key, text = F.col("p_partkey"), lambda x: F.encode(x, "utf-8")
    many = F.array(text(F.concat(F.col("p_brand"), F.lit(" "))), F.unhex(F.lit("FF")), *[F.when(key % 4 == 0, text(F.col("p_type"))).otherwise(text(F.lit(" ")))])
    pair = lambda name, values: F.struct(name.alias("name"), values.alias("values"))
    raw = F.array(pair(F.when(key % 3 == 0, "TXXX:Artist").when(key % 3 == 1, "WM/Artist").otherwise("author"), many), pair(F.lit("APIC:front"), F.array(text(F.lit("x")))), pair(F.lit("MusicBrainz/Track Id"), F.array(F.when(key % 5 > 0, text(F.concat(F.lit("T"), key.cast("string")))))))
    codec = files.codec(F.element_at(F.array(*(F.lit(x) for x in ("EasyMP3", "OggOpus", "EasyMP4", "FLAC", "Musepack", None))), (key % 6 + 1).cast("int")), F.when(key % 4 == 0, "alac.20").otherwise("mp4a"), F.lit("wma"))
    rows = table(spark, sf, "part").select(key.alias("id"), files.raw_tags(raw).alias("raw"), codec.alias("codec"), files.failures({"tags": F.when(key % 7 == 0, F.concat(F.lit("HeaderError: "), key.cast("string"))), "fingerprint": F.when(key % 11 == 0, "no audio")}).alias("error"))
    fields = files.tags(F.col("raw"))
    return rows.select("id", fields["artist"].alias("artist"), fields["mb_trackid"].alias("mb_trackid"), "codec", files.lossless(F.col("codec")).alias("lossless"), "error", F.size(F.map_keys("raw")).alias("names"))


@query("SELECT n_nationkey AS key, sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS size, 'other' AS kind FROM nation")
def file_hashes(spark, sf):
    """SRC-01, SRC-03, SRC-18: files that were written, found again with their sizes, kinds and digests."""
    at = dedupe.shared_folder(spark, "listing")
    table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("key")).write.partitionBy("key").text(at)
    key = F.regexp_extract("path", "key=([0-9]+)", 1).cast(table(spark, sf, "nation").schema["n_nationkey"].dataType)
    found = files.listing(spark, at).where("ext = 'txt'").select("path", "size", "kind")
    return found.join(files.hashes(spark, at), "path").select(key.alias("key"), "sha256", "size", "kind")


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_nationkey < 5 AND c_custkey % 2 = 0)
SELECT c_nationkey AS nation, c_custkey AS id, CASE WHEN c_nationkey IN (FROM s) THEN 'second' ELSE 'first' END AS run FROM customer WHERE c_nationkey NOT IN (FROM s) OR c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, c_custkey, 'appended' FROM customer WHERE c_custkey % 10 = 0""")
def stored_partitions(spark, sf):
    """SNK-04, SNK-05, SNK-07, SRC-10, SRC-11: a table written anew, some of its partitions replaced, rows appended; then scanned."""
    at = dedupe.shared_folder(spark, "stored")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    files.replace_partition(c.withColumn("run", F.lit("first")), at, "nation")
    files.replace_partition(c.where("nation < 5 and id % 2 = 0").withColumn("run", F.lit("second")), at, "nation")
    more = dedupe.shared_folder(spark, "stored")
    files.rebuild(spark.read.parquet(at).select("nation", "id", "run"), more)
    files.append(c.where("id % 10 = 0").withColumn("run", F.lit("appended")).withColumn("nation", F.col("nation").cast(spark.read.parquet(at).schema["nation"].dataType)).select("nation", "id", "run"), more)
    return files.table_scan(spark, more, f"CAST(nation AS {c.schema['nation'].dataType.simpleString()}) AS nation", "id", "run", view="stored_rows")


@query("""SELECT '{"id":' || p_partkey || ',"name":"' || p_name || '<\\/b>"}' AS line FROM part""")
def report_lines(spark, sf):
    """SNK-08, SNK-09: lines for a page, without paths."""
    at = dedupe.shared_folder(spark, "report")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("</b>")).alias("name"), F.col("p_type").alias("path"))
    files.report(rows, at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@query("""SELECT doc_id, CAST(1 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS keys, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'second' END, lang) AS lang FROM documents""")
def merged_maps(spark, sf):
    """MAP-01: keys, look-up and merge."""
    d = table(spark, sf, "documents")
    both = expr.merged_maps(F.create_map(F.lit("lang"), F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.lit("second"), F.lit("more"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    return d.select("doc_id", F.size(F.map_keys(both)).alias("keys"), F.try_element_at(both, F.lit("lang")).alias("lang"))


@query("SELECT DISTINCT p_brand AS key, upper(p_brand) || '!' AS answer FROM part")
def lookups(spark, sf):
    """SRC-12, SRC-13: a service that answers ten keys at once, in their order; a test has one that fails."""
    keys = table(spark, sf, "part").select(F.col("p_brand").alias("key")).distinct()
    return files.looked_up(keys, lambda own: [k.upper() + "!" for k in own], "string", wait=0.0, tasks=2).select("key", "answer")


@query("""SELECT '<!doctype html><meta charset=utf-8><title>Regions</title><script type=application/json id=rows>[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']</script>' AS page FROM region""")
def region_page(spark, sf):
    """SNK-09: a page with its rows inside, without paths."""
    at = dedupe.shared_folder(spark, "page")
    files.page(table(spark, sf, "region").select("r_regionkey", "r_name", F.lit("secret").alias("path")), at, "Regions")
    return spark.read.text(at, wholetext=True).select(F.rtrim(F.translate("value", "\n", "")).alias("page"))


@query("""WITH b AS (SELECT o_orderkey AS batch, o_custkey AS c, o_orderstatus AS s FROM orders), k AS (SELECT unnest(['scan', 'match', 'import']) AS step, unnest(range(1, 4)) AS n), f AS (SELECT batch, step, n, CASE WHEN n = 1 AND c % 10 = 0 THEN 'unreadable' WHEN n = 2 AND c % 3 = 0 THEN 'no match: ' || c WHEN n = 3 AND s = 'P' THEN 'held' END AS error FROM b, k)
SELECT batch, step, error FROM f WHERE n <= coalesce((SELECT min(g.n) FROM f g WHERE g.batch = f.batch AND g.error IS NOT NULL), 3)""")
def passes(spark, sf):
    """STM-10: a fault in one batch's step ends that batch's pass and leaves the others alone."""
    c = F.col("o_custkey")
    steps = {"scan": F.when(c % 10 == 0, "unreadable"), "match": F.when(c % 3 == 0, F.concat(F.lit("no match: "), c.cast("string"))), "import": F.when(F.col("o_orderstatus") == "P", "held")}
    return streams.passed(table(spark, sf, "orders"), F.col("o_orderkey").alias("batch"), steps)
