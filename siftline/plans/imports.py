"""Batches on their way into the library, bound to the test tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import albums, dedupe, matching, overlap
from siftline.plans import collection
from siftline.plans.registry import query, table

_PLAN = """f AS (SELECT o_orderkey AS id, 'b/' || o_orderkey || '/' AS path, o_custkey AS c, o_totalprice AS v FROM orders),
dr AS (SELECT path, 'folder' AS scope, id % 14 = 0 AS auto, 'b/' || (id + 1) || '/' AS other, 1.0 AS share FROM f WHERE id % 7 = 0), pr AS (SELECT path AS ours, 'l/' || (c % 50) || '/' AS theirs, 0.9 + (id % 10) / 100 AS share_ours FROM f WHERE id % 3 = 0 UNION ALL SELECT path, 'l/' || (c % 50 + 1) || '/', 0.95 FROM f WHERE id % 3 = 0),
sn AS (SELECT path AS ours, 'l/' || (c % 50 + 2) || '/' AS theirs, 0.5 AS covered, id % 4 = 0 AS held FROM f WHERE id % 2 = 0), fa AS (SELECT ours, theirs, CASE WHEN length(ours) % 2 = 0 THEN 'skip' ELSE 'review' END AS outcome, CASE WHEN length(ours) % 2 = 0 THEN 'duplicate' ELSE 'upgrade' END AS kind FROM (SELECT ours, theirs FROM pr UNION SELECT ours, theirs FROM sn)),
gone AS (SELECT path FROM dr WHERE auto), b AS (SELECT ours, theirs, share_ours FROM (SELECT *, row_number() OVER (PARTITION BY ours ORDER BY share_ours DESC, theirs) AS k FROM pr) WHERE k = 1 AND ours NOT IN (FROM gone)),
j1 AS (SELECT ours AS path, outcome, kind, theirs AS other, share_ours AS share FROM b JOIN fa USING (ours, theirs)), j2 AS (SELECT ours AS path, CASE WHEN held THEN outcome ELSE 'review' END AS outcome, CASE WHEN held THEN kind ELSE 'edition' END AS kind, theirs AS other, covered AS share FROM sn JOIN fa USING (ours, theirs) WHERE ours NOT IN (FROM gone) AND ours NOT IN (SELECT path FROM j1)),
files AS (SELECT path AS folder, path || 'x' AS path, c % 40 AS digest FROM f), tw AS (SELECT s_suppkey AS digest, min('l/' || s_suppkey) AS other FROM supplier GROUP BY 1)"""


@query(f"""WITH {_PLAN} SELECT path, scope, CASE WHEN auto THEN 'skip' ELSE 'review' END AS outcome, CASE WHEN auto THEN 'in_batch' ELSE 'in_batch_review' END AS kind, other, CAST(share AS DOUBLE) AS share FROM dr
UNION ALL SELECT path, 'folder', outcome, kind, other, CAST(share AS DOUBLE) FROM j1 UNION ALL SELECT path, 'folder', outcome, kind, other, share FROM j2
UNION ALL SELECT files.path, 'file', 'skip', 'identical', other, 1.0 FROM files JOIN tw USING (digest) WHERE folder NOT IN (SELECT path FROM j1 UNION SELECT path FROM j2 UNION FROM gone)
UNION ALL SELECT path, 'folder', 'flag', 'dump_overlap', 'd/' || id, 0.9 FROM f WHERE id % 5 = 0 AND path NOT IN (FROM gone)""")
def batch_plan(spark, sf):
    """DOM-14: the whole of a batch: copies inside, folders that the library holds, the same names, identical bytes, flags."""
    key, text = F.col("o_orderkey"), lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    f = table(spark, sf, "orders").select(key.alias("id"), text("b/", key, "/").alias("path"), F.col("o_custkey").alias("c"))
    i, c = F.col("id"), F.col("c") % 50
    dropped = f.where("id % 7 = 0").select("path", F.lit("folder").alias("scope"), (i % 14 == 0).alias("auto"), text("b/", i + 1, "/").alias("other"), F.lit(1.0).alias("share"))
    third, half = f.where("id % 3 = 0"), f.where("id % 2 = 0")
    pairs = third.select(F.col("path").alias("ours"), text("l/", c, "/").alias("theirs"), (0.9 + (i % 10) / 100).alias("share_ours")).unionAll(third.select("path", text("l/", c + 1, "/"), F.lit(0.95)))
    same = half.select(F.col("path").alias("ours_set"), text("l/", c + 2, "/").alias("theirs_set"), F.lit(0.5).alias("covered"), (i % 4 == 0).alias("held"))
    even = F.length("ours") % 2 == 0
    facts = pairs.select("ours", "theirs").unionAll(same.select("ours_set", "theirs_set")).select("ours", "theirs", F.when(even, "skip").otherwise("review").alias("outcome"), F.when(even, "duplicate").otherwise("upgrade").alias("kind"))
    files = f.select(F.col("path").alias("folder"), F.concat("path", F.lit("x")).alias("path"), (F.col("c") % 40).alias("digest"))
    library = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("digest"), text("l/", F.col("s_suppkey")).alias("path"))
    elsewhere = f.where("id % 5 = 0").select(F.col("path").alias("ours"), text("d/", i).alias("theirs"), F.lit(0.9).alias("share"))
    return overlap.batch_plan(dropped, pairs, same, facts, files, library, elsewhere)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'review' WHEN o_orderstatus = 'F' THEN 'auto' WHEN o_orderstatus = 'P' THEN 'unsorted' ELSE 'review' END AS action FROM orders""")
def match_actions(spark, sf):
    """DOM-34."""
    state = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), collection.match_action(state == "F", F.when(state != "P", 0.3), F.col("o_orderkey") % 9 == 0).alias("action"))


_EXTRAS = """x AS (SELECT l_orderkey AS album, l_linenumber AS id, 'Part ' || (l_partkey % 6) AS title, l_quantity AS seconds, l_suppkey % 3 AS p FROM lineitem),
e AS (SELECT album, id, min(title) AS title, min(seconds) AS seconds, min(p) AS p FROM x WHERE id > 3 GROUP BY 1, 2), t AS (SELECT album, id, min(title) AS title, min(seconds) AS seconds, min(p) AS p FROM x WHERE id <= 3 GROUP BY 1, 2)"""
_COPIES = _EXTRAS + """, c AS (SELECT e.album, e.id AS extra_id, min(t.id) AS track_id FROM e JOIN t ON e.album = t.album AND lower(e.title) = lower(t.title) WHERE CASE WHEN e.p > 0 AND t.p > 0 THEN abs(e.seconds - t.seconds) <= 10 AND e.p = t.p ELSE abs(e.seconds - t.seconds) <= 3 END GROUP BY 1, 2)"""


def _copies(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("id")).agg(F.min(F.concat(F.lit("Part "), (F.col("l_partkey") % 6).cast("string"))).alias("title"), F.min("l_quantity").alias("seconds"), F.min(F.col("l_suppkey") % 3).alias("p"))
    side = lambda rows, name: rows.select("album", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "title", "seconds", "p")))
    both = (F.col("extra_p") > 0) & (F.col("track_p") > 0)
    similar = F.when(both, F.when(F.col("extra_p") == F.col("track_p"), 1.0).otherwise(0.5))
    extras = l.where("id > 3")
    return extras, collection.copies_of_tracks(side(extras, "extra"), side(l.where("id <= 3").withColumn("title", F.upper("title")), "track"), similar)


@query(f"WITH {_COPIES} SELECT * FROM c")
def copied_extras(spark, sf):
    """DOM-37, PRJ-10: extras that repeat a track, by title, length and fingerprint."""
    return _copies(spark, sf)[1]


@query(f"""WITH {_COPIES} SELECT e.album, e.id, CASE WHEN e.id = 7 THEN 'video' WHEN seconds < 3 THEN 'damaged' WHEN seconds > 48 THEN 'whole_album' WHEN track_id IS NOT NULL THEN 'copy:' || track_id END AS reason FROM e LEFT JOIN c ON c.album = e.album AND extra_id = e.id""")
def skipped_extras(spark, sf):
    """DOM-38: the first reason that holds."""
    extras, copies = _copies(spark, sf)
    both = extras.join(copies.withColumnRenamed("extra_id", "id"), ["album", "id"], "left")
    return both.select("album", "id", collection.skip_reason(F.col("id") == 7, F.col("seconds") < 3, F.col("seconds") > 48, F.col("track_id")).alias("reason"))


@query("SELECT c_custkey AS path, c_nationkey AS keeper FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def pruned_copies(spark, sf):
    """DOM-39, JOIN-21: copies whose keeper is placed."""
    dropped = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("keeper"))
    return collection.prune_duplicates(dropped, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source"))).select("path", "keeper")


_REPAIR = """a AS (SELECT user_id % 20 AS album, CASE WHEN user_id % 20 % 3 = 0 THEN 'error' ELSE 'imported' END AS status, user_id AS source FROM (SELECT DISTINCT user_id FROM events)), g AS (SELECT event_id AS id, user_id AS source, CASE event_type WHEN 'purchase' THEN 'import_extra' WHEN 'error' THEN 'skip_extra' ELSE 'note' END AS action, 'e' || event_id AS detail FROM events WHERE event_type IN ('purchase', 'error') AND value > user_id % 100 + 10)"""


def _repair(spark, sf):
    e = table(spark, sf, "events")
    own = e.select("user_id").distinct().groupBy((F.col("user_id") % 20).alias("album")).agg(F.collect_list("user_id").alias("files"))  # an album's files
    action = F.when(F.col("event_type") == "purchase", "import_extra").otherwise("skip_extra")
    log = e.where("event_type in ('purchase', 'error') and value > user_id % 100 + 10").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), action.alias("action"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("detail"))
    return own.withColumn("status", F.when(F.col("album") % 3 == 0, "error").otherwise("imported")), log


@query(f"WITH {_REPAIR} SELECT album, source FROM a WHERE status = 'error' AND source NOT IN (SELECT source FROM g WHERE action = 'import_extra')")
def unplaced_extras(spark, sf):
    """DOM-40: files that a half-done import left behind."""
    return collection.unplaced_extras(*_repair(spark, sf))


@query(f"""WITH {_REPAIR}, l AS (SELECT source, arg_max(action, id) AS action, arg_max(detail, id) AS detail FROM g GROUP BY 1), o AS (SELECT album, a.source, action, detail FROM a JOIN l USING (source) WHERE status = 'imported')
SELECT album, source, detail AS was FROM o WHERE action = 'skip_extra' AND album IN (SELECT album FROM o WHERE action = 'import_extra') AND source % 4 > 0""")
def stale_skips(spark, sf):
    """DOM-40: skips that the present rules no longer make."""
    own, log = _repair(spark, sf)
    return collection.stale_skips(own, log, log.where("source % 4 = 0").select("source").distinct())


_PRUNE = """b AS (SELECT c_custkey AS batch, CASE WHEN c_custkey % 10 > 0 THEN 'imported' ELSE 'matched' END AS status, CASE WHEN c_custkey % 13 = 0 THEN 'left' END AS note, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 960 AS INTEGER)) + to_seconds(CAST(c_custkey % 3 AS INTEGER)) AS changed, c_custkey % 17 > 0 AS inside FROM customer),
f AS (SELECT o_custkey AS batch, 'in/' || (o_orderkey % 90) || '/' || o_orderkey AS path, 'in/' || (o_orderkey % 90) || '/' AS folder, o_orderkey AS id, o_totalprice AS v FROM orders),
p AS (SELECT path, CASE WHEN id % 11 = 1 THEN 'missing' WHEN id % 29 = 1 THEN 'unseen' WHEN id % 23 = 1 THEN 'undecoded' WHEN id % 19 = 1 THEN 'short' END AS why FROM f WHERE id % 5 > 0), k AS (SELECT path FROM f WHERE id % 15 = 0), kf AS (SELECT DISTINCT folder FROM f WHERE id % 90 < 30),
w AS (SELECT batch, f.path, CASE WHEN p.path IS NOT NULL THEN p.why WHEN f.path IN (FROM k) OR folder IN (FROM kf) THEN NULL ELSE 'not in the library' || CASE WHEN id % 2 = 0 THEN ': skip_extra' ELSE '' END END AS reason FROM f LEFT JOIN p ON p.path = f.path), h AS (SELECT batch, count(*) AS problems, arg_min(reason, path) AS reason FROM w WHERE reason IS NOT NULL GROUP BY 1),
s AS (SELECT b.*, problems, reason, CASE WHEN status <> 'imported' OR note IS NOT NULL THEN 'unsettled' WHEN datediff('second', changed, TIMESTAMP '2024-02-10 11:00:01') < 14 * 86400 THEN 'not_due' WHEN NOT inside OR problems IS NOT NULL THEN 'held' ELSE 'ready' END AS state FROM b LEFT JOIN h USING (batch))"""


@query(f"WITH {_PRUNE} SELECT batch, state, CASE WHEN state = 'held' THEN coalesce(problems, 0) END AS problems, CASE WHEN state = 'held' THEN CASE WHEN NOT inside THEN 'outside' ELSE reason END END AS reason FROM s")
def prune_plan(spark, sf):
    """DOM-61: batches that may go: settled, old enough, every file verified in the library or a skipped copy."""
    key, i = F.col("c_custkey"), F.col("id")
    batches = table(spark, sf, "customer").select(key.alias("batch"), F.when(key % 10 > 0, "imported").otherwise("matched").alias("status"), F.when(key % 13 == 0, "left").alias("note"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(key % 960).cast("int"), secs=(key % 3).cast("double"))).alias("changed"), (key % 17 > 0).alias("inside"))
    o = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.concat(F.lit("in/"), (o % 90).cast("string"), F.lit("/"), o.cast("string")).alias("path"), o.alias("id"))
    # As the audit finds them: gone, changed since, read in another state, or short.
    size, mtime, other = F.when(i % 11 != 1, i), F.lit(1.0), F.lit(2.0)
    why = collection.unverified(size, mtime, i, F.when(i % 29 == 1, other).otherwise(mtime), i, F.when(i % 23 == 1, other).otherwise(mtime), F.when(i % 19 == 1, 10.0).otherwise(100.0), F.lit(100.0), F.lit(None).cast("double"))
    placed = files.where("id % 5 > 0").select("path", why.alias("why"))
    folders = files.where("id % 90 < 30").select(expr.folder(F.col("path")).alias("folder"))
    log = files.where("id % 2 = 0").select("id", "path", F.lit("skip_extra").alias("action"))
    return collection.prunable(batches, files.select("batch", "path"), placed, files.where("id % 15 = 0").select("path"), folders, log, F.lit("2024-02-10 11:00:01").cast("timestamp"))


@query("""WITH u AS (SELECT 'in/' || (l_orderkey % 40) || '/' || l_linenumber AS path, 'lib/' || (l_suppkey % 25) || '/' AS replaced FROM lineitem), a AS (SELECT DISTINCT o_orderkey % 40 AS album FROM orders WHERE o_orderkey % 40 % 3 = 0), d AS (SELECT DISTINCT album, replaced FROM u JOIN a ON starts_with(path, 'in/' || album || '/')),
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'in/' ELSE 'old/' END || p_partkey AS source, 'lib/' || (p_partkey % 25) || '/' || p_partkey AS dest FROM part)
SELECT DISTINCT album, dest FROM d JOIN p ON starts_with(dest, replaced) WHERE NOT starts_with(source, 'in/')""")
def upgrade_removals(spark, sf):
    """DOM-60: what an approved and imported better copy replaces, but for the batch's own files."""
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    upgrades = table(spark, sf, "lineitem").select(text("in/", F.col("l_orderkey") % 40, "/", F.col("l_linenumber")).alias("path"), text("lib/", F.col("l_suppkey") % 25, "/").alias("replaced"))
    key = F.col("o_orderkey") % 40
    of = table(spark, sf, "orders").select(key.alias("album"), text("in/", key, "/").alias("folder"), F.lit("imported").alias("status"), F.when(key % 3 == 0, "approve").otherwise("skip").alias("decision")).distinct()
    p = F.col("p_partkey")
    placed = table(spark, sf, "part").select(F.concat(F.when(p % 6 == 0, "in/").otherwise("old/"), p.cast("string")).alias("source"), text("lib/", p % 25, "/", p).alias("dest"))
    return albums.upgrade_removals(upgrades, of, placed, F.lit("in/"))


@query("""WITH w AS (SELECT o_custkey AS batch, count(*) FILTER (o_orderkey % 3 > 0 AND o_orderstatus <> 'F') AS waiting FROM orders GROUP BY 1), b AS (SELECT c_custkey AS batch, ['deduped', 'matched', 'imported'][1 + c_custkey % 3] AS status FROM customer)
SELECT batch, coalesce(waiting, 0) AS waiting, CASE WHEN status <> 'deduped' AND coalesce(waiting, 0) = 0 THEN 'imported' ELSE status END AS status, status = 'imported' AND coalesce(waiting, 0) > 0 AS noted FROM b LEFT JOIN w USING (batch)""")
def settled_batches(spark, sf):
    """DOM-59."""
    o, key = table(spark, sf, "orders"), F.col("c_custkey")
    matches = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"), F.when(F.col("o_orderstatus") == "F", "skip").alias("decision"))
    state = F.element_at(F.array(F.lit("deduped"), F.lit("matched"), F.lit("imported")), (1 + key % 3).cast("int"))
    return albums.settled_batches(matches, matches.where("id % 3 = 0"), table(spark, sf, "customer").select(key.alias("batch"), state.alias("status")))


@query("SELECT c_custkey AS batch, c_name AS folder FROM customer WHERE c_custkey = 7 OR c_name = '7'")
def one_batch(spark, sf):
    """DOM-75: a batch by its id or by a folder's name."""
    return albums.batch_of(table(spark, sf, "customer").select(F.col("c_custkey").alias("batch"), F.col("c_name").alias("folder")), "7")


@query("""WITH b AS (SELECT o_orderkey AS batch, 'f' || (o_orderkey % 700) AS folder FROM orders), a AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN CAST(l_orderkey AS VARCHAR) WHEN l_partkey % 3 = 1 THEN 'f' || (l_partkey % 900) ELSE 'x' || l_partkey END AS name FROM lineitem GROUP BY 1),
m AS (SELECT name, batch FROM a JOIN b ON CAST(batch AS VARCHAR) = name UNION SELECT name, batch FROM a JOIN b ON folder = name), n AS (SELECT name, count(*) AS n, min(batch) AS batch FROM m GROUP BY 1)
SELECT name, CASE WHEN n = 1 THEN batch END AS batch, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' END AS refused FROM a LEFT JOIN n USING (name)""")
def named_batches(spark, sf):
    """DOM-75: what each name names: one batch, or why it is refused."""
    batches = table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch"), F.concat(F.lit("f"), (F.col("o_orderkey") % 700).cast("string")).alias("folder"))
    part = F.col("l_partkey")
    name = F.when(part % 3 == 0, F.col("l_orderkey").cast("string")).when(part % 3 == 1, F.concat(F.lit("f"), (part % 900).cast("string"))).otherwise(F.concat(F.lit("x"), part.cast("string")))
    return albums.named(batches, table(spark, sf, "lineitem").select(name.alias("name")).distinct())


@query("""WITH f AS (SELECT 'm/' || (l_orderkey % 300) || CASE WHEN l_orderkey % 2 = 0 THEN ' (CD' || l_linenumber || ')' ELSE '' END || '/' || l_partkey AS path, l_partkey AS p, l_orderkey AS o FROM lineitem), k AS (SELECT DISTINCT path FROM f WHERE p % 10 > 0), q AS (SELECT path, regexp_extract(path, '^(.*/)', 1) AS folder FROM k WHERE NOT starts_with(path, 'm/7/') AND NOT starts_with(path, 'm/8 (CD1)/'))
SELECT regexp_replace(folder, ' \\(CD[0-9]+\\)/$', '/') AS album, count(DISTINCT folder) AS folders, count(*) AS files, min(folder) AS key FROM q GROUP BY 1""")
def disc_albums(spark, sf):
    """SRC-15: folders of discs are one album; dropped files and folders don't count."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    disc = F.when(o % 2 == 0, F.concat(F.lit(" (CD"), F.col("l_linenumber").cast("string"), F.lit(")"))).otherwise("")
    files = dedupe.spread(table(spark, sf, "lineitem").select(F.concat(F.lit("m/"), (o % 300).cast("string"), disc, F.lit("/"), p.cast("string")).alias("path"), p.alias("p")), "path").distinct()
    folders = spark.createDataFrame([("m/7/",), ("m/8 (CD1)/",)], "folder string")
    return albums.disc_albums(files.select("path"), files.where("p % 10 = 0").select("path"), folders)


@query("""WITH a AS (SELECT o_custkey AS target, o_orderkey AS album, CASE WHEN o_orderkey % 50 = 0 THEN 'skip' END AS decision, o_custkey % 5 AS batch FROM orders), f AS (SELECT album, list(DISTINCT l_partkey) AS files FROM a JOIN lineitem ON l_orderkey = album GROUP BY 1)
SELECT target, CASE WHEN bool_or(decision IS NOT NULL) THEN 'decided' END AS refused, min(album) AS into, array_to_string(list('d' || album ORDER BY album), ',') AS folders, len(list_distinct(flatten(list(files)))) AS files FROM a JOIN f USING (album) GROUP BY 1""")
def merged_albums(spark, sf):
    """DOM-31."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    own = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("files"))  # an album's files
    rows = o.join(own, key == F.col("l_orderkey")).select(F.col("o_custkey").alias("target"), key.alias("album"), F.when(key % 50 == 0, "skip").alias("decision"), F.lit(False).alias("imported"), (F.col("o_custkey") % 5).alias("batch"), F.array(F.concat(F.lit("d"), key.cast("string"))).alias("folders"), "files")
    return matching.merged(rows).select("target", "refused", "into", F.array_join("folders", ",").alias("folders"), F.size("files").cast("long").alias("files"))


@query("""WITH v AS (SELECT l_suppkey AS folder, l_partkey % 7 AS release, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 7 > 0 GROUP BY 1, 2)
SELECT s_suppkey AS keeper, arg_min(CAST(release AS VARCHAR), (-n, CAST(release AS VARCHAR))) AS release FROM supplier JOIN v ON folder = s_suppkey % 30 WHERE s_suppkey % 4 = 0 GROUP BY 1""")
def carried_releases(spark, sf):
    """DOM-32."""
    l, key = table(spark, sf, "lineitem"), F.col("s_suppkey")
    files = l.select(F.col("l_suppkey").alias("folder"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("mismatch").alias("verdict"), F.when(F.col("l_partkey") % 7 > 0, (F.col("l_partkey") % 7).cast("string")).otherwise("").alias("release"))
    return matching.carried(table(spark, sf, "supplier").select(key.alias("keeper"), F.when(key % 4 == 0, key % 30).alias("carry")), files)


@query("""SELECT DISTINCT CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CASE WHEN l_linenumber < 4 THEN 'files' ELSE 'folders' END ELSE 'review' END AS "set", l_partkey AS path FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR l_returnflag <> 'A'""")
def dropped_sets(spark, sf):
    """DOM-33."""
    members = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") < 4, "file").otherwise("folder").alias("scope"), F.when(F.col("l_returnflag") == "A", "auto").otherwise("review").alias("action"), F.when(F.col("l_linestatus") == "F", "drop").otherwise("keep").alias("role"), F.col("l_partkey").alias("path"))
    return matching.dropped(members)


@query("""WITH t AS (SELECT p_brand AS album, p_partkey AS track, p_size % 6 AS recording, p_size % 2 AS disc, p_size % 4 AS place FROM part), i AS (SELECT p_brand AS album, p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS rt, (p_size + 1) % 6 AS recording, p_size % 2 AS disc, p_partkey % 4 AS place FROM part),
a AS (SELECT i.album, item, track FROM i JOIN t ON i.album = t.album AND rt = track), b AS (SELECT i.album, item, count(*) AS n, min(track) AS sole, min(track) FILTER (t.disc = i.disc AND t.place = i.place) AS there FROM i JOIN t ON i.album = t.album AND i.recording = t.recording WHERE item NOT IN (SELECT item FROM a) GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT album, item, CASE WHEN n = 1 THEN sole ELSE there END FROM b WHERE n = 1 OR there IS NOT NULL""")
def release_tracks(spark, sf):
    """JOIN-17: an item's track by three keys in turn."""
    p, key, size = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    tracks = p.select(F.col("p_brand").alias("album"), key.alias("track"), (size % 6).alias("recording"), (size % 2).alias("disc"), (size % 4).alias("place"))
    items = p.select(F.col("p_brand").alias("album"), key.alias("item"), F.when(key % 3 == 0, key).alias("release_track"), ((size + 1) % 6).alias("recording"), (size % 2).alias("disc"), (key % 4).alias("place"))
    return matching.release_tracks(items, tracks)


@query("""WITH o AS (SELECT p_partkey AS id, p_brand || p_type || p_size AS k FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey AS id, p_brand || p_type || p_size AS k FROM part WHERE p_partkey % 3 <> 0), p AS (SELECT k FROM (SELECT k FROM o GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT k FROM n GROUP BY 1 HAVING count(*) = 1) USING (k))
SELECT count(*) AS pairs, (SELECT count(*) FROM o) - count(*) AS old_left, (SELECT count(*) FROM n) - count(*) AS new_left FROM p""")
def unpaired_counts(spark, sf):
    """DOM-74: what a relink leaves over on either side."""
    p = table(spark, sf, "part")
    old, new = (p.where(c).withColumnRenamed("p_partkey", name) for c, name in (("p_partkey % 3 = 0", "old_id"), ("p_partkey % 3 <> 0", "new_id")))
    key = F.concat("p_brand", "p_type", F.col("p_size").cast("string"))
    return matching.unpaired(old, new, matching.unique_pairs(old, new, [(key, key)]))
