"""What a run tells, in batches and on streams, with SQL that says the same. Runs are numbers without gaps: slices of the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe
from siftline.plans.registry import query, table
from siftline.streaming import streams

_TOLD = "SELECT event_id, user_id, event_type, CASE WHEN m IS NULL THEN 'new' ELSE 'grew' END AS news FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS m FROM events) WHERE m IS NULL OR value > m"


@query(_TOLD)
def told_once(spark, sf):
    """STM-05: counters that grew since they were told."""
    return streams.told_once(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", F.col("value")).select("event_id", "user_id", "event_type", "news")


def _runs(spark, sf):
    return table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("run"), (F.col("user_id") % 60).alias("key"), "event_type", "value")


_RUNS = "r AS (SELECT CAST(floor(event_id / 20) AS BIGINT) AS run, user_id % 60 AS key, event_type, value FROM events)"


@query(f"""WITH {_RUNS}, k AS (SELECT DISTINCT run, key FROM r) SELECT run, key FROM k WHERE run > (SELECT min(run) FROM k) AND NOT EXISTS (SELECT 1 FROM k p WHERE p.key = k.key AND p.run = k.run - 1)""")
def new_keys(spark, sf):
    """STM-04: what waits now and didn't in the run before."""
    return streams.new_keys(_runs(spark, sf), "run", "key")


@query(f"""WITH {_RUNS}, k AS (SELECT run, event_type AS key, count(*) FILTER (value > 50) AS n FROM r GROUP BY 1, 2)
SELECT k.run, k.key, k.n, k.n - coalesce(p.n, 0) AS "by" FROM k LEFT JOIN k p ON p.key = k.key AND p.run = k.run - 1 WHERE k.n > coalesce(p.n, 0) AND k.run > (SELECT min(run) FROM k)""")
def grown_counters(spark, sf):
    """STM-05, STM-07: problems that grew from run to run."""
    counts = _runs(spark, sf).groupBy("run", F.col("event_type").alias("key")).agg(F.count_if(F.col("value") > 50).alias("n"))
    return streams.grown(counts, "run", "key", "n")


@query(f"""WITH {_RUNS}, k AS (SELECT run, key, substr(sha1(string_agg(DISTINCT event_type, ',' ORDER BY event_type)), 1, 16) AS digest FROM r GROUP BY 1, 2)
SELECT k.run, k.key, k.digest FROM k LEFT JOIN k p ON p.key = k.key AND p.run = k.run - 1 WHERE p.digest IS DISTINCT FROM k.digest""")
def changed_proposals(spark, sf):
    """STM-06: proposals that are new or that changed since they were told."""
    kinds = _runs(spark, sf).groupBy("run", "key").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))  # a handful of types
    return streams.changed(kinds.select("run", "key", expr.digest16(F.col("kinds")).alias("digest")), "run", "key", "digest")


@query("""WITH e AS (SELECT user_id, ts, event_type <> 'error' AS busy, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT user_id, ts, max(event_type = 'error') AS x, CASE WHEN max(event_type = 'error') THEN 'error' ELSE '' END AS event_type FROM events GROUP BY 1, 2)),
s AS (SELECT *, min(ts) OVER (PARTITION BY user_id, g) AS since FROM e WHERE busy)
SELECT user_id, min(ts) AS told, min(since) AS since FROM s WHERE ts - INTERVAL 3 HOUR >= since GROUP BY user_id, g""")
def stuck_runs(spark, sf):
    """STM-07: a lock that is held too long, told once for each time that it is held."""
    times = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max(F.col("event_type") == "error").alias("free"))
    return streams.stuck(times, "user_id", "ts", ~F.col("free"))


@query(f"""WITH {_RUNS}, k AS (SELECT DISTINCT run, event_type AS name FROM r WHERE value > 90), n AS (SELECT run, list(name ORDER BY name) AS v FROM k GROUP BY 1)
SELECT run, CASE WHEN len(v) = 1 THEN '1 entry' ELSE len(v) || ' entries' END AS title, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' and ' || (len(v) - 3) || ' more' ELSE '' END AS body FROM n""")
def messages(spark, sf):
    """STM-11, STR-07: one message for each run, with how many entries were settled and the first of their names."""
    settled = _runs(spark, sf).where("value > 90").groupBy("run").agg(F.array_sort(F.collect_set("event_type")).alias("v"))  # a handful of types
    return settled.select("run", expr.number_files(F.size("v"), "entry", "entries").alias("title"), expr.names_list(F.col("v")).alias("body"))


@query("""SELECT o_orderkey AS batch, ['claimed', 'scanned', 'deduped', 'matched', 'imported'][1 + o_custkey % 5] AS status, ['scanned', 'deduped', 'matched', 'imported'][1 + o_custkey % 5] AS step FROM orders WHERE o_custkey % 5 < 4""")
def resumed_batches(spark, sf):
    """STM-03: what a run takes up again, and where."""
    state = F.element_at(F.array(*map(F.lit, streams.PIPELINE)), (1 + F.col("o_custkey") % 5).cast("int"))
    return streams.resumable(table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch"), state.alias("status")))


@query("""SELECT 'u' || user_id AS folder, max(ts) AS last, count(*) FILTER (event_type = 'purchase') AS audio FROM events GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 90 MINUTE AND count(*) FILTER (event_type = 'purchase') > 0""")
def claimed_folders(spark, sf):
    """STM-03, STM-02: folders that are quiet."""
    e = table(spark, sf, "events")
    folders = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("folder")).agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "purchase").alias("audio"))
    return streams.claimable(folders, e.agg(F.max("ts")).scalar(), 90)


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w <= ts - INTERVAL 600 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, max(ts) + INTERVAL 600 MINUTE > (SELECT max(ts) FROM events) AS open FROM n GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    """STM-02 on a stream, all that is there: the sessions that it ended, and beside them, from the events since, those that are still open."""
    at = dedupe.shared_folder(spark, "sessions")
    ended = streams.stream_sessions(streams.read_stream(spark, sf, "events.parquet"), "user_id", "ts", 600)
    ended.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    kind = table(spark, sf, "events").schema["ts"].dataType
    closed = spark.read.schema(ended.schema).parquet(f"{at}/out").select("user_id", F.col("first").cast(kind), F.col("last").cast(kind), "n", F.lit(False).alias("open"))
    every = table(spark, sf, "events").select("user_id", "ts")
    done = closed.groupBy("user_id").agg(F.max("last").alias("done"))
    rest = every.join(done, "user_id", "left").where("done is null or ts > done")
    return closed.unionByName(streams.quiet_sessions(rest, "user_id", "ts", 600).drop("session").withColumn("open", F.lit(True)))


@query(f"SELECT event_id, kind, news FROM (SELECT event_id, user_id || event_type AS kind, news FROM ({_TOLD}))")
def told_stream(spark, sf):
    """STM-05 on a stream, with state for each key."""
    at = dedupe.shared_folder(spark, "told")
    rows = streams.read_stream(spark, sf, "events.parquet").select("event_id", F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("kind"), "value")
    news = streams.told_stream(rows, "kind", "event_id", "value")
    news.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(news.schema).parquet(f"{at}/out")
