"""Runs as keyed state, bound to the log of events, with SQL that says what the batch forms say. The log comes to the streams in two parts, one
after the other, each stream starting anew from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe
from siftline.plans.registry import query, table
from siftline.streaming import stateful, streams

PARTS = 2


def in_parts(rows: DataFrame, order: str, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream tells of rows that come in parts, by order. made() turns the rows' stream into the stream that tells."""
    spark, at = rows.sparkSession, dedupe.shared_folder(rows.sparkSession, name)
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    number = F.least(F.lit(PARTS - 1), F.floor((F.col(order) - ends["a"]) * PARTS / (ends["b"] - ends["a"] + 1)))
    for k in range(PARTS):
        rows.where(number == k).write.mode("append").parquet(f"{at}/in")
        stateful.run_all(made(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), at)
    return stateful.told(made(spark.readStream.schema(rows.schema).parquet(f"{at}/in")), at)


def _kinds(spark, sf) -> DataFrame:
    """(run, key, value): what waits, counters and digests of each run, told apart by the key's first letter."""
    r = table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("run"), (F.col("user_id") % 60).cast("string").alias("who"), "event_type", "value")
    text = lambda mark, key: F.concat(F.lit(mark), key).alias("key")
    waiting = r.select("run", text("w", F.col("who")), F.lit("1").alias("value")).distinct()
    counts = r.groupBy("run", text("n", F.col("event_type"))).agg(F.count_if(F.col("value") > 50).cast("string").alias("value"))
    kinds = r.groupBy("run", text("d", F.col("who"))).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("value"))  # a handful of types
    return waiting.unionAll(counts).unionAll(kinds.select("run", "key", expr.digest16(F.col("value")).alias("value")))


@query("""WITH r AS (SELECT CAST(floor(event_id / 20) AS BIGINT) AS run, CAST(user_id % 60 AS VARCHAR) AS who, event_type, value FROM events),
k AS (SELECT DISTINCT run, 'w' || who AS key, '1' AS value FROM r UNION ALL SELECT run, 'n' || event_type, CAST(count(*) FILTER (value > 50) AS VARCHAR) FROM r GROUP BY 1, 2 UNION ALL SELECT run, 'd' || who, substr(sha1(string_agg(DISTINCT event_type, ',' ORDER BY event_type)), 1, 16) FROM r GROUP BY 1, 2),
o AS (SELECT k.*, p.value AS old FROM k LEFT JOIN k p ON p.key = k.key AND p.run = k.run - 1), f AS (SELECT min(run) AS run FROM k)
SELECT o.* FROM o, f WHERE CASE key[1] WHEN 'w' THEN old IS NULL AND o.run > f.run WHEN 'n' THEN CAST(value AS BIGINT) > coalesce(CAST(old AS BIGINT), 0) AND o.run > f.run ELSE old IS DISTINCT FROM value END""")
def run_news(spark, sf):
    """STM-04 to STM-06 on a stream with a value state for each key: new waiting entries, counters that grew, digests that changed; nothing is told twice."""
    rows = dedupe.written(_kinds(spark, sf), "runs")
    first = stateful.baseline(spark, dedupe.shared_folder(spark, "baseline"), rows.agg(F.min("run")).first()[0] or 0)

    def made(stream: DataFrame) -> DataFrame:
        seen, kind = stateful.before_stream(stream), F.substring("key", 1, 1)
        number = lambda c: F.when(kind == "n", F.col(c)).cast("long")
        late = F.col("run") > first
        told = F.when(kind == "w", F.col("old").isNull() & late).when(kind == "n", (number("value") > F.coalesce(number("old"), F.lit(0))) & late).otherwise(~F.col("old").eqNullSafe(F.col("value")))
        return seen.where(told)

    return in_parts(rows, "run", "news", made)


_CLAIMED = """e AS (SELECT user_id AS folder, epoch_us(ts) AS t, event_type = 'purchase' AS counts FROM events), m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w >= 36000000000 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY folder ORDER BY t)),
n AS (SELECT *, sum(f) OVER (PARTITION BY folder ORDER BY t) AS s FROM m), g AS (SELECT folder, min(t) AS first, max(t) AS last, count(*) AS changes, count(*) FILTER (counts) AS files FROM n GROUP BY folder, s)"""


@query(f"WITH {_CLAIMED} SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY first) AS batch, first, last, changes, files FROM g WHERE files > 0 AND last + 36000000000 < (SELECT max(t) FROM e)")
def claimed_stream(spark, sf):
    """STM-03, STM-02 on a stream: folders are claimed by a timer once they are quiet; a list state holds what no batch has."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("folder"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("counts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("order"))
    return in_parts(e, "order", "claims", lambda rows: stateful.claims_stream(rows, 600))


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t, bool_and(event_type <> 'error') AS busy FROM events GROUP BY 1, 2), w AS (SELECT *, count(*) FILTER (NOT busy) OVER (PARTITION BY key ORDER BY t) AS s, min(CASE WHEN NOT busy THEN t END) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM e),
g AS (SELECT key, min(t) AS since, min(until) AS until FROM w WHERE busy GROUP BY key, s) SELECT key, since, since + 10800000000 AS told FROM g, (SELECT max(t) AS now FROM e) WHERE coalesce(until, now) > since + 10800000000 AND since + 10800000000 < now""")
def held_stream(spark, sf):
    """STM-07 on a stream: a lock that is held too long is told by a timer, also if nothing is seen of it any more."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("busy"), F.unix_micros(F.col("ts").cast("timestamp")).alias("order"))
    return in_parts(e, "order", "held", stateful.held_stream)


@query("""WITH e AS (SELECT user_id AS batch, event_id AS run, event_type <> 'error' AS well FROM events), d AS (SELECT *, count(*) FILTER (well) OVER (PARTITION BY batch ORDER BY run) AS n FROM e), p AS (SELECT ['claimed', 'scanned', 'deduped', 'matched', 'imported'] AS names)
SELECT batch, run, names[n] AS was, names[n + 1] AS status FROM d, p WHERE well AND n < 5""")
def step_stream(spark, sf):
    """STM-03 on a stream: each batch's status as state; a fault leaves it where a later run takes it up again."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("run"), (F.col("event_type") != "error").alias("well"))
    return in_parts(e, "run", "steps", lambda rows: stateful.steps_stream(rows, streams.PIPELINE))
