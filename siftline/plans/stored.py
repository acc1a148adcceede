"""Stored tables that change as a whole, bound to the test tables, with SQL that says what they hold in the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import dedupe, review
from siftline.plans.registry import query, table
from siftline.sources import files
from siftline.sources.versions import Versions
from siftline.streaming import stateful

_RESCAN = """e AS (SELECT 'u' || (user_id % 120) AS path, floor(value / 5) AS size, event_id % 7 AS mtime, event_id, CAST(floor((event_id - (SELECT min(event_id) FROM events)) * 3 / ((SELECT max(event_id) - min(event_id) + 1 FROM events))) AS BIGINT) AS run FROM events WHERE event_id % 5 = 0),
l AS (SELECT run, path, arg_max(size, event_id) AS size, arg_max(mtime, event_id) AS mtime FROM e GROUP BY 1, 2), c AS (SELECT *, lag(run) OVER w IS DISTINCT FROM run - 1 OR lag(size) OVER w IS DISTINCT FROM size OR lag(mtime) OVER w IS DISTINCT FROM mtime AS new FROM l WINDOW w AS (PARTITION BY path ORDER BY run))"""


def rescan(stored: Versions, listing: DataFrame, number: int) -> None:
    """STM-01: the stored rows after a listing (path, size, mtime, run) of everything: what is new or has changed is read again, as `scanned` tells, what is gone
    leaves, the rest stays. A number that was taken does nothing."""

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        both = new.join(old.withColumnsRenamed({"size": "old_size", "mtime": "old_mtime"}), "path", "left")
        again = F.col("scanned").isNull() | stateful.changed([F.col("old_size"), F.col("old_mtime")], [F.col("size"), F.col("mtime")])
        return both.select("path", "size", "mtime", F.when(again, F.col("run")).otherwise(F.col("scanned")).alias("scanned"))

    stored.change(listing, merged, number, whole=True)


@query(f"WITH {_RESCAN} SELECT path, max(size) FILTER (run = 2) AS size, max(mtime) FILTER (run = 2) AS mtime, max(run) FILTER (new) AS scanned FROM c GROUP BY path HAVING max(run) = 2")
def rescanned(spark, sf):
    """STM-01: three listings that a stream brings, against stored state; the second comes twice, as after a fault."""
    at, e = dedupe.shared_folder(spark, "rescan"), table(spark, sf, "events").where("event_id % 5 = 0")
    ends = table(spark, sf, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    run = F.floor((F.col("event_id") - ends["a"]) * 3 / (ends["b"] - ends["a"] + 1)).alias("run")
    rows = e.select(run, F.concat(F.lit("u"), (F.col("user_id") % 120).cast("string")).alias("path"), F.floor(F.col("value") / 5).cast("double").alias("size"), (F.col("event_id") % 7).alias("mtime"), "event_id")
    listings = rows.groupBy("run", "path").agg(F.max_by("size", "event_id").alias("size"), F.max_by("mtime", "event_id").alias("mtime"))
    stored = Versions(spark, f"{at}/table", "path", "path string, size double, mtime long, scanned long")
    for k in range(3):
        listings.where(F.col("run") == k).write.mode("append").parquet(f"{at}/in")
        stateful.rescans(spark.readStream.schema(listings.schema).parquet(f"{at}/in"), lambda frame, number: rescan(stored, frame, number), at)
        if k == 1:
            rescan(stored, listings.where("run = 1"), 1)
    return stored.read()


_JUDGED = """q AS (SELECT o_orderkey AS key, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS candidate, o_orderstatus = 'F' AS imported FROM orders), d AS (SELECT l_orderkey + CASE WHEN l_partkey % 19 = 0 THEN 1000000000 ELSE 0 END AS key, CASE l_suppkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'asis' WHEN 2 THEN 'skip' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'other' ELSE 'approve' END END AS decision, CASE WHEN l_partkey % 6 = 0 THEN 'c' || l_partkey END AS choice, CASE WHEN l_partkey % 7 > 0 THEN l_linestatus END AS reason FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_partkey % 11 = 0)),
j AS (SELECT d.key, decision, CASE WHEN choice IS NOT NULL THEN choice WHEN decision = 'approve' THEN candidate END AS choice, reason, CASE WHEN decision = 'other' THEN 'kind' WHEN q.key IS NULL THEN 'unknown' WHEN imported THEN 'imported' WHEN decision = 'approve' AND coalesce(choice, candidate) IS NULL THEN 'no_choice' WHEN reason IS NULL THEN 'no_reason' WHEN count(*) OVER (PARTITION BY d.key) > 1 THEN 'repeated' END AS fault FROM d LEFT JOIN q ON q.key = d.key)"""


def _judged(spark, sf) -> DataFrame:
    o, l, part = table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.col("l_partkey")
    queue = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("candidate"), (F.col("o_orderstatus") == "F").alias("imported"))
    odd = F.when(part % 5 == 0, "other").otherwise("approve")
    decision = F.element_at(F.array(F.lit("approve"), F.lit("asis"), F.lit("skip"), odd), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = l.where((F.col("l_linenumber") == 1) | ((F.col("l_linenumber") == 2) & (part % 11 == 0)))
    asked = rows.select((F.col("l_orderkey") + F.when(part % 19 == 0, 1000000000).otherwise(0)).alias("key"), decision.alias("decision"), F.when(part % 6 == 0, F.concat(F.lit("c"), part.cast("string"))).alias("choice"), F.when(part % 7 > 0, F.col("l_linestatus")).alias("reason"))
    return review.judged(asked, queue)


@query(f"WITH {_JUDGED} SELECT key, decision, choice, reason, fault FROM j")
def decision_faults(spark, sf):
    """DOM-28: what speaks against each decision."""
    return _judged(spark, sf)


@query(f"WITH {_JUDGED} SELECT key, decision, choice, reason FROM j WHERE fault IS NULL AND (key % 3 = 0 OR key % 3 = 1)")
def recorded_decisions(spark, sf):
    """SNK-10, DOM-28: three batches of decisions; the last has bad ones, so none of it is recorded, and one that comes twice counts once."""
    at, every = dedupe.shared_folder(spark, "decisions"), dedupe.written(_judged(spark, sf), "judged")
    for number, rows in enumerate([every.where("fault is null and key % 3 = 0"), every.where("fault is null and key % 3 = 1"), every.where("fault is null and key % 3 = 1"), every.where("key % 3 = 2 or fault is not null")]):
        try:
            files.all_or_nothing(rows, F.col("fault").isNotNull(), at, "key", min(number, 1) if number < 3 else 2)
        except ValueError:
            if number < 3:
                raise
    return Versions(spark, at, "key", every.schema).read().drop("fault")
