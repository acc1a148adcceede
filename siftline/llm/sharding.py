"""Shards of nearly equal size: a minimax contiguous partition of ordered groups that stay whole.

A group is all rows of equal text; rows without a text are one group. Groups stand in the order of their smallest doc_id (a group
without any comes first), ties by the text's digest. A shard is a run of groups. The smallest capacity that lets the given number of shards
hold them all is found by binary search; each candidate is checked greedily, a shard taking groups until the next doesn't fit. HALVINGS
halvings are decided by one pass. Then shards are cut: each ends at the group nearest to an even share of what is left, but no
later than the capacity allows, and no earlier than the shards after it can take the rest. So no shard is larger than
the capacity, and none stays empty because those before it were filled up.

Everything runs as DataFrame expressions. Groups lie in ranges of their order, with their running totals there; the driver keeps one
number for each range, and a check reads only the ranges that its cuts fall into. A row's slot is its place in the order of all rows, from
one range exchange, less the first place of its shard; copies are told apart by doc_id and place, so a text that a third of all rows
have is spread over many ranges. Groups of over a thousandth of all rows, a thousand at most, are joined by broadcast.

A null text has size 1 and crc 0. Rows without a doc_id and repeated rows are rows like others. An empty table gives no rows. More
groups than shards aren't needed: the last shards stay empty. A single group larger than an even share makes a shard that large. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import shared

SHARDS = 8
MAX_SHARDS = 4096
HALVINGS = 8  # of the search that one pass decides
RANGE_ROWS = 1 << 18  # rows of a range, about
HEAVY = 1000  # a group with more than 1 / HEAVY of all rows is heavy
_LOW = (1 << 33) - 1  # monotonically_increasing_id() has the partition above these bits


class Groups:
    """The groups in their order: key, first, bytes, n, part and running, the bytes of its range up to its end."""

    def __init__(self, rows: DataFrame, least: int):
        spark = rows.sparkSession
        groups = shared.written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first")), "groups")
        number = groups.count()
        ranged = groups.repartitionByRange(max(least, -(-number // RANGE_ROWS)), "first", "key").withColumn("part", F.spark_partition_id())
        totals = ranged.withColumn("running", F.sum("bytes").over(Window.partitionBy("part").orderBy("first", "key").rowsBetween(Window.unboundedPreceding, 0)))
        at, schema = shared.folder(spark, "ranges"), totals.schema
        totals.write.partitionBy("part").parquet(at)
        self.table = spark.read.schema(schema).parquet(at).select(*totals.columns)
        sums = self.table.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        self.starts = sums.select("part", F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
        ranges = sums.orderBy("part").collect()  # a row for each range
        self.parts, self.begins, self.total = [r["part"] for r in ranges], [], 0
        for r in ranges:
            self.begins.append(self.total)
            self.total += r["bytes"]
        self.largest = max((r["largest"] for r in ranges), default=0)

    def around(self, bounds: list[int]) -> dict[int, tuple[int, int]]:
        """For each bound the last end of a group at or before it (0 if none), and the first at or after it."""
        out = {b: (self.total, self.total) for b in bounds if b >= self.total} | {b: (0, 0) for b in bounds if b <= 0}
        asked = [(b, bisect_right(self.begins, b) - 1) for b in sorted(set(bounds) - set(out))]
        if asked:
            values = ", ".join(f"({b}L, {self.parts[k]}, {b - self.begins[k]}L)" for b, k in asked)
            spark = self.table.sparkSession
            few = spark.sql(f"SELECT * FROM VALUES {values} AS t(bound, part, rest)")
            near = self.table.where(F.col("part").isin(*{self.parts[k] for _, k in asked})).join(F.broadcast(few), "part")
            below, above = F.when(F.col("running") <= F.col("rest"), F.col("running")), F.when(F.col("running") >= F.col("rest"), F.col("running"))
            found = {r["bound"]: r for r in near.groupBy("bound").agg(F.max(below).alias("below"), F.min(above).alias("above")).collect()}  # a row for each bound
            for b, k in asked:
                begin = self.begins[k]
                out[b] = (begin + (found[b]["below"] or 0), begin if b == begin else begin + found[b]["above"])
        return out

    def feasible(self, tried: list[int], shards: int) -> list[bool]:
        """Whether so many shards of each capacity hold all groups; each shard takes groups until the next doesn't fit."""
        at = dict.fromkeys(tried, 0)
        for _ in range(shards):
            ends = self.around([at[c] + c for c in tried if at[c] < self.total])
            at = {c: a if a >= self.total else ends[a + c][0] for c, a in at.items()}
        return [at[c] >= self.total for c in tried]

    def capacity(self, shards: int) -> int:
        """The smallest capacity of which so many shards hold all groups."""
        even = -(-self.total // shards)
        low, high = max(self.largest, even), even + self.largest  # the second surely suffices: a shard that closes holds an even share
        while low < high:
            tried = sorted({low + (high - low) * k // (1 << HALVINGS) for k in range(1 << HALVINGS)})
            fits = self.feasible(tried, shards)
            first = fits.index(True) if True in fits else len(tried)
            low, high = (tried[first - 1] + 1 if first else low), (tried[first] if first < len(tried) else high)
        return low

    def cuts(self, shards: int) -> list[int]:
        """Where each shard but the last ends."""
        most = self.capacity(shards)
        least = [self.total]  # the earliest ends from which the shards behind can take the rest
        while len(least) < shards:
            bound = least[-1] - most
            least.append(self.around([bound])[bound][1])
        out, at = [], 0
        for k in range(shards - 1, 0, -1):
            even = at + (self.total - at) // (k + 1)
            found = self.around([even, at + most])
            near = min(found[even], key=lambda x: abs(x - even))
            at = min(max(near, least[k]), found[at + most][0])
            out.append(at)
        return out


def _ranked(rows: DataFrame, least: int) -> DataFrame:
    """rows with their place in the order of groups and ids, from 0, as rank."""
    n = rows.count()
    by = ("first", "key", "doc_id")
    ranged = rows.withColumn("again", F.monotonically_increasing_id()).repartitionByRange(max(least, -(-n // RANGE_ROWS)), *by, "again").sortWithinPartitions(*by, "again")
    placed = shared.written(ranged.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("place")), "places")
    placed = placed.withColumns({"part": F.shiftright("place", 33), "low": F.col("place").bitwiseAND(_LOW)})
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    starts = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("low"))  # a row for each partition


def assign(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    if not 1 <= shards <= MAX_SHARDS:
        raise ValueError(f"1 to {MAX_SHARDS} shards")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text)
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole).cast("long") + 1).alias("size"), F.crc32(whole).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"))
    rows = shared.written(rows, "rows")
    groups = Groups(rows, least)
    cuts = F.array(*(F.lit(c).cast("long") for c in groups.cuts(shards))) if shards > 1 else F.array().cast("array<long>")
    end = F.coalesce("start", F.lit(0)) + F.col("running")
    known = groups.table.join(F.broadcast(groups.starts), "part").select("key", "first", "n", F.size(F.filter(cuts, lambda c: c < end)).alias("shard"))  # a row for each range
    heavy = F.col("n") * HEAVY > rows.count()
    few = F.broadcast(known.where(heavy).drop("n"))  # at most HEAVY rows
    light = rows.join(few.select("key"), "key", "left_anti").join(known.where(~heavy).drop("n"), "key")
    placed = shared.written(rows.join(few, "key").unionByName(light), "placed")
    ranked = _ranked(placed, least)
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("from"))
    return ranked.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("from")).alias("slot"))  # a row for each shard


def op13(spark, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, encode(coalesce(text, '')) AS raw, CASE WHEN text IS NULL THEN '' ELSE sha256(text) END AS key FROM documents),
g AS (SELECT key, CAST(sum(size) AS BIGINT) AS b, min(doc_id) AS f FROM d GROUP BY key),
o AS (SELECT key, f, CAST(sum(b) OVER (ORDER BY f NULLS FIRST, key) AS BIGINT) AS e FROM g),
t AS (SELECT CAST(coalesce(max(e), 0) AS BIGINT) AS total, (SELECT max(b) FROM g) AS largest FROM o),
s AS (SELECT greatest(largest, (total + 7) // 8) AS lo, (total + 7) // 8 + largest AS hi, 0 AS step, CAST(0 AS BIGINT) AS pos FROM t UNION ALL
  SELECT CASE WHEN step = 8 AND pos < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN step = 8 AND pos >= total THEN (lo + hi) // 2 ELSE hi END, CASE WHEN step = 8 THEN 0 ELSE step + 1 END,
    CASE WHEN step = 8 THEN 0 ELSE coalesce((SELECT max(e) FROM o WHERE e <= pos + (lo + hi) // 2), 0) END FROM s, t WHERE lo < hi),
c AS (SELECT max(lo) AS cap FROM s),
l AS (SELECT 7 AS k, (SELECT min(e) FROM (SELECT 0 AS e UNION ALL SELECT e FROM o) WHERE e >= total - cap) AS p FROM t, c UNION ALL
  SELECT k - 1, (SELECT min(e) FROM (SELECT 0 AS e UNION ALL SELECT e FROM o) WHERE e >= p - cap) FROM l, c WHERE k > 1),
u AS (SELECT 0 AS k, CAST(0 AS BIGINT) AS p UNION ALL SELECT u.k + 1, least(greatest(
    (SELECT CASE WHEN v - a <= w - v THEN a ELSE w END FROM (SELECT u.p + (total - u.p) // (8 - u.k) AS v) x, LATERAL (SELECT coalesce(max(e), 0) AS a FROM o WHERE e <= v) y, LATERAL (SELECT min(e) AS w FROM (SELECT 0 AS e UNION ALL SELECT e FROM o) WHERE e >= v) z),
    (SELECT l.p FROM l WHERE l.k = u.k + 1)), (SELECT max(e) FROM o WHERE e <= u.p + cap)) FROM u, t, c WHERE u.k < 7),
h AS (SELECT d.doc_id, d.size, d.raw, o.f, o.key, (SELECT count(*) FROM u WHERE u.k > 0 AND u.p < o.e) AS shard FROM d JOIN o USING (key))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * (size - 1)), lambda i: CASE WHEN i % 8 = 0 THEN CAST('0x' || substr(hex(raw), CAST(i // 4 + 1 AS INTEGER), 2) AS BIGINT) ELSE 0 END)), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY f NULLS FIRST, key, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM h
"""
