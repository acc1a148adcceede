"""Names that nothing has yet (PRJ-15): for each wanted name the first free one of name, name (2), name (3), ..., as if names were given one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import dedupe

BASE = ["stem", "suffix"]
RANGE_ROWS = 1 << 18  # rows of a range, about
_LOW = (1 << 33) - 1  # monotonically_increasing_id() has the partition above these bits


def split(name: Column) -> tuple[Column, Column]:
    """Stem, with its folder, and suffix: from the last dot on, if something stands before and behind it."""
    suffix = F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1)
    return F.left(name, F.length(name) - F.length(suffix)), suffix


def numbered(stem: Column, suffix: Column, number: Column) -> Column:
    return F.when(number == 1, F.concat(stem, suffix)).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), suffix))


def ranked(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows with `rank`, their place from 1 among those of equal `by`, in an order that has no ties. One range exchange by both, so a group of any size is
    spread over many tasks; then the place of each range and the first of each group."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dedupe.written(rows, "unranked")
    parts = max(least, -(-rows.count() // RANGE_ROWS))
    sorted_ = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = dedupe.written(sorted_, "ranges").withColumns({"_part": F.shiftright("_at", 33), "_low": F.col("_at").bitwiseAND(_LOW)})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    whole = placed.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_low"))  # a row for each partition
    firsts = whole.groupBy(*by).agg(F.min("_at").alias("_first"))
    return whole.join(firsts, by).withColumn("rank", F.col("_at") - F.col("_first") + 1).select(*rows.columns, "rank")


def _given(wanted: DataFrame, blocked: DataFrame) -> DataFrame:
    """wanted (order, stem, suffix) with `number`: the k-th of a base gets its k-th number that isn't blocked (stem, suffix, number).

    If b is the j-th blocked number of a base, the wants from the (b - j + 1)-th on come after it. So with wants at k and blocked numbers at b - j + 1, blocked ones first,
    a want's number is its place among both."""
    wants = ranked(wanted, BASE, "order").select("order", *BASE, F.col("rank").alias("at"), F.lit(1).alias("kind"))
    own = blocked.join(wanted.select(*BASE).distinct(), BASE, "left_semi").distinct()
    walls = ranked(own, BASE, "number").select(F.col("number").alias("order"), *BASE, (F.col("number") - F.col("rank") + 1).alias("at"), F.lit(0).alias("kind"))
    return ranked(wants.unionByName(walls), BASE, "at", "kind", "order").where("kind = 1").select("order", *BASE, F.col("rank").alias("number"))


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (order, name), each order once, and taken (name): order, name and `given`, that name or the first with a number that neither exists nor is
    given to one before.

    A name may be wanted in two ways, "x (2)" by itself and as the second "x"; the first by order has it, and for the other base it counts as taken: that is what
    rounds are for, as each may meet such names anew. A name that was lost is never won back, since who holds it moves on only for one before him."""
    stem, suffix = split(F.col("name"))
    wants = dedupe.written(wanted.where("name is not null").select("order", "name", stem.alias("stem"), suffix.alias("suffix")), "wanted")
    number = F.regexp_extract("stem", r" \(([1-9][0-9]{0,17})\)$", 1)
    there = taken.where("name is not null").select(stem.alias("stem"), suffix.alias("suffix"))
    again = there.withColumn("digits", number).where("digits not in ('', '1')")
    again = again.select(F.left("stem", F.length("stem") - F.length("digits") - 3).alias("stem"), "suffix", F.col("digits").cast("long").alias("number"))
    blocked = dedupe.written(there.select("stem", "suffix", F.lit(1).cast("long").alias("number")).unionByName(again).distinct(), "blocked")
    given = dedupe.written(_given(wants.drop("name"), blocked), "given")
    while True:
        full = numbered(F.col("stem"), F.col("suffix"), F.col("number"))
        firsts = given.groupBy(full.alias("given")).agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1")
        lost = given.withColumn("given", full).join(firsts, "given").where("order > first").select(*BASE, "number").distinct()
        lost = dedupe.written(lost, "lost")
        if lost.isEmpty():
            break
        blocked = dedupe.written(blocked.unionByName(lost), "blocked")
        bases = lost.select(*BASE).distinct()
        anew = _given(wants.drop("name").join(bases, BASE, "left_semi"), blocked)
        given = dedupe.written(given.join(bases, BASE, "left_anti").unionByName(anew), "given")
    return wants.join(given.select("order", "number"), "order").select("order", "name", numbered(F.col("stem"), F.col("suffix"), F.col("number")).alias("given"))
