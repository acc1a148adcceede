"""Summaries (AGG, WIN-03, SRT, DOM-64, DOM-67)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(rows: DataFrame, day: Column) -> DataFrame:
    """WIN-03: rows of each day and up to it; the running sum goes over days, of which there are few."""
    days = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def top(rows: DataFrame, value: Column, k: int) -> DataFrame:
    """AGG-12: the k commonest values; of equals, the first by name."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def top_and_rest(rows: DataFrame, value: Column, k: int = 3) -> DataFrame:
    """AGG-20: counts of the k commonest values and of all others."""
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "value").limit(k).select("value", F.lit(True).alias("best"))
    name = F.when(F.col("best"), F.col("value")).otherwise("rest")
    return counts.join(F.broadcast(best), "value", "left").groupBy(name.alias("value")).agg(F.sum("n").alias("n"))


def newest_settled(rows: DataFrame, by: str, at: str, now: Column, quiet: Column) -> DataFrame:
    """STM-02, AGG-16, batch form: groups whose last change is a quiet time ago."""
    return rows.groupBy(by).agg(F.max(at).alias("last")).where(F.col("last") <= now - quiet)


def due(rows: DataFrame, checked: str, key: str, limit: int) -> DataFrame:
    """SRT-05, STM-08: what a run takes: never checked first, then longest ago, then by key."""
    return rows.orderBy(F.col(checked).asc_nulls_first(), key).limit(limit)


def kind_order(kind: Column, kinds: list[str]) -> Column:
    """SRT-06: the place of a kind in a fixed order; 0 for others."""
    return F.array_position(F.array(*map(F.lit, kinds)), kind)


def sampled(rows: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """SRT-03: n rows by a digest of the seed and their key: the same ones for the same seed, wherever rows stand."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), key).limit(n)


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """DOM-58: rows with their place in an order; a list that a page shows is short enough for one run."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def numbers(rows: DataFrame, of: dict[str, Column]) -> DataFrame:
    """DOM-67: several aggregates in one pass, a row (name, value) for each."""
    one = rows.agg(*(x.cast("double").alias(name) for name, x in of.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("value")) for name in of))))


def panels(rows: DataFrame, of: dict[str, tuple[Column, Column]], size: str) -> DataFrame:
    """DOM-67: counts and bytes by several values in one pass: each panel's value, and which rows count."""
    each = F.filter(F.array(*(F.struct(F.lit(name).alias("panel"), value.alias("value"), F.coalesce(which, F.lit(False)).alias("which")) for name, (value, which) in of.items())), lambda x: x.which)
    return rows.select(F.col(size).alias("size"), F.inline(each)).groupBy("panel", "value").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def commonest(rows: DataFrame, of: dict[str, tuple[Column, int]]) -> DataFrame:
    """DOM-64: the commonest values of each panel, of equals the first by name; null and empty values don't count."""
    each = F.filter(F.array(*(F.struct(F.lit(name).alias("panel"), value.alias("value"), F.lit(most).alias("most")) for name, (value, most) in of.items())), lambda x: x.value != "")
    counts = rows.select(F.inline(each)).groupBy("panel", "value", "most").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("n"), "value"))
    return counts.withColumn("k", place).where("k <= most").select("panel", "value", "n")


def records(albums: DataFrame, items: DataFrame) -> DataFrame:
    """DOM-64: albums (id, year), items (album, length): the oldest, the longest, that with most tracks, and that with the longest track; of equals the smallest id."""
    own = items.groupBy(F.col("album").alias("id")).agg(F.sum("length").alias("seconds"), F.count("*").alias("tracks"), F.max("length").alias("longest"))
    rows = albums.select("id", "year").join(own, "id", "left").na.fill(0, ["seconds", "tracks", "longest"])
    first = lambda key: F.min_by("id", F.struct(key, F.col("id")))
    of = {"oldest": first(F.col("year")), "longest_album": first(-F.col("seconds")), "most_tracks": first(-F.col("tracks")), "longest_track": first(-F.col("longest"))}
    one = rows.agg(*(x.alias(name) for name, x in of.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("record"), F.col(name).alias("id")) for name in of))))


def totals(albums: DataFrame, items: DataFrame) -> DataFrame:
    """DOM-64: a library's totals in one row."""
    tracks = items.agg(F.count("*")).scalar()
    seconds = items.join(albums.select(F.col("id").alias("album")), "album", "left_semi").agg(F.round(F.sum("length")).cast("long")).scalar()
    one = albums.agg(F.count("*").alias("albums"), F.count_distinct("artist").alias("artists"), F.count_if("comp").alias("compilations"), F.count("genre").alias("with_genre"))
    return one.select("*", tracks.alias("tracks"), seconds.alias("seconds"))
