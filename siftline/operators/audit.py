"""Reconciliation, drift and differences (DOM-47 to DOM-56, DOM-72)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr

FIRST_SLACK, SLACK = 300, 5  # seconds


def presence(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """DOM-47: each key with a flag for every side that has it."""
    marked = [rows.select(key).distinct().select(key, *(F.lit(n == name).alias(n) for n in sides)) for name, rows in sides.items()]
    return reduce(DataFrame.unionAll, marked).groupBy(key).agg(*(F.bool_or(n).alias(n) for n in sides))


def drifted(now: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """DOM-48: now (key, size, mtime, known_mtime), baseline (key, size, mtime): flag and the baseline to keep. Flagged rows keep
    their old one, so that they show again."""
    base = baseline.select(key, F.col("size").alias("base_size"), F.col("mtime").alias("base_mtime"), F.lit(True).alias("based"))
    drift = F.abs(F.col("mtime") - F.nullif("known_mtime", F.lit(0.0)))
    same = (F.col("base_size") == F.col("size")) & (F.col("base_mtime") == F.col("mtime"))
    flag = F.when(F.col("based").isNull(), F.coalesce(drift > FIRST_SLACK, F.lit(False))).when(same, False).otherwise(drift.isNull() | (drift > SLACK))
    out = now.join(base, key, "left").withColumn("flagged", flag)
    first = F.coalesce("base_mtime", "known_mtime", F.lit(0.0))
    return out.select(key, "flagged", F.when(F.col("flagged"), F.coalesce("base_size", "size")).otherwise(F.col("size")).alias("keep_size"), F.when(F.col("flagged"), first).otherwise(F.col("mtime")).alias("keep_mtime"))


def missing_or_changed(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """DOM-49: originals that are gone, or of other size or time."""
    seen = found.select(key, F.col("size").alias("found_size"), F.col("mtime").alias("found_mtime"))
    state = F.when(F.col("found_size").isNull(), "missing").when((F.col("found_size") != F.col("size")) | (F.abs(F.col("found_mtime") - F.col("mtime")) > 0.001), "changed")
    return expected.join(seen, key, "left").withColumn("state", state).where("state is not null").select(key, "state")


def decode_findings(checked: DataFrame) -> DataFrame:
    """DOM-50: path, expected, mb_length, decoded: short files are damaged, or their header is wrong."""
    short = checked.where("expected > 0 and decoded < 0.9 * expected")
    return short.select("path", F.when(expr.damaged(F.col("decoded"), F.col("expected"), F.col("mb_length")), "damaged").otherwise("header wrong").alias("finding"))


def differences(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """DOM-51: key, field, before and after (texts) of fields that differ; null equals null."""
    two = before.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields)).join(after.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields)), key)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in fields))
    return two.select(key, F.inline(F.filter(rows, lambda x: ~x.before.eqNullSafe(x.after))))


def digests(changes: DataFrame, key: str) -> DataFrame:
    """DOM-52: one digest for all differences of a key; those that were left with the same digest needn't show again."""
    own = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))))), ";")  # a key has at most one row for each field
    return changes.groupBy(key).agg(F.count("*").alias("fields"), expr.digest16(own).alias("digest"))


def expected_length(item_present: Column, item_length: Column, original: Column) -> Column:
    """DOM-72: a present item's length counts even if it is null."""
    return F.when(F.coalesce(item_present, F.lit(False)), item_length).otherwise(original)


def reconciled(found: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """DOM-56: found (key), current (key, status): what becomes of each. Dismissed entries stay dismissed."""
    both = found.select(key, F.lit(True).alias("found")).join(current.select(key, "status"), key, "full")
    there = F.coalesce("found", F.lit(False))
    action = F.when(there & F.col("status").isNull(), "insert").when(there & (F.col("status") == "fulfilled"), "reopen").when(there & (F.col("status") == "open"), "update").when(F.col("status") == "open", "fulfil").otherwise("keep")
    return both.select(key, "status", action.alias("action"))


def proposal_state(found: Column, digest: Column, left: Column) -> Column:
    """DOM-53: what a check of an album says: not there, the same, left by the user with this very digest, or changed."""
    return F.when(~found, "not_found").when(digest.isNull(), "same").when(digest.eqNullSafe(left), "left").otherwise("changed")


def summary(problems: dict[str, DataFrame]) -> DataFrame:
    """DOM-54: how many rows each problem has."""
    return reduce(DataFrame.unionAll, [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, rows in problems.items()])


def wanted_findings(albums: DataFrame, damaged: DataFrame) -> DataFrame:
    """DOM-55: albums (folder, items, lossless_share, kbps), damaged (folder, path, unsorted): what is wanted, with its numbers: damaged albums (files, of how many;
    null for folders that are no album), damaged files outside albums, albums whose mean rate is of the lowest tier; a rate of 0 isn't known."""
    none = F.lit(None).cast("long")
    low = albums.where((F.col("kbps") > 0) & (expr.quality_tier(F.col("lossless_share") > 0.5, F.col("kbps")) <= 1)).select(F.concat(F.lit("low_bitrate:"), "folder").alias("key"), F.lit("low_bitrate").alias("kind"), F.round("kbps").cast("long").alias("n"), none.alias("of_n"))
    single = damaged.where("unsorted").select(F.concat(F.lit("damaged_file:"), "path").alias("key"), F.lit("damaged_file").alias("kind"), F.lit(1).cast("long").alias("n"), none.alias("of_n"))
    hurt = damaged.where("not unsorted").groupBy("folder").agg(F.count_distinct("path").alias("n")).join(albums.select("folder", "items"), "folder", "left")
    return low.unionAll(single).unionAll(hurt.select(F.concat(F.lit("damaged:"), "folder"), F.lit("damaged"), "n", "items"))
