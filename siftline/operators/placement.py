"""Replay of an append-only log (DOM-15 to DOM-18, WIN-04, STM-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def placements(log: DataFrame, removal: Column) -> DataFrame:
    """DOM-16: log (id, source, dest, action). Each source's last placing row, unless a removal of its dest has a larger id."""
    placed = log.where(~removal & F.col("dest").isNotNull()).groupBy("source").agg(F.max_by(F.struct("dest", "action", "id"), "id").alias("last"))
    placed = placed.select("source", F.col("last.dest").alias("dest"), F.col("last.action").alias("action"), F.col("last.id").alias("id"))
    gone = log.where(removal).groupBy("dest").agg(F.max("id").alias("gone"))
    return placed.join(gone, "dest", "left").where("gone is null or gone < id").select("source", "dest", "action", "id")


#: What a row of the log makes of its source, by how its action begins; later kinds override earlier ones whatever their order in the log.
LOGGED = [("import", "imported"), ("retag_by_fingerprint", "imported"), ("skip_extra", "skipped"), ("remove_from_library", "removed")]


def logged(action: Column) -> Column:
    """The status that a row of the log gives, or null."""
    return F.coalesce(*(F.when(action.startswith(prefix) if prefix == "import" else action == prefix, F.lit(status)) for prefix, status in LOGGED))


def matched(imported: Column, action: Column) -> Column:
    """The status that a match gives its files."""
    return F.when(imported, "imported").when(action.isin("auto", "unsorted"), "pending").otherwise(action)


def whereabouts(files: DataFrame, log: DataFrame, matches: DataFrame, dropped: DataFrame) -> DataFrame:
    """DOM-17: where every file went, or why it isn't there. files (source), log (id, source, action, detail), matches (source, imported, action, detail), dropped
    (source, detail): copies. What the log says, a removal before a skip before an import, then the match, then nothing; a copy overrides all but an import."""
    status = logged(F.col("action"))
    rank = F.when(status == "removed", 3).when(status == "skipped", 2).otherwise(1)
    said = log.where(status.isNotNull()).groupBy("source").agg(F.max_by(F.struct(status.alias("status"), F.col("detail")), F.struct(rank, F.col("id"))).alias("log"))
    own = matches.groupBy("source").agg(F.min(F.struct(matched(F.col("imported"), F.col("action")).alias("status"), F.col("detail"))).alias("match"))
    twin = dropped.groupBy("source").agg(F.min("detail").alias("twin"), F.lit(True).alias("copy")).withColumnRenamed("twin", "twin_detail")
    out = files.select("source").join(said, "source", "left").join(own, "source", "left").join(twin, "source", "left")
    found = F.coalesce("log", "match")
    copy = F.col("copy").isNotNull() & ~F.coalesce(found["status"] == "imported", F.lit(False))
    return out.select("source", F.when(copy, "duplicate").otherwise(F.coalesce(found["status"], F.lit("unmatched"))).alias("status"), F.when(copy, F.col("twin_detail")).otherwise(found["detail"]).alias("detail"))


def manifest(files: DataFrame, log: DataFrame, matches: DataFrame, skipped: DataFrame) -> DataFrame:
    """DOM-18: the same for a batch, in the order of the log: its last row with a status counts, then a copy that was skipped, then the match with
    its decision. files (source), log (id, source, action, detail), matches (source, imported, decision, action, detail), skipped (source, detail)."""
    status = logged(F.col("action"))
    said = log.where(status.isNotNull()).groupBy("source").agg(F.max_by(F.struct(status.alias("status"), F.col("detail")), "id").alias("log"))
    decided = F.when(F.col("imported"), "imported").when(F.col("decision") != "", F.concat(F.lit("decided:"), "decision")).otherwise(matched(F.lit(False), F.col("action")))
    own = matches.groupBy("source").agg(F.min(F.struct(decided.alias("status"), F.col("detail"))).alias("match"))
    twin = skipped.groupBy("source").agg(F.struct(F.lit("duplicate").alias("status"), F.min("detail").alias("detail")).alias("twin"))
    best = F.coalesce("log", "twin", "match")
    return files.select("source").join(said, "source", "left").join(twin, "source", "left").join(own, "source", "left").select("source", F.coalesce(best["status"], F.lit("unmatched")).alias("status"), best["detail"].alias("detail"))


def library_rows(placed: DataFrame, files: DataFrame, releases: DataFrame) -> DataFrame:
    """DOM-15: placed (source, dest), files (source, key, digest, quality, album, ...), releases (release, sources): each library file as its original is, under
    its path in the library and the release that it was imported as."""
    of = releases.where("release is not null").select(F.explode("sources").alias("source"), "release").groupBy("source").agg(F.max("release").alias("release"))
    return placed.select("source", F.col("dest").alias("path")).join(files, "source").join(of, "source", "left").withColumn("album", F.coalesce("release", "album")).drop("release").withColumnRenamed("source", "origin")


def increment(seen: DataFrame, known: DataFrame, key: str, changed: Column) -> DataFrame:
    """STM-01, FLT-08: rows of seen that are new, or of which `changed` holds beside the known row (columns old_*)."""
    old = known.select(F.col(key), *(F.col(c).alias(f"old_{c}") for c in known.columns if c != key), F.lit(True).alias("_known"))
    return seen.join(old, key, "left").where(F.col("_known").isNull() | changed).select(*seen.columns)
