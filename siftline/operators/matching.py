"""Majorities, best matches, unique pairs and merges (AGG-10, JOIN-14 to JOIN-17, DOM-30 to DOM-33, DOM-74)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(rows: DataFrame, by: str, value: str, seen: str) -> DataFrame:
    """AGG-10: the commonest value; of equals, the first seen."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value), F.max("n").alias("n"))


def best_match(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """JOIN-15: for each left the right of highest score; of equals, the smallest."""
    return pairs.groupBy(left).agg(F.min_by(F.struct(right, score), F.struct(-F.col(score), F.col(right))).alias("best")).select(left, F.col(f"best.{right}").alias(right), F.col(f"best.{score}").alias(score))


def unique_pairs(old: DataFrame, new: DataFrame, keys: list[tuple[Column, Column]]) -> DataFrame:
    """JOIN-16: old_id and new_id whose key is unique on either side, for each key in turn among what is left."""
    found = None
    for turn, (a, b) in enumerate(keys, 1):
        if found is not None:
            old = old.join(found.select("old_id"), "old_id", "left_anti")
            new = new.join(found.select("new_id"), "new_id", "left_anti")
        x = old.select("old_id", a.alias("key")).groupBy("key").agg(F.min("old_id").alias("old_id"), F.count("*").alias("n")).where("n = 1 and key is not null")
        y = new.select("new_id", b.alias("key")).groupBy("key").agg(F.min("new_id").alias("new_id"), F.count("*").alias("n")).where("n = 1 and key is not null")
        own = x.join(y, "key").select("old_id", "new_id", F.lit(turn).alias("pass"))
        found = own if found is None else found.unionAll(own)
    return found


def merge_suggestions(parts: DataFrame, items: DataFrame, slack: int = 2) -> DataFrame:
    """DOM-30: parts (part, release, tracks, files), items (part, item): releases of several parts that share no item and have
    together at most tracks + slack files."""
    groups = parts.groupBy("release").agg(F.count("*").alias("parts"), F.sum("files").alias("files"), F.max("tracks").alias("tracks")).where(f"parts > 1 and files <= tracks + {slack}")
    shared = items.distinct().join(parts.select("part", "release"), "part").groupBy("release", "item").agg(F.count("*").alias("n")).where("n > 1").select("release").distinct()
    return groups.join(shared, "release", "left_anti")


def merged(albums: DataFrame) -> DataFrame:
    """DOM-31: albums (target, album, decision, imported, batch, folders, files: arrays) that are to be one: its folders in their order of albums, its files once each; refused, with
    a reason, if one is decided or imported or they come from several batches. A merge takes as many albums as a user names."""
    bad = F.max(F.col("decision").isNotNull() | F.col("imported"))
    out = albums.groupBy("target").agg(bad.alias("bad"), F.count_distinct(F.coalesce(F.col("batch").cast("string"), F.lit(""))).alias("batches"), F.min("album").alias("into"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("album", "folders"))), lambda x: x.folders)).alias("folders"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))
    return out.select("target", F.when(F.col("bad"), "decided").when(F.col("batches") > 1, "batches").alias("refused"), "into", "folders", "files")


def carried(groups: DataFrame, files: DataFrame) -> DataFrame:
    """DOM-32: groups (keeper, carry: folder), files (folder, verdict, release): the release that most confirmed files of the folder name, for the keeper."""
    sure = files.where("verdict = 'confirmed' and release <> ''").groupBy(F.col("folder").alias("carry"), "release").agg(F.count("*").alias("n"))
    best = sure.groupBy("carry").agg(F.min_by("release", F.struct(-F.col("n"), F.col("release"))).alias("release"))
    return groups.where("carry is not null").join(best, "carry").select("keeper", "release")


def dropped(members: DataFrame) -> DataFrame:
    """DOM-33: members (scope, action, role, path) as sets: files and folders that were dropped for certain, folders under review."""
    gone = (F.col("action") == "auto") & (F.col("role") == "drop")
    kind = F.when(gone & (F.col("scope") == "file"), "files").when(gone, "folders").when(F.col("action") == "review", "review")
    return members.select(kind.alias("set"), "path").where("set is not null").distinct()


def release_tracks(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """JOIN-17: items (album, item, release_track, recording, disc, place), tracks (album, track, recording, disc, place): an item's track by the release track's id, else by the
    recording if the album has it once, else by disc and place among those with the recording."""
    direct = items.join(tracks.select("album", F.col("track").alias("release_track"), F.col("track")), ["album", "release_track"]).select("album", "item", "track")
    rest = items.join(direct.select("album", "item"), ["album", "item"], "left_anti")
    # A recording may have many tracks: they are counted, not paired with every item.
    once = tracks.where("recording is not null").groupBy("album", "recording").agg(F.count("*").alias("n"), F.min("track").alias("only"))
    placed = tracks.groupBy("album", "recording", "disc", "place").agg(F.min("track").alias("there"))
    both = rest.join(once, ["album", "recording"]).join(placed, ["album", "recording", "disc", "place"], "left")
    found = both.groupBy("album", "item").agg(F.sum("n").alias("n"), F.min("only").alias("only"), F.min("there").alias("there"))
    return direct.unionAll(found.select("album", "item", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("there")).alias("track")).where("track is not null"))


def unpaired(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """DOM-74: how many were paired, and how many of either side weren't."""
    n = lambda rows: rows.agg(F.count("*")).scalar()
    return pairs.agg(F.count("*").alias("pairs")).select("pairs", (n(old) - F.col("pairs")).alias("old_left"), (n(new) - F.col("pairs")).alias("new_left"))
