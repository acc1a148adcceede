"""Plans of changes, without their effects (DOM-34 to DOM-41, DOM-61 to DOM-63, DOM-71, DOM-76)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import albums as albums_

#: Seconds within which a length fits, beyond which another is ruled out, beyond which a file isn't its track; the least similarity of copies.
FIT, FAR, DEMOTE, COPY = 3, 6, 10, 0.9


def match_action(strong: Column, distance: Column, in_dupe: Column) -> Column:
    """DOM-34."""
    return F.when(in_dupe, "review").when(strong, "auto").when(distance.isNull(), "unsorted").otherwise("review")


def selected(matches: DataFrame, imported: DataFrame) -> DataFrame:
    """DOM-35, JOIN-05: matches (id, action, decision) that aren't imported: how each goes in."""
    mode = F.when(F.col("decision") == "approve", "apply").when(F.col("decision") == "asis", "asis").when(F.col("decision").isNotNull(), F.lit(None)).when(F.col("action") == "auto", "apply").when(F.col("action") == "unsorted", "asis")
    return matches.join(imported.select("id"), "id", "left_anti").withColumn("mode", mode).where("mode is not null")


def import_plan(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """DOM-36: albums, files and bytes by mode; files (id, size)."""
    return chosen.join(files, "id").groupBy("mode").agg(F.count_distinct("id").alias("albums"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def copies_of_tracks(extras: DataFrame, tracks: DataFrame, similar: Column | None = None) -> DataFrame:
    """DOM-37: extras and tracks (album, extra_*/track_* id, title, seconds): extras that repeat a track: the same title, and where both have a fingerprint a similar
    one with at most DEMOTE seconds between, else at most FIT."""
    gap = F.abs(F.col("extra_seconds") - F.col("track_seconds"))
    same = gap <= FIT if similar is None else F.when(similar.isNotNull(), (gap <= DEMOTE) & (similar >= COPY)).otherwise(gap <= FIT)
    title = expr.trimmed(F.col("extra_title"))
    return extras.join(tracks, "album").where((title != "") & (title == expr.trimmed(F.col("track_title"))) & F.coalesce(same, F.lit(False))).groupBy("album", "extra_id").agg(F.min("track_id").alias("track_id"))


def skip_reason(video: Column, damaged: Column, whole: Column, copy_of: Column) -> Column:
    """DOM-38: why an extra isn't put into its album's folder, the first that holds; null if it is."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(yes(video), "video").when(yes(damaged), "damaged").when(yes(whole), "whole_album").when(copy_of.isNotNull(), F.concat(F.lit("copy:"), copy_of.cast("string")))


def prune_duplicates(dropped: DataFrame, placed: DataFrame) -> DataFrame:
    """DOM-39, JOIN-21: dropped (path, keeper, reason) whose keeper is placed: what may go."""
    return dropped.join(placed.select(F.col("source").alias("keeper")), "keeper", "left_semi")


def unplaced_extras(albums: DataFrame, log: DataFrame) -> DataFrame:
    """DOM-40: albums (album, status, files: array) whose import failed half-way, log (source, action): files that no import has placed."""
    every = albums.where("status = 'error'").select("album", F.explode("files").alias("source"))
    return every.join(log.where(F.col("action").startswith("import")).select("source").distinct(), "source", "left_anti").select("album", "source")


def stale_skips(albums: DataFrame, log: DataFrame, reasons: DataFrame) -> DataFrame:
    """DOM-40: albums (album, status, files: array), log (id, source, action, detail), reasons (source): files of imported albums that were skipped last, and that no
    present rule skips, with the reason of then; of albums with something placed only."""
    every = albums.where("status = 'imported'").select("album", F.explode("files").alias("source"))
    last = log.groupBy("source").agg(F.max_by(F.struct("action", "detail"), "id").alias("last"))
    own = every.join(last, "source")
    live = own.where(F.col("last.action").startswith("import")).select("album").distinct()
    return own.where("last.action = 'skip_extra'").join(live, "album", "left_semi").join(reasons.select("source"), "source", "left_anti").select("album", "source", F.col("last.detail").alias("was"))


def swaps(files: DataFrame, agree: Callable[[Column, Column], Column] = expr.titles_agree) -> DataFrame:
    """DOM-41: files (album, file, title, titles: heard, verdict): mismatched files whose audio is another track of the album."""
    wrong = files.where("verdict = 'mismatch'").select("album", "file", F.explode("titles").alias("heard"))
    return wrong.join(files.select("album", F.col("file").alias("other"), "title"), "album").where((F.col("other") != F.col("file")) & agree(F.col("heard"), F.col("title"))).groupBy("album").agg(F.count_distinct("file").alias("swaps"))


def unverified(size: Column, mtime: Column, base_size: Column, base_mtime: Column, read_size: Column, read_mtime: Column, decoded: Column, expected: Column, other_length: Column) -> Column:
    """DOM-61: why a library file isn't a verified copy, or null: it is there, an audit has seen it unchanged, and as it is now it decodes in full."""
    unseen = ~(base_size.eqNullSafe(size) & base_mtime.eqNullSafe(mtime))
    unread = ~(read_size.eqNullSafe(size) & read_mtime.eqNullSafe(mtime)) | read_size.isNull()
    return F.when(size.isNull(), "missing").when(unseen, "unseen").when(unread, "undecoded").when(expr.damaged(decoded, expected, other_length), "short")


def prunable(batches: DataFrame, files: DataFrame, placed: DataFrame, skipped_files: DataFrame, skipped_folders: DataFrame, log: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """DOM-61: batches (batch, status, note, changed, inside) with what becomes of each: unsettled, not_due, held or ready, the number of files that hold it and the
    first reason. files (batch, path), placed (path, why: of unverified()), skipped copies by file (path) or folder, log (id, path, action)."""
    last = log.groupBy("path").agg(F.max_by("action", "id").alias("last"))
    own = files.withColumn("folder", expr.folder(F.col("path"))).join(placed.select("path", "why", F.lit(True).alias("placed")), "path", "left")
    own = own.join(skipped_files.select("path", F.lit(True).alias("by_file")).distinct(), "path", "left").join(skipped_folders.select("folder", F.lit(True).alias("by_folder")).distinct(), "folder", "left").join(last, "path", "left")
    why = F.when(F.col("placed"), F.col("why")).when(F.coalesce("by_file", "by_folder").isNotNull(), F.lit(None)).otherwise(F.concat(F.lit("not in the library"), F.coalesce(F.concat(F.lit(": "), "last"), F.lit(""))))
    held = own.withColumn("reason", why).where("reason is not null").groupBy("batch").agg(F.count("*").alias("problems"), F.min_by("reason", "path").alias("reason"))
    due = F.col("changed").cast("timestamp") + F.make_dt_interval(days=F.lit(days)) <= now.cast("timestamp")  # whole days that have passed
    state = F.when((F.col("status") != "imported") | expr.filled(F.col("note")), "unsettled").when(~due, "not_due").when(~F.col("inside") | F.col("problems").isNotNull(), "held").otherwise("ready")
    out = batches.join(held, "batch", "left").withColumn("state", state)
    return out.select("batch", "state", F.when(F.col("state") == "held", F.coalesce("problems", F.lit(0))).alias("problems"), F.when(F.col("state") == "held", F.when(~F.col("inside"), "outside").otherwise(F.col("reason"))).alias("reason"))


def art_plan(albums: DataFrame, candidates: DataFrame) -> DataFrame:
    """DOM-62: candidates (id, album, kind, picked): each album's picked one, else its first exact one."""
    best = candidates.where("picked or kind = 'exact'").groupBy("album").agg(F.min_by("id", F.struct(~F.col("picked"), F.col("id"))).alias("id"))
    return albums.select("album").join(best, "album")


def art_due(albums: DataFrame, checks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """DOM-63."""
    return albums.join(checks, "album", "left").where(F.col("checked_at").isNull() | (F.col("checked_at") < now - F.make_interval(days=F.lit(days)))).select("album")


def length_queue(files: DataFrame, known: DataFrame) -> DataFrame:
    """DOM-71: releases of short files that weren't looked up, once each."""
    return files.where("decoded < 0.9 * expected and release is not null").select("release").distinct().join(known.select("release"), "release", "left_anti")


def under(files: DataFrame, folders: DataFrame) -> DataFrame:
    """JOIN-13, DOM-76: files (path) below any of folders (folder); the folder '' is that of loose files only."""
    path = F.col("path")
    above = F.when(expr.folder(path) == "", F.array(F.lit(""))).otherwise(albums_.ancestors(path))
    return files.withColumn("folder", F.explode(above)).join(folders.select("folder"), "folder", "left_semi").select(*files.columns).distinct()
