"""Albums and their files: evidence, completeness, arrivals (DOM-20 to DOM-22, DOM-57 to DOM-60, DOM-68 to DOM-70, DOM-73, DOM-75, FLT-13, FLT-15, JOIN-20, SET-05, WIN-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe


def evidence(files: DataFrame, first: int = 8) -> DataFrame:
    """DOM-20: files (album, id, name, albumartist, artist, title, date, codec, minutes, verdict): each album's commonest tags (of equals, the first
    seen), minutes, files, counts of verdicts, and its first files with their titles. Files with the same id are told apart by name."""
    seen = F.struct("id", "name")
    own = dedupe.spread(files, "album").withColumn("seen", seen)  # all that follows groups and joins by album where its rows are
    out = own.groupBy("album").agg(F.count("*").alias("files"), F.round(F.sum(F.coalesce("minutes", F.lit(0.0))), 1).alias("minutes"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "mismatch").alias("mismatch"), F.count_if(F.col("verdict").isNull()).alias("none"))
    tags = ["albumartist", "artist", "title", "date", "codec"]
    each = own.select("album", "seen", F.inline(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).cast("string").alias("value")) for t in tags)))).where(expr.filled(F.col("value")))
    counts = each.groupBy("album", "tag", "value").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    modes = counts.groupBy("album").pivot("tag", tags).agg(F.min_by("value", F.struct(-F.col("n"), F.col("seen"))))
    begin = own.withColumn("k", F.row_number().over(Window.partitionBy("album").orderBy("id", "name"))).where(F.col("k") <= first)
    begin = begin.groupBy("album").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%d:%s", "k", F.coalesce("name", F.lit(""))))), ";").alias("sample"))
    return out.join(modes, "album", "left").join(begin, "album").withColumn("artist", F.coalesce("albumartist", "artist")).drop("albumartist")


def shared_audio(pairs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """JOIN-20, DOM-21: pairs (ours, theirs), items (album, item): whether at least so much of ours is in theirs; an album without
    known items counts as sharing."""
    own = items.distinct()
    sizes = own.groupBy(F.col("album").alias("ours")).agg(F.count("*").alias("size"))
    common = pairs.join(own.select(F.col("album").alias("ours"), "item"), "ours").join(own.select(F.col("album").alias("theirs"), "item"), ["theirs", "item"]).groupBy("ours", "theirs").agg(F.count("*").alias("common"))
    known = own.select(F.col("album").alias("theirs"), F.lit(True).alias("known")).distinct()
    out = pairs.join(sizes, "ours", "left").join(known, "theirs", "left").join(common, ["ours", "theirs"], "left")
    return out.select("ours", "theirs", F.when(F.col("size").isNull() | F.col("known").isNull(), True).otherwise(F.coalesce("common", F.lit(0)) >= least * F.col("size")).alias("shares"))


def only_here(members: DataFrame) -> DataFrame:
    """SET-05, DOM-22: members (group, album, item): for each album the items that no other album of its group has."""
    none = F.col("album").isNull()
    own = dedupe.spread(members.select("group", "album", "item"), "group", "item").groupBy("group", "item")
    alone = own.agg(F.min("album").alias("album"), F.max("album").alias("last"), F.min(none).alias("all"), F.max(none).alias("any")).where("album <=> last and all = any")
    return alone.groupBy("group", "album").agg(F.count("*").alias("only_here"))


def incomplete(albums: DataFrame, items: DataFrame) -> DataFrame:
    """FLT-15: albums (album, tracks, discs), items (album, disc): fewer items than tracks, or discs without any."""
    have = items.groupBy("album").agg(F.count("*").alias("have"), F.count_distinct("disc").alias("have_discs"))
    return albums.join(have, "album").where("have < tracks or have_discs < discs").select("album", (F.col("tracks") - F.col("have")).alias("missing"), (F.col("discs") - F.col("have_discs")).alias("missing_discs"))


def whole_album_files(files: DataFrame, least_others: int = 4, least_share: float = 0.8) -> DataFrame:
    """FLT-13, WIN-05: files (album, id, name: without extension, title, album_title, seconds, verdict) that hold a whole album: as long as most of the others
    together, named like the album or as a full one, and not confirmed as one recording. Length alone or a name alone says nothing."""
    by = Window.partitionBy("album")
    own = F.coalesce("seconds", F.lit(0.0))
    title = expr.norm_title(F.col("album_title"))
    names = F.filter(F.array(expr.norm_title(F.col("name")), expr.norm_title(F.col("title"))), lambda n: n != "")
    named = F.exists(names, lambda n: F.contains(n, F.lit("full album")) | ((F.col("norm") != "") & F.contains(n, F.col("norm")))) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit("full album"))
    out = files.withColumns({"others": F.sum(own).over(by) - own, "n": F.count("*").over(by) - 1, "norm": title}).withColumn("named", named)
    return out.where((F.col("n") >= least_others) & (own >= least_share * F.col("others")) & F.col("named") & ~F.col("verdict").eqNullSafe("confirmed")).select("album", "id")


def arrivals(wanted: DataFrame, library: DataFrame, had: DataFrame) -> DataFrame:
    """DOM-57: wanted (key, artist, title), library (album, artist, title), had (key, album): the first album of each wanted name that
    wasn't there before."""
    name = lambda c: expr.norm_name(F.col(c))
    # Of a name's albums in order, one of the first n + 1 is new to a key that had n: no other is looked at.
    places = library.select("album", name("artist").alias("a"), name("title").alias("t")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("a", "t").orderBy(F.asc_nulls_last("album"))))
    before = had.select("key", "album").distinct().groupBy("key").agg(F.count("*").cast("int").alias("n"))
    asked = wanted.select("key", name("artist").alias("a"), name("title").alias("t")).join(before, "key", "left")
    found = asked.withColumn("place", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(0)) + 1))).join(places, ["a", "t", "place"])
    return found.join(had, ["key", "album"], "left_anti").groupBy("key").agg(F.min("album").alias("album"))


def wanted_key(artist: Column, title: Column) -> Column:
    """DOM-57: the key of an entry made by hand; null without both names."""
    a, t = expr.norm_name(artist), expr.norm_name(title)
    return F.when((a != "") & (t != ""), F.concat(F.lit("manual:"), a, F.lit("|"), t))


def wanted_by_hand(asked: DataFrame, current: DataFrame, dismissed: DataFrame) -> DataFrame:
    """DOM-57: asked (artist, title), current (id, key, status), dismissed (id): every entry's key and status after both. An open entry stays as it is, any other
    with an asked key opens anew; of those that were there, open ones that are dismissed close."""
    gone = F.when((F.col("status") == "open") & F.col("gone").isNotNull(), "dismissed").otherwise(F.col("status"))
    old = current.join(dismissed.select("id", F.lit(True).alias("gone")), "id", "left").select("key", gone.alias("status"))
    new = asked.select(wanted_key(F.col("artist"), F.col("title")).alias("key")).where("key is not null").distinct().select("key", F.lit("open").alias("status"))
    return new.unionByName(old.join(new.select("key"), "key", "left_anti"))


def damaged_keys(entries: DataFrame, library: DataFrame) -> DataFrame:
    """DOM-58: entries (status, files: array of paths), library (path, key): keys of the files of open entries."""
    hurt = entries.where("status = 'open' and files is not null").select(F.explode("files").alias("path")).distinct()
    return library.join(hurt, "path", "left_semi").select("key").distinct()


def settled_batches(matches: DataFrame, imported: DataFrame, batches: DataFrame) -> DataFrame:
    """DOM-59: matches (id, batch, decision), batches (batch, status): what waits in each batch, and its status: a matched batch where nothing
    waits is imported; an imported one where something does says so."""
    waiting = F.col("imported").isNull() & ~F.col("decision").eqNullSafe("skip")
    own = matches.join(imported.select("id", F.lit(True).alias("imported")), "id", "left").groupBy("batch").agg(F.count_if(waiting).alias("waiting"))
    left, live = F.coalesce("waiting", F.lit(0)), F.col("status").isin("matched", "imported")
    return batches.join(own, "batch", "left").select("batch", left.alias("waiting"), F.when(live & (left == 0), "imported").otherwise(F.col("status")).alias("status"), ((F.col("status") == "imported") & (left > 0)).alias("noted"))


def upgrade_removals(upgrades: DataFrame, albums: DataFrame, placed: DataFrame, root: Column) -> DataFrame:
    """DOM-60: upgrades (path, replaced: folder), albums (album, folder, status, decision), placed (source, dest): the placed files below a folder that an
    approved and imported album replaces, but for the batch's own, below root."""
    ready = albums.where("status = 'imported' and decision = 'approve'").select("album", "folder")
    done = upgrades.withColumn("folder", F.explode(ancestors(F.col("path")))).join(ready, "folder").select("album", F.col("replaced").alias("folder")).distinct()
    others = placed.where(~F.col("source").startswith(root)).withColumn("folder", F.explode(ancestors(F.col("dest"))))
    return dedupe.spread(others.join(done, "folder").select("album", "dest"), "dest", "album").distinct()


def ancestors(path: Column) -> Column:
    """JOIN-13: all folders above a path, for an equi-join in place of a prefix join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def groups_side_by_side(members: DataFrame, albums: DataFrame, items: DataFrame) -> DataFrame:
    """DOM-22: members (group, folder, role), albums (folder, album, imported, decision, action), items (album, item): each member with its status and the number
    of items that no other member of its group has."""
    c = F.col
    status = F.when(c("album").isNull(), "no match row").when(c("imported"), "imported").when(expr.filled(c("decision")), F.concat(F.lit("decided: "), c("decision"))).when(c("action") == "review", "open").otherwise(c("action"))
    own = members.join(albums, "folder", "left").withColumn("status", status)
    alone = only_here(own.where("album is not null").select("group", "album").join(items, "album").select("group", "album", "item"))
    return own.join(alone, ["group", "album"], "left").select("group", "folder", "role", "status", F.coalesce("only_here", F.lit(0)).alias("only_here"))


def in_library(candidates: DataFrame, imported: DataFrame, sharing: DataFrame, slack: float = 0.05) -> DataFrame:
    """DOM-21: candidates (album, release, distance), imported (release, theirs), sharing (ours, theirs, shares), of shared_audio(): for each album the first imported
    album of a release as near as the best candidate, within slack, that shares its audio."""
    best = candidates.groupBy("album").agg(F.min("distance").alias("best"))
    near = candidates.join(best, "album").where(F.col("distance") <= F.col("best") + slack).select(F.col("album").alias("ours"), "release")
    return near.join(imported, "release").join(sharing.where("shares"), ["ours", "theirs"]).groupBy("ours").agg(F.min("theirs").alias("already"))


def no_art(albums: DataFrame, art: DataFrame) -> DataFrame:
    """DOM-69: albums (album, art: path) whose picture isn't known or isn't there; art (path)."""
    return albums.join(art.select(F.col("path").alias("art")), "art", "left_anti").select("album")


def disc_albums(files: DataFrame, dropped_files: DataFrame, dropped_folders: DataFrame) -> DataFrame:
    """SRC-15: files (path): albums are folders; folders of discs beside each other, as "cd 1" or "disc 2" with the same words before, are one. Dropped files (path) and
    files below dropped folders (folder) don't count."""
    kept = dedupe.spread(files, "path").join(dedupe.spread(dropped_files.select("path"), "path"), "path", "left_anti").withColumn("folder", expr.folder(F.col("path")))
    folders = kept.groupBy("folder").agg(F.count("*").alias("files"))
    below = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above")).join(dropped_folders.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct()
    plain = F.regexp_replace("folder", r"(?i)[ _\-\[(]*(?:cd|disc|disk|disco)[ _.\-]*\d+[\])]?/$", "/")
    return folders.join(below, "folder", "left_anti").groupBy(plain.alias("album")).agg(F.count("*").alias("folders"), F.sum("files").alias("files"), F.min("folder").alias("key"))


def foreign_script(albums: DataFrame, items: DataFrame) -> DataFrame:
    """DOM-68: albums (album, title) with another script in their title or in one of their items' (album, title)."""
    every = albums.select("album", "title").unionAll(items.select("album", "title"))
    return every.groupBy("album").agg(F.bool_or(expr.non_latin(F.col("title"))).alias("other")).where("other").select("album")


def unsorted_counts(files: DataFrame, folder: Column) -> DataFrame:
    """DOM-70."""
    return files.agg(F.count_distinct(folder).alias("folders"), F.count("*").alias("files"))


def left_or_skipped(asked: DataFrame, proposals: DataFrame) -> DataFrame:
    """DOM-73: asked (album), proposals (album, status): what becomes of a request to leave a proposal."""
    return asked.join(proposals, "album", "left").select("album", F.when(F.col("status").isNull(), "never checked").when(F.col("status") != "changed", "nothing proposed").otherwise("left").alias("result"))


def batch_of(batches: DataFrame, name: str) -> DataFrame:
    """DOM-75: the batch (batch, folder) with this id or folder; reading it fails if there are several or none."""
    found = batches.where((F.col("batch").cast("string") == name) | (F.col("folder") == name))
    # An aggregate has a row even of nothing, so the refusal is always read.
    one = found.agg(F.count("*").alias("n"), F.min("batch").alias("batch"), F.min("folder").alias("folder"))
    why = F.when(F.col("n") == 0, f"{name} names no batch").otherwise(f"{name} names several batches")
    kind = batches.schema["batch"].dataType
    return one.select(F.when(F.col("n") == 1, F.col("batch")).otherwise(F.raise_error(why).cast(kind)).alias("batch"), "folder")


def named(batches: DataFrame, names: DataFrame) -> DataFrame:
    """DOM-75: names (name) with the batch (batch, folder) that each names by id or folder, or why it is refused: none or several."""
    by_id = names.join(batches.withColumn("name", F.col("batch").cast("string")), "name").select("name", "batch")
    by_folder = names.join(batches.withColumnRenamed("folder", "name"), "name").select("name", "batch")
    found = by_id.union(by_folder).distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("batch").alias("one"))
    both = names.join(found, "name", "left")
    return both.select("name", F.when(F.col("n") == 1, F.col("one")).alias("batch"), F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "several").alias("refused"))


def inbox(folders: DataFrame, batches: DataFrame) -> DataFrame:
    """DOM-75: folders (folder): waiting, or the state of their batch (folder, status); hidden ones are ignored."""
    return folders.join(batches, "folder", "left").select("folder", F.when(F.col("folder").startswith("."), "ignored").otherwise(F.coalesce("status", F.lit("waiting"))).alias("state"))
