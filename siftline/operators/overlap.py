"""A batch against a library (DOM-11 to DOM-14, JOIN-10, JOIN-11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import dedupe

#: Keys of more holders than this look for partners only where they must.
COMMON = 1000
#: The share that decides, the share from which fingerprints are compared, their least similarity, seconds that may lie between.
LEAST_SHARE, GATE, SAME_RECORDING, PRINT_GAP, TITLE_GAP = 0.9, 0.5, 0.75, 10, 3
#: What a row of batch_plan() says of a folder; it sorts them in this order, so facts come before the pairs that they are of.
GONE, FACT, PAIR, ALIKE, FILE, FLAG = range(6)


def overlaps(batch: DataFrame, library: DataFrame, gate: float = GATE, common: int = COMMON) -> DataFrame:
    """DOM-11: both (set, key), distinct: pairs of sets whose larger share is `gate` at least, with the number of shared keys; from
    LEAST_SHARE up the overlap is certain, below that fingerprints decide.

    The smaller set of such a pair has at least ceil(gate * size) of its keys in the other. Keys of at most `common` holders are all counted; of others only
    those among a set's size - ceil(gate * size) + 1 rarest look for partners, and what is beyond these is counted for pairs that can still reach the gate."""
    c = F.col
    holders = batch.unionAll(library).groupBy("key").agg(F.count("*").alias("holders"))

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        whole = Window.partitionBy("set")
        own = rows.join(holders, "key").withColumns({"size": F.count("*").over(whole), "cold": F.count_if(c("holders") <= common).over(whole), "k": F.row_number().over(whole.orderBy("holders", "key"))})
        first = F.greatest("cold", c("size") - F.ceil(gate * c("size")) + 1)
        return own.select("key", c("set").alias(name), c("size").cast("int").alias(f"size_{name}"), (c("size") - first).cast("int").alias(f"rest_{name}"), (c("holders") <= common).alias(f"cold_{name}"), (c("k") > first).alias(f"late_{name}"))

    x, y = ranked(batch, "ours"), ranked(library, "theirs")
    hot_x, hot_y = x.where("not cold_ours"), y.where("not cold_theirs")
    smaller = c("size_ours") <= c("size_theirs")
    found = [x.where("cold_ours").join(y.where("cold_theirs"), "key"), hot_x.where("not late_ours").join(hot_y, "key").where(smaller), hot_x.join(hot_y.where("not late_theirs"), "key").where(~smaller)]
    pair = ["ours", "theirs", "size_ours", "size_theirs"]
    rest = F.when(smaller, c("rest_ours")).otherwise(c("rest_theirs")).alias("rest")
    some = reduce(DataFrame.unionAll, [rows.select(*pair, rest) for rows in found]).groupBy(*pair, "rest").agg(F.count("*").alias("shared"))
    some = some.where(c("shared") + c("rest") >= F.ceil(gate * F.least("size_ours", "size_theirs")))
    own = lambda rows, name: rows.select(name, "key", F.lit(True).alias("there"))
    left = some.where("rest > 0")
    more = [left.where(smaller).join(own(x.where("late_ours"), "ours"), "ours").drop("there").join(own(hot_y, "theirs"), ["theirs", "key"], "left"), left.where(~smaller).join(own(y.where("late_theirs"), "theirs"), "theirs").drop("there").join(own(hot_x, "ours"), ["ours", "key"], "left")]
    late = reduce(DataFrame.unionAll, [rows.select(*pair, "shared", "there") for rows in more]).groupBy(*pair, "shared").agg((c("shared") + F.count("there")).alias("all")).select(*pair, c("all").alias("shared"))
    counts = some.where("rest = 0").select(*pair, "shared").unionAll(late).withColumns({n: c(n).cast("long") for n in ("size_ours", "size_theirs")})
    share = F.col("shared") / F.least("size_ours", "size_theirs")
    return counts.select("ours", "theirs", "size_ours", "size_theirs", "shared").withColumn("share", F.round(share, 3)).withColumn("certain", share >= LEAST_SHARE).where(share >= gate)


def refined(pairs: DataFrame, ours: DataFrame, theirs: DataFrame, similar: Column) -> DataFrame:
    """DOM-11: pairs of overlaps() with the keys of ours that fingerprints find in theirs counted too, where the shares leave it open; those that
    reach LEAST_SHARE by either. ours and theirs: (set, key, seconds, print), renamed ours_* and theirs_*; similar compares their prints.
    Prints travel as hashes; each distinct pair of prints is compared once, as many tracks share a recording."""
    c = F.col
    pairs = dedupe.written(pairs, "overlaps")
    open_ = pairs.where("not certain").select("ours", "theirs")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(c(f"{name}_set").alias(name), c(f"{name}_key").alias("key"), c(f"{name}_seconds").alias("seconds"), F.when(c(f"{name}_print").isNotNull(), F.xxhash64(f"{name}_print")).alias("hash"))

    row = lambda rows, name: rows.select("ours", "theirs", "key", "seconds", "hash", F.lit(name).alias("side"))
    both = dedupe.spread(row(open_.join(side(ours, "ours"), "ours"), 0).unionAll(row(open_.join(side(theirs, "theirs"), "theirs"), 1)), "ours", "theirs")
    alone = F.min("side").over(Window.partitionBy("ours", "theirs", "key")) == F.max("side").over(Window.partitionBy("ours", "theirs", "key"))
    left = both.withColumn("alone", alone).where(c("alone") & c("hash").isNotNull() & c("seconds").isNotNull())
    mine = left.where("side = 0").select("ours", "theirs", c("key").alias("ours_key"), c("seconds").alias("a"), c("hash").alias("x"))
    their = left.where("side = 1").select("ours", "theirs", c("seconds").alias("b"), c("hash").alias("y"))
    near = mine.join(their, ["ours", "theirs"]).where(F.abs(c("a") - c("b")) <= PRINT_GAP).select("ours", "theirs", "ours_key", "x", "y").distinct()
    near = dedupe.written(near, "near")
    prints = lambda rows, name, mark: rows.where(f"{name}_print is not null").select(F.xxhash64(f"{name}_print").alias(mark), f"{name}_print").distinct()
    compared = near.select("x", "y").distinct().join(prints(ours, "ours", "x"), "x").join(prints(theirs, "theirs", "y"), "y")
    alike = dedupe.written(compared.where(F.coalesce(similar >= SAME_RECORDING, F.lit(False))).select("x", "y"), "alike")
    more = near.join(alike, ["x", "y"], "left_semi").groupBy("ours", "theirs").agg(F.count_distinct("ours_key").alias("more"))
    out = pairs.join(more, ["ours", "theirs"], "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0)))
    share = lambda size: F.col("shared") / F.col(size)
    return out.where(F.greatest(share("size_ours"), share("size_theirs")) >= LEAST_SHARE).select("ours", "theirs", "shared", F.round(share("size_ours"), 3).alias("share_ours"), F.round(share("size_theirs"), 3).alias("share_theirs"))


def same_recordings(ours: DataFrame, theirs: DataFrame, block: list[str], similar: Column | None = None) -> DataFrame:
    """DOM-12, JOIN-11: ours and theirs (block, set, item, key, title, seconds), renamed ours_*/theirs_*: items that are the same by key, or by a title that
    isn't empty with at most 3 seconds between them, or by fingerprint with at most 10. An unknown length matches by key only."""
    gap = F.abs(F.col("ours_seconds") - F.col("theirs_seconds"))
    title = (F.col("ours_title") == F.col("theirs_title")) & (F.col("ours_title") != "") & (gap <= TITLE_GAP)
    same = F.coalesce(F.col("ours_key") == F.col("theirs_key"), F.lit(False)) | F.coalesce(title, F.lit(False))
    if similar is not None:
        same = same | F.coalesce((gap <= PRINT_GAP) & (similar >= SAME_RECORDING), F.lit(False))
    return ours.join(theirs, block).where(same).select(*block, "ours_set", "theirs_set", "ours_item", "theirs_item").distinct()


def named(same: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """DOM-12: pairs of sets with one name (ours_set, theirs_set; sizes in ours and theirs: set, size): the best partner of each of ours by the
    larger share of items that are the same; below LEAST_SHARE it is an edition to look at."""
    counts = same.groupBy("ours_set", "theirs_set").agg(F.count_distinct("ours_item").alias("a"), F.count_distinct("theirs_item").alias("b"))
    sized = counts.join(ours.select(F.col("set").alias("ours_set"), F.col("size").alias("n")), "ours_set").join(theirs.select(F.col("set").alias("theirs_set"), F.col("size").alias("m")), "theirs_set")
    share = F.greatest(F.col("a") / F.col("n"), F.col("b") / F.col("m"))
    best = sized.withColumn("share", share).groupBy("ours_set").agg(F.min_by(F.struct("theirs_set", "share", (F.col("a") / F.col("n")).alias("covered")), F.struct(-F.col("share"), F.col("theirs_set"))).alias("x"))
    return best.select("ours_set", F.col("x.theirs_set").alias("theirs_set"), F.round("x.covered", 3).alias("covered"), (F.col("x.share") >= LEAST_SHARE).alias("held"))


def outcome(release_ours: Column, release_theirs: Column, hurt: Column, unsorted: Column, quality_ours: Column, quality_theirs: Column, extra: Column) -> tuple[Column, Column]:
    """DOM-13: outcome and kind; the first that applies."""
    edition = F.coalesce((release_ours != "") & (release_theirs != "") & (release_ours != release_theirs), F.lit(False))
    kind = F.when(edition, "edition").when((hurt > 0) & ~unsorted & (quality_ours >= quality_theirs), "upgrade").when(hurt > 0, "wanted").when(quality_ours > quality_theirs, "upgrade").when(extra > 0, "extra_tracks").otherwise("duplicate")
    return F.when(kind == "duplicate", "skip").otherwise("review"), kind


def batch_plan(dropped: DataFrame, pairs: DataFrame, same_name: DataFrame, facts: DataFrame, files: DataFrame, library_files: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """DOM-14: what becomes of a batch: path, scope, outcome, kind, other and share.

    dropped (path, scope, auto, other, share): copies inside the batch; only those that need no review settle a folder. pairs, of refined(): each
    folder is judged beside the library folder that covers most of it. same_name, of named(): folders that are left. facts (ours, theirs,
    outcome, kind): what outcome() says of a pair, once however often it is there. files (folder, path, digest), library_files (path, digest): identical bytes in folders that
    nothing has settled. elsewhere (ours, theirs, share): also held by what never reached the library, only flagged.

    All that is said of a folder is dealt by it once and sorted once, to spark.sql.shuffle.partitions tasks: joins by folder would each sort their sides,
    and adaptive plans put their partitions together, so that one task holds the sorts of them all. Twins are of digests that the batch has: where many
    files share few digests, twins are few and go to the files."""
    c, auto = F.col, F.col("auto")
    mark = lambda kind: F.lit(kind).alias("mark")
    inside = dropped.select("path", "scope", F.when(auto, "skip").otherwise("review").alias("outcome"), F.when(auto, "in_batch").otherwise("in_batch_review").alias("kind"), "other", c("share").cast("double").alias("share"))
    gone = dropped.where("auto and path is not null").select("path")
    asked = library_files.join(files.where("digest is not null").select("digest").distinct(), "digest", "left_semi")
    twins = dedupe.spread(asked, "digest").groupBy("digest").agg(F.min("path").alias("other"))
    same = files.join(dedupe.spread(gone, "path"), "path", "left_anti").join(twins, "digest")
    said = [
        gone.select(c("path").alias("ours"), mark(GONE)),
        facts.where("ours is not null and theirs is not null").select("ours", "theirs", "outcome", "kind", mark(FACT)),
        pairs.select("ours", "theirs", c("share_ours").cast("double").alias("share"), mark(PAIR)),
        same_name.select(c("ours_set").alias("ours"), c("theirs_set").alias("theirs"), c("covered").cast("double").alias("share"), "held", mark(ALIKE)),
        same.select(c("folder").alias("ours"), c("other").alias("theirs"), F.lit(1.0).alias("share"), "path", mark(FILE)),
        elsewhere.select("ours", "theirs", c("share").cast("double").alias("share"), mark(FLAG)),
    ]
    rows = dedupe.spread(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), said), "ours")
    is_ = lambda kind: c("mark") == kind
    pair, folder = Window.partitionBy("ours", "theirs").orderBy("mark", "share", "outcome", "kind"), Window.partitionBy("ours")
    fact = F.min(F.when(is_(FACT), F.struct("outcome", "kind"))).over(pair.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = F.lag("mark").over(pair).eqNullSafe(c("mark")) & (is_(FACT) | is_(FLAG) & F.lag("share").over(pair).eqNullSafe(c("share")))
    rows = rows.withColumns({"fact": fact, "again": again})
    best = F.min(F.when(is_(PAIR), F.struct((-c("share")).alias("less"), "theirs", "fact"))).over(folder)
    rows = rows.withColumns({"gone": F.max(is_(GONE)).over(folder), "best": best, "named": F.max(is_(ALIKE) & c("fact").isNotNull()).over(folder)})
    open_ = c("best.fact").isNull()
    judged = is_(FACT) & ~c("again") & (c("theirs") == c("best.theirs")) | is_(ALIKE) & c("fact").isNotNull() & open_
    rows = rows.where(~c("gone") & (judged | is_(FILE) & open_ & ~c("named") | is_(FLAG) & ~c("again")))

    def by(fact: Column, alike: Column, file: Column, flag: Column) -> Column:
        return F.when(is_(FACT), fact).when(is_(ALIKE), alike).when(is_(FILE), file).otherwise(flag)

    outcome = by(c("outcome"), F.when(~c("held"), "review").otherwise(c("fact.outcome")), F.lit("skip"), F.lit("flag"))
    kind = by(c("kind"), F.when(~c("held"), "edition").otherwise(c("fact.kind")), F.lit("identical"), F.lit("dump_overlap"))
    path, scope = F.when(is_(FILE), c("path")).otherwise(c("ours")), F.when(is_(FILE), "file").otherwise("folder")
    share = F.when(is_(FACT), -c("best.less")).otherwise(c("share"))
    return inside.unionByName(rows.select(path.alias("path"), scope.alias("scope"), outcome.alias("outcome"), kind.alias("kind"), c("theirs").alias("other"), share.alias("share")))
