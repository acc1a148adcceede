"""Containment, clusters, keepers and copies (DOM-03 to DOM-08, JOIN-10, WIN-01, WIN-02, WIN-06, SET)."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONTAINMENT = 0.9
MOST_HOLDERS = 50  # a key that more sets hold says nothing


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write; see spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = spark.sparkContext.getCheckpointDir() or ""
        if not top:
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='checkpoint-')}")
            top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written_to(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written to a new shared folder and read again, so that their lineage ends there; and the folder."""
    at, schema = shared_folder(rows.sparkSession, name), rows.schema
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(schema).parquet(at), at


def written(rows: DataFrame, name: str) -> DataFrame:
    return written_to(rows, name)[0]


def discarded(at: str) -> None:
    """Deletes a folder of written_to() that nothing reads any longer."""
    files, path = fs.FileSystem.from_uri(at if "://" in at else "file://" + at.removeprefix("file:"))
    if files.get_file_info(path).type == fs.FileType.Directory:
        files.delete_dir(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, dealt to spark.sql.shuffle.partitions tasks, which adaptive plans don't put together: groups of nearly as many keys as rows
    are then made in these tasks, each with its share, not first in the few tasks that read large files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def containment_pairs(members: DataFrame, least: float = CONTAINMENT, most: int = MOST_HOLDERS) -> DataFrame:
    """DOM-03: members (set, key), distinct. a < b, shared keys, both sizes and containment, from least up. Keys of over
    `most` sets, a fixed part of the rule, are left out of what is shared, so no key makes over most squared pairs."""
    sizes = members.groupBy("set").agg(F.count("*").alias("size"))
    fit = members.groupBy("key").agg(F.count("*").alias("holders")).where(F.col("holders").between(2, most)).select("key")
    rare = members.join(fit, "key")
    pairs = rare.select("key", F.col("set").alias("a")).join(rare.select("key", F.col("set").alias("b")), "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(sizes.select(F.col("set").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("set").alias("b"), F.col("size").alias("size_b")), "b")
    return pairs.withColumn("containment", F.col("shared") / F.least("size_a", "size_b")).where(F.col("containment") >= least)


def components(edges: DataFrame) -> DataFrame:
    """DOM-04: node and root (the smallest node) of all nodes of edges (a, b), by alternating large and small stars: rounds
    grow with the logarithm of a component's width, and no node's neighbours are gathered."""
    stars, at = written_to(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "stars")
    while True:
        ends = stars.select("node", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(stars.select("root", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
        if loose.isEmpty():  # each node has one root, and no root has one
            return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
        both = stars.unionAll(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.where("root > node").join(low, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root")).unionAll(least.select("node", F.col("low").alias("root"))).where("node <> root").distinct()
        stars, new = written_to(small, "stars")
        discarded(at)
        at = new


def greedy_cover(members: DataFrame, clusters: DataFrame, rank: DataFrame) -> DataFrame:
    """DOM-04, WIN-06: members (set, key), clusters (node, root), rank (set, rank: larger is better, without ties). In each
    cluster, best first, a set stays if it is the first or has a key that those before it lack. A set's keys count
    by the best set of the cluster that has them; a set stays exactly if some key's best holder is that set, so
    no cluster's sets are gathered. coverage: the share of its keys in sets that stay before it."""
    own = members.join(clusters.select(F.col("node").alias("set"), "root"), "set").join(rank, "set")
    best = own.groupBy("root", "key").agg(F.max(F.struct("rank", "set")).alias("best"))
    held = own.join(best, ["root", "key"]).withColumn("first", F.col("set") == F.col("best.set"))
    sets = held.groupBy("root", "set").agg(F.max("rank").alias("rank"), F.count("*").alias("size"), F.count_if("first").alias("own"))
    top = sets.groupBy("root").agg(F.max(F.struct("rank", "set")).alias("top")).select("root", F.col("top.set").alias("keeper"))
    out = sets.join(top, "root").withColumn("role", F.when((F.col("own") > 0) | (F.col("set") == F.col("keeper")), "keep").otherwise("drop"))
    return out.select("root", "set", "keeper", "role", F.round((F.col("size") - F.col("own")) / F.col("size"), 3).alias("coverage"))


def cluster_groups(cover: DataFrame, sets: DataFrame, margin: float = 0.2) -> DataFrame:
    """DOM-04: one row for each cluster: keeper, action (review where a kept set overlaps others), what dropping frees, and the first dropped set, best first, whose share of
    verified files is above the keeper's by more than margin: its tags are carried over. sets (set, bytes, verified: share, rank)."""
    own = cover.join(sets, "set")
    partial = F.max((F.col("role") == "keep") & (F.col("coverage") > 0))
    keeper = F.max(F.when(F.col("set") == F.col("keeper"), F.col("verified")))
    out = own.groupBy("root", "keeper").agg(F.count("*").alias("members"), F.when(partial, "review").otherwise("auto").alias("action"), F.sum(F.when(F.col("role") == "drop", F.col("bytes")).otherwise(0)).alias("reclaimable"), keeper.alias("kept"))
    better = own.join(out.select("root", "kept"), "root").where((F.col("role") == "drop") & (F.col("verified") > F.col("kept") + margin)).groupBy("root").agg(F.max_by("set", "rank").alias("carry"))
    return out.drop("kept").join(better, "root", "left")


def examples(groups: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """DOM-08: groups (tier, group, reclaimable), members (group, path, role): the groups of each tier that free most, with their members."""
    place = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("reclaimable"), "group"))
    best = groups.withColumn("k", place).where(F.col("k") <= top)
    return best.join(members, "group").select("tier", "group", "reclaimable", "k", "path", "role")


def edition_pairs(pairs: DataFrame, release: DataFrame, rank: DataFrame) -> DataFrame:
    """DOM-05: containment pairs of different known releases; always for review. release (set, release), rank (set, rank)."""
    info = release.join(rank, "set")
    side = lambda s: info.select(F.col("set").alias(s), F.col("release").alias(f"release_{s}"), F.col("rank").alias(f"rank_{s}"))
    two = pairs.join(side("a"), "a").join(side("b"), "b").where("release_a <> release_b")
    first = F.col("rank_a") > F.col("rank_b")
    return two.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keeper"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.round(F.col("shared") / F.when(first, F.col("size_b")).otherwise(F.col("size_a")), 3).alias("coverage"))


def identical_groups(files: DataFrame, handled: DataFrame) -> DataFrame:
    """DOM-06: files (id, digest, bytes, order: smaller is better); handled (id): those in clusters. Digests of several
    files, not all of them handled: keeper, copies, bytes freed. Files without a digest are no copies."""
    own = files.where("digest is not null").join(handled.select("id", F.lit(True).alias("handled")), "id", "left")
    out = own.groupBy("digest").agg(F.min_by("id", "order").alias("keeper"), F.count("*").alias("copies"), (F.sum("bytes") - F.min_by("bytes", "order")).alias("reclaimable"), F.bool_and(F.coalesce("handled", F.lit(False))).alias("all_handled"))
    return out.where("copies > 1 and not all_handled").drop("all_handled")


def second_copies(rows: DataFrame, group: list[str], order: list[Column], measure: str, least_gap: float, gone: DataFrame | None = None) -> DataFrame:
    """DOM-07: in each group the best row keeps; others whose measure is under least_gap from the keeper's are copies. Rows in gone (id), dropped before, don't
    count. action: review if the numbers of the keeper and the copies differ (number; null is none), else auto. A null measure counts as 0."""
    left = rows if gone is None else rows.join(gone.select("id"), "id", "left_anti")
    by = Window.partitionBy(*group).orderBy(*order)
    m = F.coalesce(F.col(measure), F.lit(0.0))
    out = left.withColumns({"place": F.row_number().over(by), "gap": F.abs(m - F.first(m).over(by))}).where((F.col("place") == 1) | (F.col("gap") < least_gap))
    whole = Window.partitionBy(*group)
    differ = F.min("number").over(whole) < F.max("number").over(whole)
    return out.withColumn("action", F.when(F.coalesce(differ, F.lit(False)), "review").otherwise("auto")).where("place > 1")


def exact_groups(rows: DataFrame, digest: Column, size: Column) -> DataFrame:
    """AGG-04, AGG-05: digests of several rows: copies, and bytes wasted beyond the largest."""
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("copies"), (F.sum(size) - F.max(size)).alias("waste")).where("copies > 1")
