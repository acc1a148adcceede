"""Verdicts on labels from independent evidence (DOM-01, DOM-02, DOM-66, DOM-78, DOM-79)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr

LEAST_SCORE = 0.8


def verdict(tag: Column, status: Column, recordings: Column, title: Column | None = None, titles: Column | None = None, least: float = LEAST_SCORE) -> Column:
    """DOM-01: recordings is an array of (id, score); titles, if given, a map from id to normal title."""
    ids = F.transform(F.filter(F.coalesce(recordings, F.array().cast("array<struct<id:string,score:double>>")), lambda r: r.score >= least), lambda r: r.id)
    other = F.lit(False) if titles is None else F.coalesce(F.exists(ids, lambda i: expr.titles_agree(title, F.try_element_at(titles, i))), F.lit(False))
    tagged = F.when(F.array_contains(ids, tag), "confirmed").when(F.size(ids) == 0, "unverifiable").when(other, "alt_recording").otherwise("mismatch")
    return F.when(status.isNull(), "no_lookup").when(expr.filled(tag), tagged).when(F.size(ids) > 0, "suggest").otherwise("unknown")


def suspects(verdicts: DataFrame, by: str, tag: str) -> DataFrame:
    """DOM-66, AGG-07 to AGG-09: groups where mismatches and repeated tags are half of the rows at least."""
    out = verdicts.groupBy(by).agg(F.count("*").alias("files"), F.count_if(F.col("verdict") == "mismatch").alias("mismatches"), (F.count(tag) - F.count_distinct(tag)).alias("repeats"))
    return out.where("mismatches > 0 or repeats > 0").where("2 * (mismatches + repeats) >= files")


def parsed(results: Column) -> Column:
    """DOM-79, SET-07: results: array of (id, score, recordings: array of id), best first; each recording once, at its best."""
    best = F.array_sort(results, lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).otherwise(0))
    every = F.flatten(F.transform(best, lambda r: F.transform(r.recordings, lambda i: F.struct(i.alias("id"), r.score.alias("score"), r.id.alias("audio_id")))))
    ids = F.array_distinct(F.transform(every, lambda x: x.id))
    return F.transform(ids, lambda i: F.filter(every, lambda x: x.id == i)[0])


def lookup_queue(files: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """DOM-78, JOIN-06, SET-06: distinct keys not looked up yet."""
    return files.select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct().join(known.select(*keys), keys, "left_anti")


def recomputed(old: DataFrame, root: str, fresh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """DOM-02: rows (path, ...) below root made anew by fresh(), the others as they were."""
    inside = F.coalesce(expr.inside(F.col("path"), root), F.lit(False))
    return old.where(~inside).unionByName(fresh(old.where(inside)))
