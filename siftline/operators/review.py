"""Kinds, suggestions and standing rules of the review queue (FLT-07, SRT-02, DOM-19 to DOM-29, SET-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr

#: Penalties that don't question which release it is; limits of the standing rules.
COSMETIC = ["artist", "album", "year", "country", "media", "label", "catalognum", "albumdisambig", "albumstatus", "mediums", "tracks", "track_title", "track_artist"]
STRUCTURAL_ALLOWED = [*COSMETIC, "missing_tracks", "unmatched_tracks"]
MAX_DISTANCE, MIN_GAP, MIN_CONFIRMED, MAX_MISMATCH, MAX_MISSING, MAX_EXTRA, PLAUSIBLE = 0.1, 0.15, 0.9, 1, 1, 2, 0.35
EXACT_DISTANCE, EXACT_GAP = 0.2, 0.3


def kind(action: Column, in_dupe: Column, distance: Column) -> Column:
    """FLT-07."""
    return F.when(action == "error", "error").when(action != "review", F.lit(None)).when(in_dupe, "dupe").when(distance < 0.1, "close").when(distance < 0.5, "weak").otherwise("none")


def only(values: Column, allowed: list[str]) -> Column:
    """SET-04."""
    return F.size(F.array_except(values, F.array(*map(F.lit, allowed)))) == 0


def failures(checks: list[tuple[Column, Column]]) -> Column:
    """The reasons of checks that fail, joined; '' if all hold."""
    return F.array_join(F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), why) for ok, why in checks)), lambda x: x.isNotNull()), "; ")


def rival_fits(distance: Column, extra: Column, missing: Column) -> Column:
    """DOM-23: whether the next candidate is near enough to be asked about, and has just the album's files."""
    return F.coalesce((distance < PLAUSIBLE) & (extra == 0) & (missing == 0), F.lit(False))


def close_rule(distance: Column, gap: Column, confirmed: Column, files: Column, mismatch: Column, missing: Column, extra: Column, penalties: Column, rival: Column, bad_file: Column) -> Column:
    """DOM-23: why a close call doesn't qualify, as codes with the values that speak against it; rival: of rival_fits()."""
    foreign = F.array_sort(F.array_except(penalties, F.array(*map(F.lit, STRUCTURAL_ALLOWED))))
    return failures([
        (distance < MAX_DISTANCE, F.format_string("distance=%.3f", distance)),
        (gap >= MIN_GAP, F.format_string("gap=%.2f", gap)),
        (F.try_divide(confirmed.cast("double"), F.greatest(files, F.lit(1))) >= MIN_CONFIRMED, F.format_string("confirmed=%d/%d", confirmed, F.greatest(files, F.lit(1)))),
        (mismatch <= MAX_MISMATCH, F.format_string("mismatch=%d", mismatch)),
        (missing <= MAX_MISSING, F.format_string("missing=%d", missing)),
        (extra <= MAX_EXTRA, F.format_string("extra=%d", extra)),
        (F.size(foreign) == 0, F.concat(F.lit("penalties="), F.array_join(foreign, ","))),
        (~(rival & ((missing > 0) | (extra > 0))), F.lit("rival")),
        (~bad_file, F.lit("bad_file")),
    ])


def exact_rule(distance: Column, gap: Column, mismatch: Column, missing: Column, extra: Column, penalties: Column, bad_file: Column) -> Column:
    """DOM-24: the name of the rule for exact fits that holds, or null."""
    holds = (distance < EXACT_DISTANCE) & (missing == 0) & (extra == 0) & (gap >= EXACT_GAP) & (mismatch == 0) & only(penalties, COSMETIC) & ~bad_file
    return F.when(holds, F.when(distance < MAX_DISTANCE, "D22").otherwise("D26"))


def approval(rule: Column, distance: Column, gap: Column, confirmed: Column, files: Column, missing: Column, extra: Column) -> Column:
    """DOM-23, DOM-24: the rule that approves with the facts that it rests on; null without one."""
    return F.when(rule.isNotNull(), F.concat(rule, F.format_string(" distance=%.3f gap=%.2f confirmed=%d/%d missing=%d extra=%d", distance, gap, confirmed, files, missing, extra)))


def no_candidate_rule(distance: Column, in_library: Column, has_video: Column, local_title: Column, titles: Column) -> Column:
    """DOM-25: why an unmatched album doesn't go on as it is, as codes, or ''. Titles are normal ones; no candidate at all is as far as can be."""
    same = F.exists(titles, lambda t: (local_title != "") & (t != "") & (expr.titles_agree(local_title, t) | expr.whole_words(local_title, t) | expr.whole_words(t, local_title)))
    return failures([(F.coalesce(distance, F.lit(1.0)) >= 0.5, F.lit("near_candidate")), (~in_library, F.lit("in_library")), (~has_video, F.lit("video")), (~F.coalesce(same, F.lit(False)), F.lit("same_title"))])


def decision(version_word: Column, in_library: Column, close: Column, exact: Column) -> Column:
    """DOM-26: the rule that approves, or null; the first that applies decides."""
    return F.when(version_word.isNotNull() | in_library, F.lit(None)).when(close == "", "D21").otherwise(exact)


def suggestion(kind: Column, candidates: Column, gap: Column, penalties: Column, extra: Column, missing: Column) -> Column:
    """DOM-19: where to begin."""
    clear = (kind == "close") & (gap >= MIN_GAP) & only(penalties, COSMETIC) & (extra == 0) & (missing == 0)
    return F.when(kind == "none", "asis").when(kind == "error", "skip").when(candidates == 0, "asis").when(clear, "approve").otherwise("look")


def page(queue: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """SRT-02."""
    return queue.orderBy(*order).offset(offset).limit(limit)


def unknown_keys(decisions: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """DOM-28: decisions about nothing; a batch with any is refused whole."""
    return decisions.join(queue.select(key), key, "left_anti")


#: What may be decided.
DECISIONS = ["approve", "asis", "skip"]


def judged(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """DOM-28: decisions (key, decision, choice, reason) beside the queue (key, candidate, imported), with the chosen candidate and `fault`: the first that
    speaks against it, or null: kind, unknown, imported, no_choice, no_reason; repeated marks several decisions of one key."""
    again = decisions.groupBy("key").agg(F.count("*").alias("times"))
    both = decisions.join(again, "key", "left").join(queue.withColumn("there", F.lit(True)), "key", "left")
    choice = F.coalesce(F.nullif("choice", F.lit("")), F.when(F.col("decision") == "approve", F.col("candidate")))
    unsure = (F.col("decision") == "approve") & (F.coalesce(choice, F.lit("")) == "")
    fault = F.when(~F.coalesce(F.col("decision").isin(DECISIONS), F.lit(False)), "kind").when(F.col("there").isNull(), "unknown").when(F.col("imported"), "imported").when(unsure, "no_choice")
    fault = fault.when(F.coalesce("reason", F.lit("")) == "", "no_reason").when(F.col("times") > 1, "repeated")
    return both.select("key", "decision", choice.alias("choice"), "reason", fault.alias("fault"))
