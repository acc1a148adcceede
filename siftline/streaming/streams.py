"""Streams and runs: quiet sessions, told-once memory, grown counters, passes (STM-02 to STM-08, STM-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A batch's states in order.
PIPELINE = ["claimed", "scanned", "deduped", "matched", "imported"]


def quiet_sessions(events: DataFrame, by: str, at: str, minutes: int) -> DataFrame:
    """STM-02, batch form: runs of events without a gap of so many minutes: first, last and number."""
    order = Window.partitionBy(by).orderBy(at)
    late = F.col(at) - F.make_dt_interval(mins=F.lit(minutes))
    marked = events.withColumn("fresh", F.coalesce(F.lag(at).over(order) <= late, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("fresh").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def stream_sessions(events: DataFrame, by: str, at: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """STM-02: the same on a stream; a session ends when the watermark, the latest time less `late`, reaches its gap's end."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(by, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("first"), (F.col("w.end") - F.make_dt_interval(mins=F.lit(minutes))).alias("last"), "n")


def read_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def told_once(rows: DataFrame, key: list[str], at: str, count: Column) -> DataFrame:
    """STM-05, batch form: rows that are news: the first of a key, or one whose count is above the one before. A fall isn't told, but a rise after
    it is."""
    before = F.lag(count).over(Window.partitionBy(*key).orderBy(at))
    return rows.withColumn("news", F.when(before.isNull(), "new").when(count > before, "grew")).where("news is not null")


def _run_before(run: str, key: str) -> Column:
    """Whether the key stands in the run before too; what leaves is forgotten, so it is news when it comes back."""
    return F.coalesce(F.lag(run).over(Window.partitionBy(key).orderBy(run)) == F.col(run) - 1, F.lit(False))


def new_keys(rows: DataFrame, run: str, key: str) -> DataFrame:
    """STM-04: rows (run, key), runs numbered without gaps: keys that the run before doesn't have. Nothing is told of the first run."""
    known = _run_before(run, key)
    first = rows.agg(F.min(run)).scalar()
    return rows.select(run, key).distinct().withColumn("known", known).where(~F.col("known") & (F.col(run) > first)).drop("known")


def grown(rows: DataFrame, run: str, key: str, n: str) -> DataFrame:
    """STM-05: rows (run, key, n), one for each: by how much n is above the run before, where a missing one counts as 0. Nothing is told of the first run."""
    old = F.when(_run_before(run, key), F.lag(n).over(Window.partitionBy(key).orderBy(run))).otherwise(0)
    first = rows.agg(F.min(run)).scalar()
    return rows.withColumn("by", F.col(n) - old).where((F.col("by") > 0) & (F.col(run) > first))


def changed(rows: DataFrame, run: str, key: str, digest: str) -> DataFrame:
    """STM-06: rows (run, key, digest), one for each: keys that the run before doesn't have, or has with another digest; from the first run on."""
    old = F.when(_run_before(run, key), F.lag(digest).over(Window.partitionBy(key).orderBy(run)))
    return rows.withColumn("old", old).where(~F.col("old").eqNullSafe(F.col(digest))).drop("old")


def stuck(rows: DataFrame, by: str, at: str, busy: Column, hours: int = 3) -> DataFrame:
    """STM-07: rows of runs: the first run of each busy stretch that began so many hours before it; told once for a stretch."""
    order = Window.partitionBy(by).orderBy(at)
    free = F.sum((~busy).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("stretch", free).where(busy)
    since = held.withColumn("since", F.min(at).over(Window.partitionBy(by, "stretch")))
    late = since.where(F.col(at) - F.make_dt_interval(hours=F.lit(hours)) >= F.col("since"))
    return late.groupBy(by, "stretch").agg(F.min(at).alias("told"), F.min("since").alias("since")).drop("stretch")


def told_stream(rows: DataFrame, key: str, at: str, count: str, out_name: str = "news") -> DataFrame:
    """STM-05 on a stream, with each key's last count as state; a batch's rows of a key are gone through in their order."""

    def tell(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        own = pd.concat(list(frames)).sort_values(at)  # one key's rows of one batch
        before = own[count].shift()
        if len(own) and last is not None:
            before.iloc[0] = last
        news = own.assign(**{out_name: before.isna().map({True: "new", False: "grew"})})[(before.isna() | (own[count] > before)).values]
        if len(own):
            state.update((own[count].iloc[-1].item(),))
        yield news[[at, key, out_name]]

    kind = {c: rows.schema[c].dataType.simpleString() for c in (key, at, count)}
    return rows.select(key, at, count).groupBy(key).applyInPandasWithState(tell, f"{at} {kind[at]}, {key} {kind[key]}, {out_name} string", f"last {kind[count]}", "append", GroupStateTimeout.NoTimeout)


def resumable(batches: DataFrame) -> DataFrame:
    """STM-03: batches (batch, status, ...) that a run takes up again, with the step that is next."""
    return batches.withColumn("step", next_state(F.col("status"), F.lit(True))).where("step <> status")


def claimable(folders: DataFrame, now: Column, minutes: int) -> DataFrame:
    """STM-03: folders (folder, last change, audio) that a run claims: quiet for so many minutes, with audio, not hidden."""
    return folders.where((F.col("last") <= now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("audio") > 0) & ~F.col("folder").startswith("."))


def run_pass(batches: list, steps: list[tuple[str, Callable]]) -> list[tuple]:
    """STM-10: takes each batch through the steps; a fault ends that batch's pass only. (batch, step, error) of each that ran; error is null if it went well."""
    out = []
    for batch in batches:
        for name, step in steps:
            try:
                step(batch)
                out.append((batch, name, None))
            except Exception as fault:  # the other batches go on
                out.append((batch, name, f"{type(fault).__name__}: {fault}"[:300]))
                break
    return out


def passed(batches: DataFrame, batch: Column, steps: dict[str, Column]) -> DataFrame:
    """STM-10: steps in order, each with its fault or null: batch, step and error of each that runs; a fault ends its batch's pass."""
    ran = F.array(*(F.struct(F.lit(name).alias("step"), fault.cast("string").alias("error")) for name, fault in steps.items()))
    first = F.array_position(F.transform(ran, lambda s: s["error"].isNotNull()), True)  # 0 if none
    kept = F.slice(ran, F.lit(1), F.when(first > 0, first).otherwise(F.size(ran)).cast("int"))
    return batches.select(batch, F.inline(kept))


def next_state(state: Column, quiet: Column) -> Column:
    """STM-03: a batch's next step; it waits until it is quiet, and an imported one stays."""
    out = state
    for a, b in zip(PIPELINE, PIPELINE[1:], strict=False):
        out = F.when(state == a, F.lit(b)).otherwise(out)
    return F.when(quiet, out).otherwise(state)
