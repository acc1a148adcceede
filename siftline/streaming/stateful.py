"""Runs as keyed state on streams: what the run before had, quiet folders, steps, locks held too long (STM-01, STM-03 to STM-07).

State lies in the RocksDB store of each partition; a key's state is read when rows of the key arrive or a timer of it ends, so a batch
costs what it brings, not what is known. Each stream has a batch form that gives the same rows; tests hold the two side by side.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from siftline.streaming import streams

#: Fixed value: hours that a lock may be held.
BUSY_HOURS = 3
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as list states, timers and expiry need it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def run_all(rows: DataFrame, at: str) -> None:
    """Takes the stream through all that is there, to Parquet at `at`/out; what was taken before, by the checkpoint in `at`/state, isn't taken again."""
    with rocks(rows.sparkSession):
        rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()


def told(rows: DataFrame, at: str) -> DataFrame:
    """All that run_all() has written."""
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/out")


def baseline(spark: SparkSession, at: str, first: int) -> int:
    """The first run that a stream knows of, of which nothing is told: written beside its checkpoint once, read ever after."""
    spark.sql(f"SELECT {int(first)}L AS run").write.mode("ignore").parquet(f"{at}/first")
    return spark.read.parquet(f"{at}/first").first()["run"]


class _Before(StatefulProcessor):
    """A value state: the key's last run and its value there; a timer in runs clears what later runs lack."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"run long, value {self.kind}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r.run):
            if held is None or row.run > held[0]:  # a run that comes again has been seen
                old = held[1] if held and held[0] == row.run - 1 else None
                held = (row.run, row.value)
                yield Row(run=row.run, key=key[0], value=row.value, old=old)
        if held:
            self.last.update(tuple(held))
            self.handle.registerTimer(1000 * (held[0] + 3))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and 1000 * (self.last.get()[0] + 3) <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())


def before_stream(rows: DataFrame) -> DataFrame:
    """STM-04 to STM-06: rows (run, key, value), one for each run and key, runs numbered without gaps: with `old`, the value in the run before, null if
    it lacks the key. Runs are the stream's time, a second each (run 0 is second 1, as nothing is in time at 0): what a run lacks is forgotten, as its state counts for the next run only, and its
    state leaves the store when the watermark, one run behind, has passed that. A run may come in several batches, until one two runs later has come."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    timed = rows.select(F.col("run").cast("long"), "key", "value", F.timestamp_seconds(F.col("run").cast("long") + 1).alias("at")).withWatermark("at", "1 second")
    return timed.groupBy("key").transformWithState(_Before(kind["value"]), f"run long, key {kind['key']}, value {kind['value']}, old {kind['value']}", "Append", "EventTime")


def before(rows: DataFrame) -> DataFrame:
    """The batch form of before_stream()."""
    own = Window.partitionBy("key").orderBy("run")
    return rows.withColumn("old", F.when(F.lag("run").over(own) == F.col("run") - 1, F.lag("value").over(own)))


def new_since(rows: DataFrame, first: int) -> DataFrame:
    """STM-04: of before() or before_stream(): keys that wait now and didn't before; nothing of the first run."""
    return rows.where(F.col("old").isNull() & (F.col("run") > first))


def grown_since(rows: DataFrame, first: int) -> DataFrame:
    """STM-05: counters above the run before, where a missing one counts as 0: a fall isn't told, a rise after it is."""
    return rows.where((F.col("value") > F.coalesce("old", F.lit(0))) & (F.col("run") > first))


def changed_since(rows: DataFrame) -> DataFrame:
    """STM-06: digests that are new or changed, from the first run on."""
    return rows.where(~F.col("old").eqNullSafe(F.col("value")))


def _packed(rows: Iterable[tuple[int, bool]]) -> tuple[bytes]:
    """Times with a mark each as one value of a list state: the store takes and gives a key's rows of a batch as one, not each by itself."""
    return (array("q", [2 * at + bool(mark) for at, mark in rows]).tobytes(),)


def _unpacked(values: Iterable[tuple[bytes]]) -> list[tuple[int, bool]]:
    """What several _packed() values hold, by time, rows without the mark first."""
    held = array("q")
    for value in values:
        held.frombytes(bytes(value[0]))
    return [(x >> 1, bool(x & 1)) for x in sorted(held)]


class _Quiet(StatefulProcessor):
    """A list state of the folder's changes that no batch has, a value state of how many batches it has had, and a timer no later than the end of the first stretch that
    waits. A batch of rows is one call to the store and one timer, however many rows it has."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getListState("changes", "packed binary")
        self.batches = handle.getValueState("batches", "n long")

    def _stretches(self, changes: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for change in changes:
            if not out or change[0] - out[-1][-1][0] >= self.gap:
                out.append([])
            out[-1].append(change)
        return out

    def _wake(self, stretch: list[tuple]) -> None:
        self.handle.registerTimer(-(-(stretch[-1][0] + self.gap) // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = _packed((row.at, row.counts) for row in rows)
        self.changes.appendValue(new)
        self._wake(self._stretches(_unpacked([new]))[0])  # what waits already has its timer, and new rows end no stretch before this
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        now, left = 1000 * timerValues.getCurrentWatermarkInMs(), []
        waiting = self._stretches(_unpacked(self.changes.get()))
        if not waiting:  # an earlier timer has told all
            return
        had = self.batches.get()
        n = before = had[0] if had else 0
        for stretch in waiting:
            if stretch[-1][0] + self.gap > now:
                if not left:
                    self._wake(stretch)
                left += stretch
                continue
            counted = sum(c for _, c in stretch)
            if counted:  # without such a file the folder isn't claimed
                n += 1
                yield Row(folder=key[0], batch=n, first=stretch[0][0], last=stretch[-1][0], changes=len(stretch), files=counted)
        if n > before:
            self.batches.update((n,))
        self.changes.put([_packed(left)]) if left else self.changes.clear()


def claims_stream(rows: DataFrame, minutes: int, late: str = "0 seconds") -> DataFrame:
    """STM-03, STM-02: rows (folder, ts, counts): batches of a folder's changes, claimed once nothing has changed for so many minutes of event time, if any of the
    changed files counts. folder, batch (from 1), first and last (microseconds), changes, files. Told when the watermark passes, without a further change."""
    kind = rows.schema["folder"].dataType.simpleString()
    timed = rows.select("folder", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("counts", F.lit(False)).alias("counts"))
    return timed.withWatermark("ts", late).groupBy("folder").transformWithState(_Quiet(minutes * 60_000_000), f"folder {kind}, batch long, first long, last long, changes long, files long", "Append", "EventTime")


def claims(rows: DataFrame, minutes: int) -> DataFrame:
    """The batch form of claims_stream(): stretches that end so long before the last change of all."""
    at = rows.select("folder", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("counts", F.lit(False)).alias("counts"))
    gap, order = minutes * 60_000_000, Window.partitionBy("folder").orderBy("at")
    marked = at.withColumn("fresh", F.coalesce(F.col("at") - F.lag("at").over(order) >= gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("stretch", F.sum("fresh").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    made = numbered.groupBy("folder", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("changes"), F.count_if("counts").alias("files"))
    done = made.where((F.col("files") > 0) & (F.col("last") + gap < at.agg(F.max("at")).scalar()))
    return done.select("folder", F.row_number().over(Window.partitionBy("folder").orderBy("first")).cast("long").alias("batch"), "first", "last", "changes", "files")


class _Steps(StatefulProcessor):
    """A value state: how far a batch is."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "step int, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        step, seen = self.at.get() if self.at.exists() else (0, None)
        for row in sorted(rows, key=lambda r: r.run):
            if seen is not None and row.run <= seen:
                continue
            seen, now = row.run, min(step + bool(row.well), len(self.names) - 1)
            if now > step:
                yield Row(batch=key[0], run=row.run, was=self.names[step], status=self.names[now])
            step = now
        self.at.update((step, seen))


def steps_stream(rows: DataFrame, names: list[str] = streams.PIPELINE) -> DataFrame:
    """STM-03: rows (batch, run, well), at most one for each: a run that goes well takes a batch to its next step, a fault leaves it where a later run takes it up
    again, the last step stays. batch, run, was and status for each step taken."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    return rows.select("batch", F.col("run").cast("long"), "well").groupBy("batch").transformWithState(_Steps(names), f"batch {kind['batch']}, run long, was string, status string", "Append", "None")


def steps(rows: DataFrame, names: list[str] = streams.PIPELINE) -> DataFrame:
    """The batch form of steps_stream()."""
    done = F.sum(F.col("well").cast("int")).over(Window.partitionBy("batch").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), k.cast("int"))
    return rows.withColumn("done", done).where(F.col("well") & (F.col("done") < len(names))).select("batch", F.col("run").cast("long"), name(F.col("done")).alias("was"), name(F.col("done") + 1).alias("status"))


class _Held(StatefulProcessor):
    """A list state of sightings that the watermark hasn't passed, a value state of since when the lock is held, and timers for the first of both. A batch of rows is one
    call to the store and one timer, however many rows it has."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "packed binary")
        self.held = handle.getValueState("held", "since long, told boolean")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(row.at, not row.busy) for row in rows]
        self.ahead.appendValue(_packed(new))
        self._wake(min(at for at, _ in new))  # its turn comes when no earlier one can; those behind it are looked at then
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        old = self.held.get()
        since, done = old or (None, False)
        ahead = _unpacked(self.ahead.get())
        left = [r for r in ahead if r[0] > now]
        for at, free in ahead[: len(ahead) - len(left)]:
            if not free:
                if since is None:
                    since, done = at, False
            else:
                if since is not None and not done and at > since + self.longest:
                    yield Row(key=key[0], since=since, told=since + self.longest)
                since, done = None, False
        if since is not None and not done:
            if since + self.longest <= now:
                done = True
                yield Row(key=key[0], since=since, told=since + self.longest)
            else:
                self._wake(since + self.longest)
        if left:
            self._wake(left[0][0])
        if since is not None:
            self.held.update((since, done))
        elif old:
            self.held.clear()
        if len(left) < len(ahead):
            self.ahead.put([_packed(left)]) if left else self.ahead.clear()


def held_stream(rows: DataFrame, hours: int = BUSY_HOURS, late: str = "0 seconds") -> DataFrame:
    """STM-07: rows (key, ts, busy): locks held for so many hours of event time, told once for each time, by a timer: no further sighting is needed. key, since and told
    (microseconds). Of sightings at one time one that is free counts."""
    kind = rows.schema["key"].dataType.simpleString()
    timed = rows.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "busy")
    return timed.withWatermark("ts", late).groupBy("key").transformWithState(_Held(hours * 3_600_000_000), f"key {kind}, since long, told long", "Append", "EventTime")


def held(rows: DataFrame, hours: int = BUSY_HOURS) -> DataFrame:
    """The batch form of held_stream(): what it has told when the last sighting of all is its watermark."""
    at = rows.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "busy").groupBy("key", "at").agg(F.min("busy").alias("busy"))
    order, longest = Window.partitionBy("key").orderBy("at"), hours * 3_600_000_000
    freed = F.sum((~F.col("busy")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    until = F.min(F.when(~F.col("busy"), F.col("at"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    stretches = at.withColumns({"stretch": freed, "until": until}).where("busy").groupBy("key", "stretch").agg(F.min("at").alias("since"), F.min("until").alias("until"))
    last, end = F.col("since") + longest, at.agg(F.max("at")).scalar()
    return stretches.where((F.coalesce("until", F.lit(end)) > last) & (last < end)).select("key", "since", last.alias("told"))


def rescans(listings: DataFrame, take: Callable[[DataFrame, int], None], at: str) -> None:
    """STM-01: each batch of a stream of listings to take(rows, batch), with the checkpoint in `at`; take must be idempotent for each batch number, as a batch comes
    again after a fault."""
    listings.writeStream.foreachBatch(take).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def changed(old: list[Column], new: list[Column]) -> Column:
    """Whether any of the new values differs from the old one."""
    out = F.lit(False)
    for a, b in zip(old, new, strict=True):
        out = out | ~a.eqNullSafe(b)
    return out
