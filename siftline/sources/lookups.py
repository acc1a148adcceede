"""A data source that asks a service for batches of keys, from many tasks at one common rate (SRC-12, SRC-13).

    register(spark, "service", ask, "string")
    spark.read.format("service").option("keys", folder).load()

The keys are a Parquet folder with the columns slot (int, 0 to slots - 1) and key; dealt() writes one. Each slot is a task. With one request allowed in every `interval` seconds,
a task makes one in every slots * interval, the first after slot * interval, and waits as long before a retry at least, so all tasks together never make more, whether
they run at once or not. ask(keys) gives an answer for each key, in their order; anything else, and any exception, is a fault: the batch is asked again after waits that
double, `tries` times in all, and then its keys carry the error. Refused says that no further request can go well (a key that isn't valid): it ends the read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from siftline.operators import dedupe
from siftline.sources.readers import opened


class Refused(Exception):
    """The service will answer nothing more."""


class Slot(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class Reader(DataSourceReader):
    def __init__(self, ask: Callable[[list], list], schema: pa.Schema, options: dict[str, str]):
        self.ask, self.schema, self.keys = ask, schema, options["keys"]
        self.slots, self.batch, self.tries = (int(options.get(k, d)) for k, d in (("slots", 1), ("batch", 10), ("tries", 4)))
        self.interval, self.wait = float(options.get("interval", 0.4)), float(options.get("wait", 1.0))

    def partitions(self) -> list[Slot]:
        return [Slot(k) for k in range(self.slots)]

    def read(self, partition: Slot) -> Iterator[pa.RecordBatch]:
        system, at = opened(self.keys)
        files = [x.path for x in system.get_file_info(pa.fs.FileSelector(at)) if x.path.endswith(".parquet")]
        own = pa.dataset.dataset(files, filesystem=system, format="parquet").scanner(columns=["key"], filter=pa.dataset.field("slot") == partition.number, batch_size=self.batch) if files else None
        turn = time.monotonic() + partition.number * self.interval
        held: list = []
        for found in own.to_batches() if own else ():
            held += found.column(0).to_pylist()
            while len(held) >= self.batch:
                made, turn = self._answered(held[: self.batch], turn)
                held = held[self.batch :]
                yield made
        if held:
            yield self._answered(held, turn)[0]

    def _answered(self, keys: list, turn: float) -> tuple[pa.RecordBatch, float]:
        """A batch's answers or error, and when the next request may be made."""
        answers, why = [None] * len(keys), None
        for attempt in range(self.tries):
            time.sleep(max(0.0, turn - time.monotonic()))
            turn = time.monotonic() + self.slots * self.interval
            try:
                found = self.ask(keys)
                if len(found) != len(keys):
                    raise ValueError(f"{len(found)} answers to {len(keys)} keys")
                answers, why = pa.array(found, self.schema.field("answer").type), None
                break
            except Refused:
                raise
            except Exception as fault:  # whatever a service does becomes a row
                why = f"{type(fault).__name__}: {fault}"[:300]
                turn = max(turn, time.monotonic() + self.wait * 2**attempt)
        columns = [keys, answers, [why] * len(keys)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema), turn


def register(spark: SparkSession, name: str, ask: Callable[[list], list], answer: str, key: str = "string") -> None:
    """Makes a service a data source of that name with the columns key, answer (of the type `answer`) and error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(f"key {key}, answer {answer}, error string")
    arrow = to_arrow_schema(fields)

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return fields

        def reader(self, schema: StructType) -> Reader:
            return Reader(ask, arrow, dict(self.options))

    spark.dataSource.register(Service)


def dealt(keys: DataFrame, slots: int) -> str:
    """Writes distinct keys (one column) with a slot for each, and gives their folder."""
    at = dedupe.shared_folder(keys.sparkSession, "keys")
    one = keys.select(F.col(keys.columns[0]).alias("key")).where("key is not null").distinct()
    one.select(F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"), "key").write.parquet(at)
    return at


def looked_up(keys: DataFrame, name: str, *, slots: int = 4, **options: float) -> DataFrame:
    """SRC-12, SRC-13: key, answer and error of each distinct key, by the registered source of that name. Reading it again asks again, so write it."""
    reader = keys.sparkSession.read.format(name).option("keys", dealt(keys, slots)).option("slots", slots)
    for option, value in options.items():
        reader = reader.option(option, value)
    return reader.load()
