"""A stored table whose readers see whole changes only: parts by key, and one small manifest for each version (SNK-01, SNK-10, STM-01).

Rows lie in BUCKETS parts by a hash of their key. A change writes the parts that it touches to a new folder and then one manifest, which names the folder of each
part; the manifest appears under its number at once or not at all, and no number is given twice. Readers take the newest manifest,
so what a change that failed has left behind is never read. A change may carry a number of its own, such as that of a stream's batch: one that the table has taken
before is left out. Two writers can't both make one version: the second gets FileExistsError and begins again from the newer one.

Manifests are read and written with pyarrow.fs. On local folders a number is taken by a hard link, and by a rename that refuses to replace on HDFS; on object stores,
which know neither, let one writer at a time change a table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
_PART = "_part"


class Versions:
    """The table at a folder, with a key column and the schema of its rows."""

    def __init__(self, spark: SparkSession, at: str, key: str, schema: str | StructType, buckets: int = BUCKETS):
        self.spark, self.at, self.key, self.schema, self.buckets = spark, at.rstrip("/"), key, schema, buckets
        uri = self.at if "://" in self.at else "file://" + self.at.removeprefix("file:")
        self.files, self.top = fs.FileSystem.from_uri(uri)
        self.files.create_dir(f"{self.top}/manifests", recursive=True)

    def manifest(self) -> dict:
        """The newest: version, change (the largest number taken) and parts, the folder of each."""
        found = [x.path for x in self.files.get_file_info(fs.FileSelector(f"{self.top}/manifests")) if x.base_name.endswith(".json") and not x.base_name.startswith(".")]
        if not found:
            return {"version": 0, "change": None, "parts": {}}
        with self.files.open_input_stream(max(found)) as file:
            return json.loads(file.read())

    def read(self, manifest: dict | None = None, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        held = (manifest or self.manifest())["parts"]
        folders = [f"{self.at}/{folder}/{_PART}={p}" for p, folder in held.items() if parts is None or int(p) in parts]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def change(self, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None, bad: Column | None = None, whole: bool = False) -> bool:
        """Replaces the parts that rows touch, or all of them (whole), by merged(their old rows, rows); False if the number was taken before. If one of rows is bad,
        nothing changes and ValueError names some: they are checked as they were staged, not computed anew."""
        old = self.manifest()
        if number is not None and old["change"] is not None and number <= old["change"]:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_PART, self.part())
        dealt.write.parquet(f"{self.at}/{folder}/new")
        staged = self.spark.read.schema(dealt.schema).parquet(f"{self.at}/{folder}/new")
        if bad is not None:
            some = staged.where(bad).drop(_PART).limit(5).collect()
            if some:
                raise ValueError(f"nothing written; among the bad rows: {some}")
        touched = list(range(self.buckets)) if whole else [r[0] for r in staged.select(_PART).distinct().collect()]  # as many as there are parts
        new = merged(self.read(old, touched), staged.drop(_PART))
        new.withColumn(_PART, self.part()).repartition(_PART).write.partitionBy(_PART).parquet(f"{self.at}/{folder}/rows")
        made = self.files.get_file_info(fs.FileSelector(f"{self.top}/{folder}/rows"))
        there = sorted(int(x.base_name.split("=")[1]) for x in made if x.base_name.startswith(f"{_PART}="))
        old["parts"] = {p: f for p, f in old["parts"].items() if int(p) not in touched} | {str(p): f"{folder}/rows" for p in there}
        self._put({"version": old["version"] + 1, "change": number if number is not None else old["change"], "parts": old["parts"]})
        return True

    def _put(self, manifest: dict) -> None:
        name, hidden = f"{self.top}/manifests/{manifest['version']:020d}.json", f"{self.top}/manifests/.{uuid.uuid4().hex}.json"
        with self.files.open_output_stream(hidden) as file:
            file.write(json.dumps(manifest).encode())
        if isinstance(self.files, fs.LocalFileSystem):
            os.link(hidden, name)  # fails if the version is there
            os.unlink(hidden)
        elif self.files.get_file_info(name).type != fs.FileType.NotFound:
            raise FileExistsError(name)
        else:
            self.files.move(hidden, name)
