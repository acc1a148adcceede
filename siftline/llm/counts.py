"""Token counts of flat token files by a scan for separators.

A token file is nothing but ids, of 16 bits if all of the vocabulary and the separator fit, else of 32, as its
name's end says; each document's are followed by an end-of-document id. A scan cuts files
into blocks, reads each by its range and finds the separators in bulk; a block knows how many it has and
where the first and last stand. Documents that cross blocks are stitched by a prefix scan: the number of
separators before a block, and the place of the last of them, first over groups of blocks and then inside each. Both joins are merge
joins, as all their sides grow with the input.

The writer lists which document is the how-manieth of which file beside the files; the counts join that list. Null
and empty texts have no tokens. Repeated ids are counted row by row. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import bpe, flat, shared, warc

SEPARATOR = 50256
BLOCK = 1 << 20  # ids
GROUP = 1024  # blocks
FILE = 1 << 26  # ids, after which a task begins another file


def write(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, separator: int = SEPARATOR, file_ids: int = FILE) -> None:
    """Writes token files and their lists into a shared folder. Only files that are listed count."""
    encoder = bpe.Encoder.load(path)
    if separator in encoder.token:
        raise ValueError(f"{separator} is a token of the vocabulary")
    encoders = docs.sparkSession.sparkContext.broadcast(encoder)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    short = max(separator, *encoder.token) < 1 << 16
    width, end = 2 if short else 4, np.array([separator], np.uint16 if short else np.int32).tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = bpe.memo(encoders, bpe._short if width == 2 else bpe._packed)
        fs, top = warc.open_folder(folder)
        fs.create_dir(top, recursive=True)
        name = sink = None
        n = size = 0
        for batch in batches:
            names, places = [], []
            for ids in bpe.packed_rows(found, *flat.flat(batch.column(1))):
                if sink is None:
                    name, n, size = f"{uuid.uuid4().hex}.u{8 * width}", 0, 0
                    sink = fs.open_output_stream(f"{top}/{name}")
                sink.write(ids + end)
                names.append(name)
                places.append(n)
                n, size = n + 1, size + len(ids) // width + 1
                if size >= file_ids:
                    sink.close()
                    sink = None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(places, pa.int64())], ["doc_id", "file", "place"])
        if sink is not None:
            sink.close()

    docs.mapInArrow(put, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file string, place long").write.parquet(f"{folder}/list")


def width_of(name: str) -> int:
    """Bytes of an id in a file."""
    return 2 if name.endswith(".u16") else 4


def blocks(spark: SparkSession, folder: str, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, block, start and length (ids) of the blocks of files."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = warc.open_folder(folder)
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.size // width_of(i.path) for i in fs.get_file_info([f"{top}/{x}" for x in own])], pa.int64())], ["file", "ids"])

    cut = names.select("file").mapInArrow(sizes, "file string, ids long").where("ids > 0")
    cut = cut.select("file", "ids", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(block).cast("long"))).alias("block", "start"))
    return cut.select("file", F.col("block").cast("long"), "start", F.least(F.lit(block), F.col("ids") - F.col("start")).alias("length"))


def scan(spark: SparkSession, folder: str, names: DataFrame, *, separator: int = SEPARATOR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """file, place (from 0) and n_tokens of each document in files, without any index."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = warc.open_folder(folder)
        for batch in batches:
            ends = []
            for name, start, length in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                width = width_of(name)
                with fs.open_input_file(f"{top}/{name}") as file:
                    ids = np.frombuffer(file.read_at(width * length, width * start), f"<u{width}")
                ends.append((np.flatnonzero(ids == separator) + start).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "ends"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = blocks(spark, folder, names, block).repartition(tasks, "file", "block").mapInArrow(find, "file string, block long, ends array<long>")
    found = found.withColumns({"group": F.floor(F.col("block") / group), "n": F.size("ends").cast("long"), "last": F.try_element_at("ends", F.lit(-1))})
    before = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last0"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = found.withColumns({"n1": F.coalesce(F.sum("n").over(inside), F.lit(0)), "last1": F.coalesce(F.max("last").over(inside), F.lit(-1))})
    own = own.join(groups.hint("merge"), ["file", "group"]).select("file", (F.col("n0") + F.col("n1")).alias("first"), F.greatest("last0", "last1").alias("prior"), "ends").where("size(ends) > 0")
    lengths = F.zip_with("ends", F.concat(F.array("prior"), F.slice("ends", 1, F.size("ends") - 1)), lambda end, prior: end - prior - 1)
    return own.select("file", "first", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("place"), "n_tokens")


def count(docs: DataFrame, folder: str, **names) -> DataFrame:
    """doc_id and n_tokens of each row, by way of token files in folder."""
    spark = docs.sparkSession
    write(docs, folder, **names)
    listed = spark.read.parquet(f"{folder}/list")
    return listed.join(scan(spark, folder, listed.select("file").distinct()).hint("merge"), ["file", "place"]).select("doc_id", "n_tokens")


def op9(spark, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.folder(spark, "tokens"))
