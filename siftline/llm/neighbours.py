"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional word from each of STAGES codebooks. The codebooks are fitted
on at most SAMPLE vectors: k-means on the residuals, stage by stage, then by least squares of
each codebook given the others, in turn. A beam
search finds each vector's code; the index keeps code, vector and the norm of the code's sum. A query makes a
table of its products with all words, so a row's score is STAGES look-ups and the norm. Its best SHORTLIST rows, over the whole
index, are ranked again by the exact distance, in double precision.

The index is cut into cells around coarse centroids, one for every CELL_ROWS rows, MAX_CELLS at most, fitted on the
same sample; a query is scored against the PROBED share of the cells that are nearest to it (the share is large as vectors without clusters,
such as the test tables', have their neighbours in many cells). Queries are rows of a table like all
others: cells and queries meet in groups of at most about GROUP rows and QUERIES queries, so no cell is too large for a task, and nothing
but the sample and one row for each cell comes to the driver. A query first sees its HOME nearest cells; the worst score of its short list
there bounds what the other cells give back, so what it gets doesn't grow with the number of cells.

Vectors that are null, zero, of another length than most or that hold null or non-finite components take no part, nor do rows without an
id. A query is a pair of an id and a vector, however often it is repeated. Rows with the query's id are no candidates; other repeated rows each
count. Ties go to the smaller id. An empty table gives no rows. Ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import shared as folders

STAGES = 24
WORDS = 256
SAMPLE = 8192
BEAM = 4
MAX_CELLS = 1024
CELL_ROWS = 500  # at least, on average
PROBED = 0.7
HOME = 8  # cells in which a query first finds how good a row must be
LEAST_CELLS = 16  # that a query is scored against, if there are so many
GROUP = 1 << 16
QUERIES = 2048
SHORTLIST = 200  # rows that are ranked exactly for a query
NEAREST = 10


def _nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", words, words)[None, :] - 2 * x @ words.T).argmin(1)


def _kmeans(x: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    book = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        own = _nearest_word(x, book)
        sums, counts = np.zeros_like(book), np.bincount(own, minlength=words)
        np.add.at(sums, own, x)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), words)])
    return book


def fit(x: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 7, sweeps: int = 8) -> np.ndarray:
    """stages x words x dimensions."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = min(words, max(1, len(x)))
    books, rest = [], x
    for _ in range(stages):
        book = _kmeans(rest, words, rng)
        rest = rest - book[_nearest_word(rest, book)]
        books.append(book)
    books = np.stack(books)
    codes = encode(x, books)
    left = x - books[np.arange(stages), codes].sum(1)
    for _ in range(sweeps):
        for a in range(stages):
            own = codes[:, a]
            sums, counts = 0.1 * books[a], np.bincount(own, minlength=words) + 0.1
            np.add.at(sums, own, left + books[a][own])
            now = (sums / counts[:, None]).astype(np.float32)
            left += books[a][own] - now[own]
            books[a] = now
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Each vector's code, from a beam search over partial sums."""
    stages, words, _ = books.shape
    out = np.empty((len(x), stages), np.int64)
    for first in range(0, len(x), 1024):
        rest = x[first : first + 1024, None, :].astype(np.float32)
        n = len(rest)
        codes = np.zeros((n, 1, 0), np.int64)
        for book in books:
            width = rest.shape[1]
            left = np.einsum("ijk,ijk->ij", rest, rest)[:, :, None] - 2 * rest @ book.T + np.einsum("ij,ij->i", book, book)
            left = left.reshape(n, width * words)
            keep = min(beam, width * words)
            best = np.argpartition(left, keep - 1, 1)[:, :keep] if keep < left.shape[1] else np.broadcast_to(np.arange(keep), left.shape)
            of, word = best // words, best % words
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None]], 2)
            rest = np.take_along_axis(rest, of[:, :, None], 1) - book[word]
        error = np.einsum("ijk,ijk->ij", rest, rest)
        out[first : first + n] = codes[np.arange(n), error.argmin(1)]
    return out


def _vectors(column, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dimensions)


def valid(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the vectors' length."""
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    return rows.where(F.size("vector") == (common["n"] if common else 0)), common["n"] if common else 0


def index(rows: DataFrame, dimensions: int, books: np.ndarray, cells: np.ndarray, folder: str) -> DataFrame:
    """Writes and reads the index: row, vec_id, vector, cell, code (one byte for each stage) and norm, that of the code's sum squared."""
    shared = rows.sparkSession.sparkContext.broadcast((books, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, cells = shared.value
        for batch in batches:
            x = _vectors(batch.column(2), dimensions)
            codes = encode(x, books)
            total = books[np.arange(len(books)), codes].sum(1)
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest_word(x, cells), pa.int64()), code, pa.array(np.einsum("ij,ij->i", total, total), pa.float32())], ["row", "vec_id", "vector", "cell", "code", "norm"])

    fields = "row long, vec_id long, vector array<double>, cell long, code binary, norm float"
    rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector").mapInArrow(run, fields).write.parquet(folder)
    return rows.sparkSession.read.schema(fields).parquet(folder)


def _probes(asked: DataFrame, dimensions: int, cells: np.ndarray, probed: int) -> DataFrame:
    """query, query_id, vector and cell for the nearest cells of each query, with their place from 0."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            x = _vectors(batch.column(2), dimensions)
            far = np.einsum("ij,ij->i", cells, cells)[None, :] - 2 * x @ cells.T
            near = np.argsort(far, 1, kind="stable")[:, :probed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int64()))], ["query", "query_id", "vector", "cells"])

    found = asked.mapInArrow(run, "query long, query_id long, vector array<double>, cells array<long>")
    return found.select("query", "query_id", "vector", F.posexplode("cells").alias("place", "cell"))


def _met(index: DataFrame, probes: DataFrame, dimensions: int, books: Broadcast, shortlist: int) -> DataFrame:
    """The best rows for each query in the cells that it probes (query, query_id, vector, cell and most, the worst score that counts)."""
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    asks = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    plan = F.broadcast(sizes.join(asks, "cell"))  # a row for each cell, MAX_CELLS at most
    deal = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = index.join(plan, "cell").select("cell", F.pmod(F.xxhash64("row"), "parts").alias("part"), deal(F.col("blocks")).alias("block"), "row", "vec_id", "code", "norm")
    right = probes.join(plan, "cell").select("cell", deal(F.col("parts")).alias("part"), F.pmod(F.xxhash64("query"), "blocks").alias("block"), "query", "query_id", "vector", "most")
    return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(lambda a, b: _scored(a, b, dimensions, books.value, shortlist), "query long, row long, vec_id long, near float")


def _best(near: DataFrame, shortlist: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("near", "vec_id", "row"))
    return near.withColumn("place", place).where(F.col("place") <= shortlist)


def _scored(rows: pa.Table, queries: pa.Table, dimensions: int, books: np.ndarray, shortlist: int) -> pa.Table:
    """The best rows of a group for each of its queries: query, row, vec_id and score."""
    out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.float32),)]
    if len(rows) and len(queries):
        ids, row = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
        order = np.lexsort((row, ids))  # equal scores then stand by id
        ids, row, norm = ids[order], row[order], rows.column("norm").to_numpy()[order]
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), len(books))[order]
        names, own = queries.column("query").to_numpy(), queries.column("query_id").to_numpy()
        q, most = _vectors(queries.column("vector"), dimensions).astype(np.float32), queries.column("most").to_numpy()
        for first in range(0, len(names), 16):
            block = q[first : first + 16]
            score = np.broadcast_to(norm, (len(block), len(ids))).copy()
            for book, code in zip(books, codes.T, strict=True):
                score -= 2 * (block @ book.T)[:, code]
            for r, s in enumerate(score, first):
                s[ids == own[r]] = np.inf
                found = np.flatnonzero((s <= most[r]) & (s < np.inf))
                found = found[np.argsort(s[found], kind="stable")][:shortlist]
                out.append((np.full(len(found), names[r]), row[found], ids[found], s[found]))
    query, row, ids, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query": query, "row": row, "vec_id": ids, "near": score})


def nearest(rows: DataFrame, queries: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, shortlist: int = SHORTLIST, sample: int = SAMPLE, probed: float = PROBED, max_cells: int = MAX_CELLS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row for which the condition queries, on vec_id, holds."""
    spark = rows.sparkSession
    rows, dimensions = valid(rows, vec_id, embedding)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / n)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy("vec_id", "vector")
    training = np.array([r["vector"] for r in chosen.limit(2 * sample).collect()]).reshape(-1, dimensions)  # about sample of them
    if not len(training):
        training = np.array([r["vector"] for r in rows.limit(sample).collect()])
    books = fit(training)
    cells = _kmeans(training.astype(np.float32), max(1, min(max_cells, n // CELL_ROWS, len(training) // 8)), np.random.default_rng(11))
    found = index(rows, dimensions, books, cells, folders.folder(spark, "vectors"))
    asked = found.where(queries).select(F.xxhash64("vec_id", "vector").alias("query"), F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query"])
    probes = _probes(asked, dimensions, cells, max(min(LEAST_CELLS, len(cells)), round(probed * len(cells))))
    shared = spark.sparkContext.broadcast(books)
    home = _met(found, probes.where(F.col("place") < HOME).withColumn("most", F.lit(float("inf")).cast("float")), dimensions, shared, shortlist)
    home = folders.written(_best(home, shortlist).drop("place"), "near")
    bound = home.groupBy("query").agg(F.max("near").alias("worst"), F.count("*").alias("n")).where(F.col("n") == shortlist).select("query", "worst")
    others = probes.where(F.col("place") >= HOME).join(bound, "query", "left").withColumn("most", F.coalesce("worst", F.lit(float("inf")).cast("float"))).drop("worst")
    best = _best(home.unionAll(_met(found, others, dimensions, shared, shortlist)), shortlist)
    pairs = best.select("query", "row").join(found.select("row", "vec_id", "vector"), "row").join(asked.withColumnRenamed("vector", "wanted"), "query")
    squares = F.zip_with("vector", "wanted", lambda x, y: (x - y) * (x - y))
    exact = pairs.select("query", "query_id", "vec_id", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"), "row")
    by = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return exact.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
