"""Hard negatives by a distributed k-nearest-neighbour join over Voronoi cells, largest inner product first.

Vectors are quantised to whole numbers, so scores are exact. With M the largest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and an
anchor q becomes (q, 0): then |q - x|^2 = |q|^2 + M^2 - 2 qx, and the largest inner product is the smallest distance. PIVOTS at most
of the candidates, chosen by a hash, cut the space into cells; anchors are grouped by their nearest pivot. What an anchor still needs is
a ring around it: all candidates of a score from t to u, so of distances from inner to outer. For a cell, the driver knows how far its
anchors are from the pivot and how wide their rings are (one row for each cell). A candidate goes to those cells only whose anchors it
might serve: by the triangle inequality from its distance to the cell's pivot, as it is no nearer to an anchor there than to the plane between
its own pivot and the cell's, and as an inner product with an anchor differs from that with the pivot by their distance times its length at most. Candidates travel in packed blocks of the rows of one batch, anchors stand in blocks of at most about ANCHORS; each
pair of blocks is joined exactly by itself, wherever Spark puts it, so a cell or a label that a third of all rows are in is many small joins.

There are three such joins. The first looks at each anchor's own cell for rows of its label: the score of the last positive found there is
a floor. The second gets the positives above that floor. The third gets the negatives between the scores that the positives allow.
In the first two, cells are cut further by a hash of the label.

Of rows of equal vector and label only the first few by id can be among the first few of any anchor, so the others aren't sent: that is
exact, and makes the work of many copies that of one.

Rows without an id, label or vector, with a component that is null or not finite, with another number of components than most, or with components
so large that a product could leave 64 bits take no part. Repeated rows (id, label and vector) count once; rows that share
an id only are different rows. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import shared

PIVOTS = 1024
ANCHORS = 1024  # in a block
BUCKETS = 16  # of labels, in a cell
BLOCK = 4096  # candidates in a block at most
SCALE = 256
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # hundredths of the positive's score
_NO = -(1 << 62)  # below all scores


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers in as few bytes as their components take."""
    wide = np.abs(x).max(1, initial=0)
    return [r.astype(np.int16 if w < 1 << 15 else np.int32 if w < 1 << 31 else np.int64).tobytes() for r, w in zip(x, wide.tolist(), strict=True)]


def _vectors(column, dimensions: int) -> np.ndarray:
    """Rows of 64-bit numbers from packed ones."""
    out = np.empty((len(column), dimensions), np.int64)
    for k, v in enumerate(column if dimensions else ()):
        raw = v.as_buffer()
        out[k] = np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[raw.size // dimensions])
    return out


def prepared(rows: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """row, vec_id, label (a number), vector (packed) and norm, squared, of the rows that take part, each once; and the vectors' length."""
    x = F.col("vector")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.xxhash64(label).alias("label"), F.transform(F.col(embedding), lambda v: v.cast("double")).alias("vector"), F.col(label).isNotNull().alias("has"))
    rows = rows.where(F.col("has") & F.col("vec_id").isNotNull() & x.isNotNull()).where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    common = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    dimensions = common["n"] if common else 0
    limit = math.isqrt((1 << 62) // max(1, dimensions)) - 1
    rows = rows.where((F.size(x) == dimensions) & F.forall(x, lambda v: F.abs(v * scale) < limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(scale * np.asarray(batch.column(2).flatten(), np.float64)).astype(np.int64).reshape(len(batch), dimensions)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_packed(whole), pa.binary()), pa.array((whole * whole).sum(1), pa.int64())], ["vec_id", "label", "vector", "norm"])

    found = rows.select("vec_id", "label", "vector").mapInArrow(run, "vec_id long, label long, vector binary, norm long").dropDuplicates(["vec_id", "label", "vector"])
    return shared.written(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector", "norm"), "vectors"), dimensions


def _block(columns: dict) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(body) -> pa.Table:
    return pa.ipc.open_stream(body).read_all().combine_chunks()


class Cells:
    """Pivots, as vectors with the coordinate that their norm lacks, and what is known of each cell's anchors."""

    def __init__(self, pivots: np.ndarray, most: int):
        self.most = most
        self.slack = 1e-6 * math.sqrt(most) + 1e-9
        self.pivots = pivots.astype(np.float64)
        self.lift = np.sqrt(np.maximum(most - (self.pivots * self.pivots).sum(1), 0))
        self.between = np.sqrt(np.maximum(2 * most - 2 * (self.pivots @ self.pivots.T + self.lift[:, None] * self.lift), 0))

    def from_candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to all pivots, inner products with them, and lengths."""
        x = x.astype(np.float64)
        squares, dots = (x * x).sum(1), x @ self.pivots.T
        lift = np.sqrt(np.maximum(self.most - squares, 0))
        return np.sqrt(np.maximum(2 * self.most - 2 * (dots + lift[:, None] * self.lift), 0)), dots, np.sqrt(squares)

    def from_anchors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to all pivots, with and without the lacking coordinate."""
        x = x.astype(np.float64)
        both = (x * x).sum(1)[:, None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(both + self.most, 0)), np.sqrt(np.maximum(both + (self.pivots * self.pivots).sum(1), 0))

    def serves(self, far: np.ndarray, dots: np.ndarray, length: np.ndarray, cell: int, reach: float, inner: float, outer: float, radius: float, least: float, top: float) -> np.ndarray:
        """Which candidates may be in the ring of an anchor of a cell: no anchor is further than reach from its pivot (radius without the lacking
        coordinate), and scores from least to top are wanted."""
        here, own = far[:, cell], far.argmin(1)
        apart = self.between[own, cell]
        plane = np.where(apart > self.slack, (here**2 - far[np.arange(len(far)), own] ** 2) / (2 * np.maximum(apart, self.slack)), 0.0)
        ring = (here <= reach + outer + self.slack) & (here + reach >= inner - self.slack) & (plane <= outer + self.slack)
        ball, loose = (radius + self.slack) * length, self.slack * (1 + math.sqrt(self.most))
        return ring & (dots[:, cell] + ball >= least - loose) & (dots[:, cell] - ball <= top + loose)


def _sent(candidates: DataFrame, cells: Cells, rings: dict[tuple[int, int], tuple[float, ...]], buckets: int, home: bool, dimensions: int) -> DataFrame:
    """Blocks of candidates for the cells (and buckets) that they may serve: cell, bucket and body."""
    told = candidates.sparkSession.sparkContext.broadcast((cells, rings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rings = told.value
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))  # equal scores then stand by id
                far, dots, length = cells.from_candidates(_vectors(part.column(2), dimensions))
                own, bucket = far.argmin(1), part.column(1).to_numpy() % buckets
                out: list[tuple[int, int, bytes]] = []
                for (cell, b), ring in rings.items():
                    keep = np.flatnonzero((bucket == b) & ((own == cell) if home else True))
                    if not home and len(keep):
                        keep = keep[cells.serves(far[keep], dots[keep], length[keep], cell, *ring)]
                    if len(keep):
                        rows = part.take(pa.array(keep))
                        out.append((cell, b, _block({"vec_id": rows.column(0), "label": rows.column(1), "vector": rows.column(2)})))
                    if len(out) >= 64:
                        yield _messages(out)
                        out = []
                if out:
                    yield _messages(out)

    return candidates.select("vec_id", "label", "vector").mapInArrow(run, "cell long, bucket long, body binary")


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cell, bucket, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(bucket, pa.int64()), pa.array(body, pa.binary())], ["cell", "bucket", "body"])


def _first(score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows, those with the k largest scores, largest first, equal ones in their order."""
    s = score[rows]
    if len(rows) > k:
        kept = s >= np.partition(s, len(s) - k)[len(s) - k]
        rows, s = rows[kept], s[kept]
    return rows[np.argsort(-s, kind="stable")[:k]]


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of x."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ x.T


def _joined(anchors: pa.Table, rows: pa.Table, dimensions: int, positives: bool, k: int, low: int, high: int) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each anchor: its row, the place of the positive, ids and scores of the first k of these rows."""
    a, x = _vectors(anchors.column("vector"), dimensions), _vectors(rows.column("vector"), dimensions)
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    out = []
    for row, own, label, vector, wanted, score in zip(anchors.column("row").to_pylist(), anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), a, anchors.column("wanted").to_pylist(), _products(a, x), strict=True):
        if positives:
            found = np.flatnonzero((labels == label) & (score >= wanted[0]))
            same = found[ids[found] == own]
            if len(same):
                found = np.setdiff1d(found, same[(x[same] == vector).all(1)])
            asked = [(0, found)]
        else:
            other = labels != label
            asked = [(p, np.flatnonzero(other & (score >= -(-low * s // 100)) & (score <= high * s // 100))) for p, s in enumerate(wanted)]
        for place, found in asked:
            found = _first(score, found, k)
            if len(found):
                out.append((row, place, ids[found], score[found]))
    return out


def _join(candidates: DataFrame, anchors: DataFrame, cells: Cells, dimensions: int, *, positives: bool, home: bool, k: int, low: int = LOW, high: int = HIGH) -> DataFrame:
    """row, place, vec_id, score and rank of the first k candidates for each anchor (and positive). anchors: row, vec_id, label, vector, cell, far,
    plain, wanted (least score, or the positives' scores), and inner, outer, least and top, which bound what it needs."""
    buckets = BUCKETS if positives else 1
    anchors = anchors.withColumn("bucket", F.pmod(F.col("label"), F.lit(buckets)))
    known = anchors.groupBy("cell", "bucket").agg(F.max("far").alias("reach"), F.min("inner").alias("inner"), F.max("outer").alias("outer"), F.max("plain").alias("radius"), F.min("least").alias("least"), F.max("top").alias("top"), F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    rings = {(r["cell"], r["bucket"]): (r["reach"], r["inner"], r["outer"], r["radius"], r["least"], r["top"]) for r in known.collect()}  # PIVOTS * BUCKETS rows at most

    def pack(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c) for c in ("row", "vec_id", "label", "vector", "wanted")}
        return pa.table({"cell": table.column("cell")[:1], "bucket": table.column("bucket")[:1], "asked": pa.array([_block(columns)], pa.binary())})

    dealt = anchors.join(F.broadcast(known.select("cell", "bucket", "blocks")), ["cell", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    blocks = dealt.drop("blocks").groupBy("cell", "bucket", "block").applyInArrow(pack, "cell long, bucket long, asked binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, body in zip(batch.column(0), batch.column(1), strict=True):
                found = _joined(_opened(asked.as_buffer()), _opened(body.as_buffer()), dimensions, positives, k, low, high)
                if found:
                    rows, places, ids, scores = zip(*found, strict=True)
                    times = [len(i) for i in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, times), pa.int64()), pa.array(np.repeat(places, times), pa.int32()), pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(scores), pa.int64())], ["row", "place", "vec_id", "score"])

    met = _sent(candidates, cells, rings, buckets, home, dimensions).join(blocks, ["cell", "bucket"]).select("asked", "body").mapInArrow(run, "row long, place int, vec_id long, score long")
    by = Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id")
    return shared.written(met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "near")


def mine(rows: DataFrame, anchors: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. anchors: a condition on vec_id. pivots: by default half the
    square root of the number of anchors, PIVOTS at most."""
    spark = rows.sparkSession
    fields = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, dimensions = prepared(rows, vec_id, embedding, label, scale)
    most = rows.agg(F.max("norm")).first()[0]
    asking = rows.where(anchors)
    count = asking.count()
    if not count:
        return spark.createDataFrame([], fields)
    first = F.row_number().over(Window.partitionBy("vector", "label").orderBy("vec_id"))
    candidates = shared.written(rows.withColumn("copy", first).where(F.col("copy") <= max(positives + 1, negatives)).drop("copy"), "candidates")
    chosen = candidates.orderBy(F.xxhash64("vector"), "row").limit(pivots or min(PIVOTS, math.isqrt(count) // 2 + 1)).select("vector").collect()
    cells = Cells(_vectors(pa.array([bytes(r["vector"]) for r in chosen], pa.binary()), dimensions), most)
    told = spark.sparkContext.broadcast(cells)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, plain = told.value.from_anchors(_vectors(batch.column(3), dimensions))
            cell = far.argmin(1)
            own = np.arange(len(far)), cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(far[own], pa.float64()), pa.array(plain[own], pa.float64())], [*batch.schema.names, "cell", "far", "plain"])

    asking = shared.written(asking.mapInArrow(nearest, "row long, vec_id long, label long, vector binary, norm long, cell long, far double, plain double"), "anchors")

    def ringed(anchors: DataFrame, wanted: Column, least: Column, top: Column) -> DataFrame:
        """Anchors with the scores that they want and how far off candidates of scores from least to top are."""
        distance = lambda score: F.sqrt(F.greatest(F.col("norm") + float(most) - 2.0 * score, F.lit(0.0)))
        least, top = F.coalesce(least, F.lit(-math.inf)), F.coalesce(top, F.lit(math.inf))
        return anchors.withColumns({"wanted": wanted, "least": least, "top": top, "inner": distance(top), "outer": distance(least)})

    nothing = F.lit(None).cast("double")
    home = _join(candidates, ringed(asking, F.array(F.lit(_NO)), nothing, nothing), cells, dimensions, positives=True, home=True, k=positives)
    floor = home.where(F.col("rank") == positives).select("row", F.col("score").alias("floor"))
    better = ringed(asking.join(floor, "row", "left"), F.array(F.coalesce("floor", F.lit(_NO))), F.col("floor").cast("double"), nothing)
    found = _join(candidates, better, cells, dimensions, positives=True, home=False, k=positives)
    # The scores of an anchor's positives, a few numbers; a negative score allows no negatives.
    allowed = found.where("score >= 0").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("held"))
    scores = F.col("held.score")
    last = ringed(asking.join(allowed, "row"), scores, F.array_min(scores) * low / 100, F.array_max(scores) * high / 100)
    hard = _join(candidates, last, cells, dimensions, positives=False, home=False, k=negatives, low=low, high=high)
    pairs = found.select("row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(pairs, ["row", "place"]).join(asking.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
