"""Ranked lexical search with block maxima: an index of compressed posting blocks, and Block-Max WAND over it.

The index has one row for each chunk of about CHUNK_BYTES of text, made where the texts are read, without a shuffle. A chunk has
its documents in order of their ids, their lengths in terms, and for each term a list of postings (document, occurrences). A list is cut into
blocks of BLOCK postings, each packed in as few bits as it needs. Beside a block stand its last document and its *impacts*: the
pairs of occurrences and length that no other posting of the block beats in both. What a posting adds to a score grows with the
occurrences and falls with the length, so the largest addition of a block is that of one of its impacts, whatever the statistics of
the collection are; an index needn't be written anew when documents are added to the collection.

A query goes through a chunk from its first document to the last. Shallow pointers of its terms move over the ends of blocks: between two
ends the maxima of the blocks there add up to a bound. Stretches whose bound is below the score of the K-th best document so far are
skipped. In those that remain terms are looked at from the rarest on: only blocks in whose stretch a document is left that can still reach
the threshold are unpacked (deep moves); then the threshold is raised. A task keeps
the best of its earlier chunks as the threshold of the next ones, and all tasks start from the K-th best score in a few chunks
(PRIMED), which the final one can't be below. Equal scores are kept, so ties end as the contract says.

Queries come in blocks of at most about ITEM_BYTES of text, broadcast, each asked of all chunks. Where the vocabulary is given, only its
postings are kept; counts (documents, their lengths, documents that have a term) are of all documents in either case. Terms are told
apart by 64-bit hashes.

Scores are 64-bit integers: the sum over the query's terms, repeats included, of weight * ((SCALE * tf) // (1000 * tf + 8 * m)), where
m = 25 + (75 * n * N) // L and the weight is floor(1000 * ln((2N + 2) / (2 df + 1))).

A null text has no terms and isn't counted. Rows without an id are documents like others and lose ties. Repeated rows each count, as
documents and as items. Empty tables and items without a known term give no rows. Other columns are not read. A long text is worked on in portions;
a document's terms take some 16 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import flat, shared

BLOCK = 128
CHUNK_BYTES = 16 << 20
SPAN = 1024  # documents of adjoining stretches that are scored at once, about
ITEM_BYTES = 1 << 20
PRIMED = 4  # chunks that thresholds start from
TASK_CHUNKS = 64  # that a task goes through, where there are many
BEST = 10
SCALE = 1_000_000_000
_NONE = np.iinfo(np.int64).max  # stands for no id, and sorts last
INDEX = "ids array<long>, lengths array<int>, terms array<long>, counts array<int>, lasts binary, widths binary, starts binary, impacts binary, packed binary"
_FIELDS = ["ids", "lengths", "terms", "counts", "lasts", "widths", "starts", "impacts", "packed"]


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest width bits of each value."""
    return np.packbits((values[:, None] >> np.arange(width)) & 1).tobytes() if width else b""


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    return np.unpackbits(data, count=n * width).reshape(n, width) @ (1 << np.arange(width, dtype=np.int64))


def skyline(tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The pairs (tf, n) that no other pair beats with more occurrences and no greater length."""
    order = np.lexsort((n, -tf))
    tf, n = tf[order], n[order]
    best = np.minimum.accumulate(n)
    first = np.append(True, n[1:] < best[:-1])
    return np.stack([tf[first], n[first]], 1)


def _indexed(ids: list[np.ndarray], lengths: list[np.ndarray], rows: list[np.ndarray], hashes: list[np.ndarray]) -> list:
    """One row of the index. rows: for each kept word the document, by its place in ids."""
    ids, lengths, rows, hashes = (np.concatenate(x) for x in (ids, lengths, rows, hashes))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, lengths, rows = ids[order], lengths[order], place[rows]
    order = np.lexsort((rows, hashes))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(rows)))
    rows, hashes = rows[at], hashes[at]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(rows) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(rows)))
    lasts, widths, starts, impacts, packed, size = [], [], [], [], [], 0
    n = lengths[rows]
    for a, count in zip(first.tolist(), counts.tolist(), strict=True):
        before = -1
        for i in range(a, a + count, BLOCK):
            j = min(i + BLOCK, a + count)
            gaps, more = np.diff(rows[i:j], prepend=before) - 1, tf[i:j] - 1
            before = int(rows[j - 1])
            wide = (int(gaps.max()).bit_length(), int(more.max()).bit_length())
            body = pack(gaps, wide[0]) + pack(more, wide[1])
            tops = skyline(tf[i:j], n[i:j])
            lasts.append(before)
            widths.append((*wide, len(tops)))
            starts.append(size)
            impacts.append(tops)
            packed.append(body)
            size += len(body)
    return [ids, lengths, hashes[first].view(np.int64), counts, np.array(lasts, np.int32).tobytes(), np.array(widths, np.int32).tobytes(), np.array(starts, np.int64).tobytes(), np.concatenate([np.zeros((0, 2), np.int64), *impacts]).tobytes(), b"".join(packed)]


def _batch(row: list) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], _FIELDS)


def index(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", vocabulary: np.ndarray | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes and reads the index. vocabulary: sorted hashes of the terms whose postings are kept; all, if there is none."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = docs_held = 0
        for batch in batches:
            own = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False)
            data, offsets = flat.flat(batch.column(1))
            for i, j in flat.pieces(offsets, chunk_bytes):
                a, b = int(offsets[i]), int(offsets[j])
                if docs_held and size + b - a > chunk_bytes:
                    yield _batch(_indexed(*held))
                    held, size, docs_held = [[], [], [], []], 0, 0
                lengths = np.zeros(j - i, np.int64)
                bytes_, ends = data[a:b], offsets[i : j + 1] - a
                rows, hashes = [], []
                for x, y, r, s in flat.portions(bytes_, ends, flat.WORD_BYTE):
                    low, first, last, words = flat.words(bytes_[x:y], np.clip(ends[r : s + 1], x, y) - x)
                    found = flat.run_hashes(low, first, last)
                    lengths[r:s] += np.diff(words)
                    row = np.repeat(np.arange(r, s), np.diff(words))
                    if wanted is not None:
                        spot = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
                        keep = wanted[spot] == found if len(wanted) else np.zeros(len(found), bool)
                        found, row = found[keep], row[keep]
                    rows.append(row)
                    hashes.append(found)
                at = np.flatnonzero(lengths)  # documents without a term aren't counted
                place = np.cumsum(lengths > 0) - 1 + docs_held
                held[0].append(own[i:j][at])
                held[1].append(lengths[at])
                held[2].append(place[np.concatenate([np.zeros(0, np.int64), *rows])])
                held[3].append(np.concatenate([np.zeros(0, np.uint64), *hashes]))
                docs_held += len(at)
                size += b - a
        if docs_held:
            yield _batch(_indexed(*held))

    docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, INDEX).write.parquet(folder)
    return spark.read.schema(INDEX).parquet(folder)


def _asked(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct term hashes and how often it has them."""
    out = []
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        hashes, _ = flat.word_hashes(data, np.array([0, len(data)]))
        out.append(np.unique(hashes, return_counts=True))
    return out


class Chunk:
    """One row of the index."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.lengths, self.terms, self.counts = (row[k] for k in _FIELDS[:4])
        self.terms = self.terms.view(np.uint64)
        self.lasts, self.starts, self.packed = get("lasts", np.int32), get("starts", np.int64), get("packed", np.uint8)
        self.widths, self.impacts = get("widths", np.int32).reshape(-1, 3), get("impacts", np.int64).reshape(-1, 2)
        self.first = np.concatenate([[0], np.cumsum(-(-self.counts // BLOCK))]).astype(np.int64)  # block of each term
        self.tops = np.concatenate([[0], np.cumsum(self.widths[:, 2])]).astype(np.int64)
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weigh(self, documents: int, total: int) -> None:
        """Largest additions of blocks, for a collection of so many documents and terms."""
        self.norm = 8 * (25 + (75 * self.lengths.astype(np.int64) * documents) // total)
        tf, n = self.impacts.T
        adds = (SCALE * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // total))
        self.most = np.maximum.reduceat(adds, self.tops[:-1]) if len(self.widths) else np.zeros(0, np.int64)

    def block(self, term: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a block and what each adds, unpacked once."""
        if b not in self.unpacked:
            own = self.first[term]
            n = min(BLOCK, int(self.counts[term]) - BLOCK * int(b - own))
            one, two, _ = self.widths[b].tolist()
            at = int(self.starts[b])
            middle = at + (n * one + 7) // 8
            before = int(self.lasts[b - 1]) if b > own else -1
            docs = np.cumsum(unpack(self.packed[at:middle], n, one) + 1) + before
            tf = unpack(self.packed[middle : middle + (n * two + 7) // 8], n, two) + 1
            self.unpacked[b] = docs, (SCALE * tf) // (1000 * tf + self.norm[docs])
        return self.unpacked[b]

    def search(self, hashes: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int, least: int) -> list[tuple[int, int]]:
        """The k best (-score, id) of best and this chunk's documents that score least at least."""
        spot = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        here = (self.terms[spot] == hashes) & (weights > 0) if len(self.terms) else np.zeros(len(hashes), bool)
        terms, weights = spot[here], weights[here]
        if not len(terms):
            return best
        order = np.argsort(self.counts[terms], kind="stable")  # rare terms first: they tell which documents are left for the others
        terms, weights = terms[order], weights[order]
        # Shallow moves: between two ends of blocks the same blocks hold for all terms.
        ends = np.unique(np.concatenate([self.lasts[self.first[t] : self.first[t + 1]] for t in terms]))
        blocks, tops = np.empty((len(terms), len(ends)), np.int64), np.zeros((len(terms) + 1, len(ends)), np.int64)
        for r, (t, w) in enumerate(zip(terms, weights, strict=True)):
            a, b = self.first[t], self.first[t + 1]
            at = a + np.searchsorted(self.lasts[a:b], ends)
            blocks[r] = np.where(at < b, at, -1)
            tops[r] = w * np.where(at < b, self.most[np.minimum(at, b - 1)], 0)
        bounds = np.cumsum(tops[::-1], 0)[::-1]  # what a term and those after it can still add
        bound = bounds[0]
        begins = np.append(-1, ends[:-1]).astype(np.int64) + 1
        threshold = max(least, -best[-1][0] if len(best) == k else 1)
        p = 0
        while p < len(ends):
            left = bound[p:] >= threshold
            p += int(left.argmax())
            if bound[p] < threshold:
                break
            q = p + 1
            while q < len(ends) and bound[q] >= threshold and ends[q] - begins[p] < SPAN:
                q += 1
            low, high = int(begins[p]), int(ends[q - 1]) + 1
            score, alive = np.zeros(high - low, np.int64), np.ones(high - low, bool)
            of = np.searchsorted(ends[p:q], np.arange(low, high))  # stretch of each document
            for r, (t, w) in enumerate(zip(terms, weights, strict=True)):
                for b in np.unique(blocks[r, p:q][np.bincount(of[alive], minlength=q - p) > 0]):
                    if b >= 0:
                        docs, adds = self.block(t, int(b))
                        i, j = np.searchsorted(docs, (low, high))
                        score[docs[i:j] - low] += w * adds[i:j]
                alive &= score + bounds[r + 1, p:q][of] >= threshold  # a document in which the terms so far can't be made up for is no pivot
                if not alive.any():
                    break
            found = np.flatnonzero(alive)
            if len(found):
                if len(found) > k:
                    found = found[np.argsort(-score[found], kind="stable")[:k]]  # documents stand in order of their ids
                best = sorted(best + list(zip((-score[found]).tolist(), self.ids[low + found].tolist(), strict=True)))[:k]
                threshold = max(least, -best[-1][0] if len(best) == k else 1)
            p = q
        return best


def _weights(hashes: np.ndarray, documents: int, held: dict[int, int]) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(h, 0) + 1))) for h in hashes.view(np.int64).tolist()], np.int64)


def _found(chunks: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray, int]], documents: int, total: int, k: int) -> DataFrame:
    """item, doc_id and score of each task's k best. asked: items with their terms, weights and the least score that counts."""
    told = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = told.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for batch in batches:
            for r in range(len(batch)):
                row = {name: batch.column(c)[r].values.to_numpy(zero_copy_only=False) if c < 4 else batch.column(c)[r].as_buffer() for c, name in enumerate(_FIELDS)}
                chunk = Chunk(row)
                chunk.weigh(documents, total)
                for i, (_, hashes, weights, least) in enumerate(asked):
                    best[i] = chunk.search(hashes, weights, best[i], k, least)
        rows = [(asked[i][0], d, -s) for i, found in enumerate(best) for s, d in found]
        for a in range(0, len(rows), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[a : a + 10000], strict=True)], ["item", "doc_id", "score"])

    return chunks.mapInArrow(run, "item long, doc_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    """doc_id of documents without an id is still a number here, so that they come last."""
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST, item_bytes: int = ITEM_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    spark = docs.sparkSession
    names = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    blocks = max(1, -(-(names.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes))
    block = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks))
    names = shared.written(names.select(F.monotonically_increasing_id().alias("item"), block.alias("block"), "item_id", "text"), "items")
    chunks, out = None, None
    for b in range(blocks):
        held = names.where(F.col("block") == b).select("item", "text").collect()  # about item_bytes of text
        asked = _asked([r["text"].encode() for r in held])
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in asked)]))
        if chunks is None:  # one block of items needs the postings of its terms only
            chunks = index(docs, shared.folder(spark, "index"), doc_id=doc_id, text=text, vocabulary=vocabulary if blocks == 1 else None, chunk_bytes=chunk_bytes)
            counts = chunks.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n"), F.sum("l"), F.count("*")).first()
            documents, total = counts[0] or 0, counts[1] or 0
            tasks = max(1, min(counts[2], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts[2] // TASK_CHUNKS))))
        df = chunks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        if blocks > 1:
            df = df.join(F.broadcast(spark.createDataFrame([(x,) for x in vocabulary.view(np.int64).tolist()], "term long")), F.col("t.terms") == F.col("term"), "left_semi")  # at most item_bytes / 2 terms
        df = dict(df.groupBy("t.terms").agg(F.sum("t.counts")).collect())  # a row for each term of the block's items
        asked = [(r["item"], h, n * _weights(h, documents, df), 1) for r, (h, n) in zip(held, asked, strict=True)]
        few = _top(_found(chunks.limit(PRIMED).repartition(PRIMED), asked, documents, total, k), k).where(F.col("rank") == k).select("item", "score").collect()
        least = dict(few)  # a row for each item of the block
        asked = [(i, h, w, least.get(i, 1)) for i, h, w, _ in asked]
        best = _top(_found(chunks.repartition(tasks), asked, documents, total, k), k)
        best = shared.written(best, "ranked") if blocks > 1 else best
        out = best if out is None else out.unionAll(best)
    return out.join(names.select("item", "item_id"), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(_NONE)).alias("doc_id"), "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM f, s),
x AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
y AS (SELECT q, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l)))) AS BIGINT) AS score FROM x JOIN p USING (t) JOIN v USING (t), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM y WHERE score > 0) WHERE rank <= 10
"""
