"""Statistics of all documents about what stands in one document, without a row for each occurrence.

Documents are dealt into chunks. Each chunk reduces what it asks about to sorted distinct 64-bit keys with counts;
leaves, each with a range of the key space, add up the counts of all chunks, and each chunk reads its keys' totals
beside its documents. A key that a third of all documents hold is one key of each chunk.

Chunks and leaves have bounded bytes, so their numbers, not their sizes, grow with the input. If each chunk
wrote to each leaf, messages would grow with the square of the input. So ranges form a tree of at most FAN
branches: a chunk sends one packed message to each first-level range; a relay merges the messages of a group of
chunks there and sends on to the ranges below, and answers go back the same way. A sender has at most FAN messages,
whatever the input. Relays merge equal keys, so a frequent key thins out on its way.

Exchanges get their number of partitions from the input. The documents' exchange is reused, not run again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20  # of text whose keys go to one leaf
TASK_BYTES = 8 << 20  # of text in one partition of an exchange
FAN = 256  # messages of a sender at most
SALTS = 1 << 16  # equal rows are dealt to up to so many chunks
MESSAGE = "_from long, _to long, body binary"
_SCHEMA = pa.schema([("_from", pa.int64()), ("_to", pa.int64()), ("body", pa.binary())])
_U = np.uint64


class Layout:
    """How an input is dealt: numbers of chunks, partitions and leaves, and the tree above the leaves."""

    def __init__(self, total: int, least: int, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN):
        self.chunks = max(least, -(-total // chunk_bytes))
        self.parts = max(least, -(-total // TASK_BYTES))
        leaves = max(least, -(-total // bucket_bytes))
        self.levels = 1
        while fan**self.levels < leaves:
            self.levels += 1
        self.fan = leaves if self.levels == 1 else 2
        while self.fan**self.levels < leaves:
            self.fan += 1
        self.leaves = self.fan**self.levels

    def ranges(self, level: int) -> int:
        return self.fan**level

    def to(self, sender: int, level: int, place: int) -> int:
        """Who hears a sender of the level above about a range: a leaf hears all, a relay a group of chunks."""
        if level == self.levels:
            return place
        group = (sender if level == 1 else sender // self.ranges(level - 1)) // self.fan
        return group * self.ranges(level) + place


def chunked(docs: DataFrame, text: str, *by: str, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> tuple[DataFrame, Layout]:
    """docs with a column _chunk, dealt by it, and the layout. Rows are dealt by a hash and by their place in the input, so
    repeated rows don't pile up; reading docs again must give the same order, as reading files does."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    layout = Layout(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunk_bytes, bucket_bytes, fan)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return docs.withColumn("_chunk", F.pmod(F.xxhash64(*by, text, salt), F.lit(layout.chunks))).repartition(layout.parts, "_chunk"), layout


def place_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of the key space each key is in."""
    return (((keys >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def spans(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """Range, first and last + 1 of the sorted keys in each range that has any."""
    if not len(keys):
        return []
    place = place_of(keys, ranges)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return list(zip(place[first].tolist(), first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True))


def ask(chunks: DataFrame, question: Callable[..., dict[int, bytes]], layout: Layout, *told: DataFrame) -> DataFrame:
    """A message for each first-level range that a chunk asks: question(its rows) gives their bodies. told: answers that it gets too."""

    def run(table: pa.Table, *answers: pa.Table) -> pa.Table:
        return _sent(table.column("_chunk")[0].as_py(), question(table, *answers), layout, 1) if len(table) else _SCHEMA.empty_table()

    if told:
        return beside(chunks, list(told), layout, lambda table, answers: run(table, answers), MESSAGE)
    return chunks.groupBy("_chunk").applyInArrow(lambda table: run(table), MESSAGE)


def _sent(sender: int, bodies: dict[int, bytes], layout: Layout, level: int) -> pa.Table:
    return messages([sender] * len(bodies), [layout.to(sender, level, p) for p in bodies], list(bodies.values()))


def messages(senders: list[int], receivers: list[int], bodies: list[bytes]) -> pa.Table:
    """Bodies are compressed: what Spark compresses shuffles with has no entropy coding, and keys' differences and counts need it."""
    compress = zstandard.ZstdCompressor(level=1).compress
    return pa.Table.from_arrays([pa.array(senders, pa.int64()), pa.array(receivers, pa.int64()), pa.array(map(compress, bodies), pa.binary())], schema=_SCHEMA)


def exchange(asked: DataFrame, layout: Layout, reply: Callable[[list], list[bytes]], relay: Callable[[list, int], dict[int, bytes]], pass_back: Callable[[list, list], list[bytes]], level: int = 1) -> tuple[DataFrame, DataFrame]:
    """The answers to asked, as _chunk, _place and body, and the messages that leaves got.

    reply(a leaf's messages) gives an answer to each; relay(messages, ranges) merges them into one body for each of so many
    ranges; pass_back(messages, answers by range) gives an answer to each of the messages that were merged."""
    asked = asked.repartition(layout.parts, "_to")

    def back(senders: list[int], table: pa.Table, bodies: list[bytes]) -> pa.Table:
        return messages(table.column("_to").to_pylist(), senders, bodies)

    if level == layout.levels:

        def last(table: pa.Table) -> pa.Table:
            senders, bodies = by_sender(table, "_from")
            return back(senders, table, reply(bodies))

        told, leaves = asked.groupBy("_to").applyInArrow(last, MESSAGE), asked
    else:

        def forward(table: pa.Table) -> pa.Table:
            return _sent(table.column("_to")[0].as_py(), relay(by_sender(table, "_from")[1], layout.ranges(level + 1)), layout, level + 1)

        def backward(table: pa.Table, answers: pa.Table) -> pa.Table:
            senders, bodies = by_sender(table, "_from")
            return back(senders, table, pass_back(bodies, by_sender(answers, "_place")[1]))

        below, leaves = exchange(asked.groupBy("_to").applyInArrow(forward, MESSAGE), layout, reply, relay, pass_back, level + 1)
        told = asked.groupBy("_to").cogroup(below.repartition(layout.parts, "_chunk").groupBy("_chunk")).applyInArrow(backward, MESSAGE)
    return told.select(F.col("_to").alias("_chunk"), F.col("_from").alias("_place"), "body"), leaves


def by_sender(table: pa.Table, column: str) -> tuple[list[int], list]:
    """Senders in order and their bodies; answers by their senders are in the order of keys."""
    senders = table.column(column).to_numpy()
    order = np.argsort(senders, kind="stable").tolist()
    bodies = [x.as_buffer() for c in table.column("body").chunks for x in c]
    whole = zstandard.ZstdDecompressor().decompress
    return senders[order].tolist(), [memoryview(whole(bodies[k])) for k in order]


# --- sums of counts by key -------------------------------------------------------------------------------


def packed(keys: np.ndarray, counts: np.ndarray, ranges: int, drop: int) -> dict[int, bytes]:
    """Bodies for ranges, from sorted distinct keys, whose drop lowest bits are 0, and their counts."""
    return {p: pack_sorted(keys[i:j], drop) + pack_counts(counts[i:j]) for p, i, j in spans(keys, ranges)}


def unpacked(bodies: list, drop: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and counts of each body."""
    keys, counts = [], []
    for body in bodies:
        own, at = unpack_sorted(body)
        keys.append(own << _U(drop))
        counts.append(unpack_counts(body[at:])[0])
    return keys, counts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, whether several senders have them, and where each key of the input stands among them."""
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), minlength=len(own)).astype(np.int64)
    return own, total, np.bincount(inverse, minlength=len(own)) > 1, inverse


def sums(chunks: DataFrame, question: Callable[..., tuple[np.ndarray, np.ndarray]], layout: Layout, drop: int, *told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals over all chunks of the counts of keys; question(a chunk's rows) gives its sorted distinct keys and counts. in_order() reads the answers."""

    def split(codes: np.ndarray, keys: list[np.ndarray]) -> list[bytes]:
        return [pack_counts(x) for x in np.split(codes, np.cumsum([len(k) for k in keys])[:-1])]

    def reply(bodies: list) -> list[bytes]:
        keys, counts = unpacked(bodies, drop)
        _, totals, several, inverse = merged(keys, counts)
        return split((2 * totals + several)[inverse], keys)

    def relay(bodies: list, ranges: int) -> dict[int, bytes]:
        own, totals, _, _ = merged(*unpacked(bodies, drop))
        return packed(own, totals, ranges, drop)

    def pass_back(bodies: list, answers: list) -> list[bytes]:
        keys, counts = unpacked(bodies, drop)
        _, _, here, inverse = merged(keys, counts)
        return split((_codes(answers) | here)[inverse], keys)

    asked = ask(chunks, lambda *tables: packed(*question(*tables), layout.ranges(1), drop), layout, *told)
    return exchange(asked, layout, reply, relay, pass_back)


def _codes(bodies: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack_counts(b)[0] for b in bodies)])


def in_order(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of all keys that a chunk asked about, in their order: the totals, and whether other chunks asked too."""
    codes = _codes(by_sender(answers, "_place")[1])
    return codes >> 1, codes & 1 > 0


def beside(chunks: DataFrame, told: list[DataFrame], layout: Layout, use: Callable[[pa.Table, pa.Table], pa.Table], fields, **also: Column) -> DataFrame:
    """use(a chunk's rows, what it was told in each round): one exchange for each round's answers, as rounds are united after it. A chunk
    that asked nothing was told nothing. also: columns beside the answers."""
    rounds = [x.repartition(layout.parts, "_chunk").withColumn("_round", F.lit(k)) for k, x in enumerate(told)]
    return chunks.groupBy("_chunk").cogroup(reduce(DataFrame.unionAll, rounds).withColumns(also).groupBy("_chunk")).applyInArrow(use, fields)


def of_round(told: pa.Table, k: int) -> pa.Table:
    return told.filter(pa.compute.equal(told.column("_round"), k))


def low_bytes(keys: np.ndarray, width: int) -> bytes:
    """The low bytes of all keys: all lowest bytes first, and so on, which compresses better."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_low_bytes(data, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray, drop: int = 0) -> bytes:
    """Sorted keys without their lowest bits, as a first one and differences of as few bytes as the largest takes."""
    if not len(keys):
        return bytes(5)
    keys = keys >> np.uint64(drop)
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return np.array([len(keys)], np.uint32).tobytes() + bytes([width]) + keys[:1].tobytes() + (low_bytes(steps, width) if width and len(steps) else b"")


def unpack_sorted(data) -> tuple[np.ndarray, int]:
    """The keys, and how many bytes they took."""
    n, width = int(np.frombuffer(data, np.uint32, 1)[0]), data[4]
    if not n:
        return np.zeros(0, np.uint64), 5
    end = 13 + width * (n - 1)
    first = np.frombuffer(data[5:13], np.uint64)
    steps = from_low_bytes(np.frombuffer(data, np.uint8, width * (n - 1), 13), width) if width else np.zeros(n - 1, np.uint64)
    return np.cumsum(np.concatenate([first, steps]), dtype=np.uint64), end


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, one byte each; 255 stands for one of those that follow in full."""
    large = counts[counts >= 255]
    return np.array([len(counts)], np.uint32).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype(np.int64).tobytes()


def unpack_counts(data) -> tuple[np.ndarray, int]:
    """The counts, and how many bytes they took."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    large = np.flatnonzero(out == 255)
    end = 4 + n + 8 * len(large)
    out[large] = np.frombuffer(bytes(data[4 + n : end]), np.int64)
    return out, end
