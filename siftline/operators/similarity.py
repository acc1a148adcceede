"""Fingerprints of 32-bit items and their similarity (DOM-09, DOM-10, JOIN-12, MTH-01)."""

from __future__ import annotations

import base64
import binascii

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

OFFSETS = 10
LEAST_OVERLAP = 50


def _fields(data: bytes, width: int) -> np.ndarray:
    """The bytes' bits, lowest first, as numbers of so many bits; what is left over is dropped."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    bits = bits[: len(bits) // width * width].reshape(-1, width)
    return bits @ (1 << np.arange(width))


def decode_one(text: str) -> list[int] | None:
    """A fingerprint's items; null if it isn't one. After one byte of version and three of length come 3-bit steps between
    set bits, each item's ending with 0; 7 means that 5 more bits, which follow all others, are to be added. Each
    item is the difference, by exclusive or, from the one before."""
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None
    if len(raw) < 4:
        return None
    count, steps = int.from_bytes(raw[1:4], "big"), _fields(raw[4:], 3).astype(np.int64)
    ends = np.flatnonzero(steps == 0)[:count]
    if count == 0 or len(ends) < count:
        return [] if count == 0 else None
    steps = steps[: ends[-1] + 1]
    wide = np.flatnonzero(steps == 7)
    more = _fields(raw[4 + (3 * len(steps) + 7) // 8 :], 5)
    if len(more) < len(wide):
        return None
    steps[wide] += more[: len(wide)]
    item = np.searchsorted(ends, np.arange(len(steps)))
    place = np.cumsum(steps)
    place -= np.concatenate([[0], place[ends]])[item]
    if (place > 32).any():
        return None
    change = np.zeros(count, np.uint64)
    set_bits = steps > 0
    np.bitwise_or.at(change, item[set_bits], np.uint64(1) << (place[set_bits] - 1).astype(np.uint64))
    return np.bitwise_xor.accumulate(change).astype(np.int64).tolist()


def _running(counts: np.ndarray) -> np.ndarray:
    """Where each of so many stretches begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(counts.sum())) + np.repeat(starts - (ends - counts), counts)


_SEXTET = np.full(256, 255, np.uint8)
for _k, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"):
    _SEXTET[_c] = _k
_SEXTET[ord("+")], _SEXTET[ord("/")] = 62, 63


def _windows(bits: np.ndarray, width: int) -> np.ndarray:
    """The number of so many bits, lowest first, that begins at each bit; the last ones have fewer."""
    out = bits.copy()
    for k in range(1, width):
        out[:-k] |= bits[k:] << k
    return out


PIECE = 1 << 15  # characters that are decoded at once: what they unfold to stays in a core's cache
LONG = 1 << 10  # a text with more is an array's work by itself


def decode_all(texts: pa.Array) -> pa.Array:
    """decode_one() of all texts: short ones together in pieces, long ones one by one. Short ones of 15 items take half the time of one by one;
    of 900 items, together, they took twice."""
    length = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, long = np.cumsum(length), np.append(np.flatnonzero(length > LONG), len(texts))
    out, i = [], 0
    while i < len(texts):
        stop = int(long[np.searchsorted(long, i)])
        if stop == i:
            out.append(pa.array([decode_one(texts[i].as_py())], pa.list_(pa.int64())))
            i += 1
        else:
            j = min(stop, max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right"))))
            out.append(_decoded(texts.slice(i, j - i)))
            i = j
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def _decoded(texts: pa.Array) -> pa.Array:
    """All texts of a piece at once: each step runs over the bytes, bits, steps and items of all of them, with offsets of the texts. Texts with
    characters that aren't of the alphabet, few if any, go one by one."""
    n = len(texts)
    plain = texts.cast(pa.large_binary()).fill_null(b"")
    _, at, data = plain.buffers()
    edges = np.frombuffer(at, np.int64)[plain.offset : plain.offset + n + 1]
    data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[edges[0] : edges[-1]]
    sextets, edges = _SEXTET[data], edges - edges[0]
    length = np.diff(edges)
    odd = np.diff(_running(sextets == 255)[edges]) > 0
    slow = odd | (length % 4 == 1)
    # Four characters make three bytes.
    quads = -(-length // 4)
    first = 4 * _running(quads)[:-1]
    packed = np.zeros(4 * int(quads.sum()), np.uint32)
    packed[_spread(first, length)] = np.where(sextets == 255, 0, sextets)
    packed = packed.reshape(-1, 4)
    word = packed[:, 0] << 18 | packed[:, 1] << 12 | packed[:, 2] << 6 | packed[:, 3]
    raw = np.stack([word >> 16, word >> 8 & 255, word & 255], 1).astype(np.uint8).ravel()
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    begin, size = first // 4 * 3, length * 6 // 8
    good = ~slow & (size >= 4)
    head = np.where(good, begin, 0)
    count = np.where(good, raw[head + 1].astype(np.int64) << 16 | raw[head + 2].astype(np.int64) << 8 | raw[head + 3], 0)
    # Steps of three bits, as many as there can be; those count that come before the last item ends.
    bits = np.unpackbits(raw, bitorder="little")
    fields = np.where(good & (count > 0), (size - 4) * 8 // 3, 0)
    edge = _running(fields)
    row = np.repeat(np.arange(n, dtype=np.int32), fields)
    steps = _windows(bits, 3)[3 * np.arange(edge[-1]) + np.repeat((begin + 4) * 8 - 3 * edge[:-1], fields)]
    zeros = _running(steps == 0)
    whole = zeros[edge[1:]] - zeros[edge[:-1]] >= count
    good &= whole
    item = zeros[:-1] - zeros[edge[:-1]][row]
    used = good[row] & (item < count[row])
    steps, row, item = steps[used].astype(np.int64), row[used], item[used]
    # Sevens get five bits more, which stand behind all steps, from a whole byte on.
    seven = np.flatnonzero(steps == 7)
    sevens, taken = np.bincount(row[seven], minlength=n), np.bincount(row, minlength=n)
    more = 4 + (3 * taken + 7) // 8
    enough = (size - more) * 8 // 5 >= sevens
    good &= enough | (sevens == 0)
    seven = seven[good[row[seven]]]
    sevens = np.where(good, sevens, 0)
    nth = np.arange(len(seven)) - np.repeat(_running(sevens)[:-1], sevens)
    steps[seven] += _windows(bits, 5)[8 * (begin + more)[row[seven]] + 5 * nth]
    # Places of set bits: sums of an item's steps; items: sums of their bits, then exclusive or from the first on.
    start = _running(np.where(taken > 0, count, 0))
    item += start[row]
    sums = np.cumsum(steps)
    ends = np.flatnonzero(steps == 0)
    before = np.zeros(int(start[-1]), np.int64)
    before[item[ends]] = sums[ends]
    fresh = np.concatenate([[0], before])[item]
    place = sums - fresh
    good &= np.bincount(row[place > 32], minlength=n) == 0
    kept = (steps > 0) & (place <= 32)
    change = np.bincount(item[kept], (1 << (place[kept] - 1)).astype(np.float64), minlength=int(start[-1])).astype(np.int64)
    run = np.concatenate([[0], np.bitwise_xor.accumulate(change)]) if len(change) else np.zeros(1, np.int64)
    size_out = np.where(good & (taken > 0), count, 0)
    values = run[1:][_spread(start[:-1], size_out)] ^ np.repeat(run[start[:-1]], size_out) if size_out.sum() else np.zeros(0, np.int64)
    null = ~good | texts.is_null().to_numpy(zero_copy_only=False)
    made = pa.ListArray.from_arrays(pa.array(_running(size_out), pa.int32()), pa.array(values, pa.int64()), mask=pa.array(null))
    again = np.flatnonzero(odd)
    if not len(again):
        return made
    rows = made.to_pylist()
    for k in again.tolist():
        rows[k] = decode_one(texts[k].as_py())
    return pa.array(rows, pa.list_(pa.int64()))


@arrow_udf(T.ArrayType(T.LongType()))
def decode(text: pa.Array) -> pa.Array:
    """DOM-09; run it on distinct fingerprints."""
    return decode_all(text)


def similarity(a: Column, b: Column, offsets: int = OFFSETS, least: int = LEAST_OVERLAP) -> Column:
    """DOM-10: 1 - bit error rate at the best shift with so many items in common at least; else 0."""

    def at(shift: Column) -> Column:
        x = F.slice(a, F.greatest(F.lit(1), 1 - shift), F.size(a))
        y = F.slice(b, F.greatest(F.lit(1), 1 + shift), F.size(b))
        n = F.least(F.size(x), F.size(y))
        wrong = F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
        return F.when(n >= least, 1 - wrong / (32 * n)).otherwise(0.0)

    return F.round(F.array_max(F.transform(F.sequence(F.lit(-offsets), F.lit(offsets)), at)), 3)


def near_in_range(left: DataFrame, right: DataFrame, block: list[str], measure: str, gap: float) -> DataFrame:
    """JOIN-12: pairs of rows that share their block and whose measures are at most gap apart. Rows of one side go to
    their bin of width gap and both beside it, so the join is on equal keys."""
    bin_of = F.floor(F.col(measure) / gap)
    x = left.select(*block, *(F.col(c).alias(f"{c}_1") for c in left.columns if c not in block), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("bin"))
    y = right.select(*block, *(F.col(c).alias(f"{c}_2") for c in right.columns if c not in block), bin_of.alias("bin"))
    return x.join(y, [*block, "bin"]).where(F.abs(F.col(f"{measure}_1") - F.col(f"{measure}_2")) <= gap).drop("bin")
