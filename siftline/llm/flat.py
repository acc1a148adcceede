"""Texts as flat numpy arrays: Arrow columns, words, n-grams and 64-bit hashes.

The hash of a run of symbols is a polynomial with an odd base, so the hash of any run comes from two
prefix sums; a finaliser then mixes it. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 18  # symbols that are worked on at a time; a longer text is a piece of its own
_U = np.uint64

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of lower-cased words: digits, a-z and everything beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: Bytes of tokens that end at ASCII white space.
SOLID_BYTE = np.ones(256, bool)
SOLID_BYTE[[32, 9, 10, 11, 12, 13]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least, kept between calls."""
    global _powers
    have = len(_powers[0])
    if have < n:
        size = max(n, 2 * have, PIECE + 1)
        up, down = np.full(size, BASE, _U), np.full(size, pow(BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run symbols[start:end]."""
    n = len(symbols)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((symbols.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = PIECE) -> np.ndarray:
    """run_hashes() of many runs in order of their starts, over about limit symbols at a time."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit)))
        a, b = int(starts[i]), int(ends[i:j].max())
        out[i:j] = run_hashes(symbols[a:b], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Rows first, last + 1 of pieces of at most limit symbols, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def portions(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """First byte, last + 1, first row and last + 1 of portions of about limit bytes. A longer row is cut where a word ends,
    so only a single word that is longer makes a portion longer."""
    limit = limit or PIECE
    for i, j in pieces(offsets, limit):
        a, end = int(offsets[i]), int(offsets[j])
        while end - a > limit:
            b = a + limit
            while b < end:
                gap = ~solid[LOWER[data[b : b + limit]]]
                if gap.any():
                    b += int(gap.argmax())
                    break
                b += limit
            if b >= end:
                break
            yield a, b, i, j
            a = b
        yield a, end, i, j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; none crosses an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(inside))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTE):
    """Lower-cased bytes, starts and ends of words, and the n + 1 offsets of each row's words."""
    low = LOWER[data]
    starts, ends = runs(kind[low], offsets)
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the n + 1 offsets of each row's; long rows are worked on in portions."""
    found, counts = [np.zeros(0, _U)], np.zeros(len(offsets) - 1, np.int64)
    for a, b, i, j in portions(data, offsets, kind):
        low, starts, ends, rows = words(data[a:b], np.clip(offsets[i : j + 1], a, b) - a, kind)
        found.append(run_hashes(low, starts, ends))
        counts[i:j] += np.diff(rows)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A mask of n places with those in any start:end set."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1], out=delta[:-1]) > 0
