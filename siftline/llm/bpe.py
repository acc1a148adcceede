"""Byte-level BPE over whole texts.

Texts are split by public_tokenizers.PATTERN, in bulk: character classes give the boundaries, and any other pattern is refused. A piece's
distinct pre-tokens are then resolved in two tiers. A minimal perfect hash over the vocabulary gives each a slot; if the slot's
key and bytes are the pre-token's, its id stands there. The others merge their bytes, which are linked to their neighbours, in the
order a heap gives, and a bounded memo keeps the results.

Null is an empty text and has no tokens. Any valid text is encoded, without special tokens. Rows with
the same id are encoded each by itself; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import flat

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE = 1 << 20  # bytes whose distinct pre-tokens are resolved together
MEMO = 600_000  # merged pre-tokens that a worker keeps
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Fixed value: the pattern that split() is written for.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
_U = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point, as the regex library has it."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


#: A token always ends between a letter and a single space before another letter.
_GAP = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def portions(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First byte, last + 1, first row and last + 1 of portions of about PIECE bytes; a longer row is cut where a token surely ends."""
    for i, j in flat.pieces(offsets, PIECE):
        a, end = int(offsets[i]), int(offsets[j])
        while end - a > PIECE:
            gap = _GAP.search(data, a + PIECE - 1, end)
            if not gap:
                break
            yield a, gap.end(), i, j
            a = gap.end()
        yield a, end, i, j


def split(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of code points; offsets are those of the rows."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[cps]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    start = run.copy()
    inner = np.flatnonzero(run & ~first)
    inner = inner[cls[inner] != SPACE]  # runs with something before them in their text
    after_space = inner[cls[inner - 1] == SPACE]
    start[after_space - 1] = True  # the last white space before a run stands by itself or joins it
    start[after_space[cps[after_space - 1] == 32]] = False
    # Contractions: an apostrophe that starts a token, then lower-case letters.
    quote = np.flatnonzero((cps == 39) & start & run)
    if len(quote):
        ahead = np.full(n + 3, 0, cps.dtype)
        ahead[:n] = cps
        fresh = np.ones(n + 3, bool)
        fresh[:n] = first
        a, b = ahead[quote + 1], ahead[quote + 2]
        one = ~fresh[quote + 1]
        size = np.where(one & np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        two = one & ~fresh[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(two, 2, size)
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        beyond = quote + 1 + size
        start[beyond[beyond < n]] = True
    return np.flatnonzero(start)


class PerfectHash:
    """A minimal perfect hash over 64-bit keys: each bucket of keys has a displacement that sends them to
    free slots; a bucket of one key has its slot itself."""

    def __init__(self, keys: np.ndarray):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        bucket = (keys % _U(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, self.slot = np.zeros(n, bool), np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        by_size = np.argsort(-np.diff(edges), kind="stable")
        free = None
        for b in by_size:
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            if len(own) == 1:
                free = free if free is not None else iter(np.flatnonzero(~taken).tolist())
                to = next(free)
                self.shift[b], self.slot[own[0]] = -to - 1, to
                continue
            base = 0
            while True:
                tries = np.arange(base, base + 256, dtype=np.int64)
                at = self._at(keys[own][:, None], tries[None, :])
                good = ~taken[at].any(0)
                if len(own) > 1:
                    s = np.sort(at, 0)
                    good &= (s[1:] != s[:-1]).all(0)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b], self.slot[own] = tries[k], at[:, k]
                    taken[at[:, k]] = True
                    break
                base += 256

    def _at(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (flat.mix(keys ^ (shift.astype(_U) * _U(flat.BASE))) % _U(max(self.n, 1))).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; one of the keys the hash was made for has that slot to itself."""
        shift = self.shift[(keys % _U(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, self._at(keys, np.maximum(shift, 0)))


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = dict(zip(ranks.values(), ranks, strict=True))
        whole = []
        for token in ranks:
            try:
                token.decode()
                whole.append(token)
            except UnicodeDecodeError:
                pass  # parts of characters are never whole pre-tokens
        cps = [np.frombuffer(t.decode().encode("utf-32-le"), np.uint32) for t in whole]
        ends = np.cumsum([len(c) for c in cps])
        keys = flat.run_hashes(np.concatenate(cps), np.concatenate([[0], ends[:-1]]), ends)
        self.hash = PerfectHash(keys)
        #: By slot: the token, its key and its id.
        self.at_slot: list[bytes] = [b""] * len(whole)
        for token, slot in zip(whole, self.hash.slot.tolist(), strict=True):
            self.at_slot[slot] = token
        self.key_at, self.id_at = np.empty(len(whole), _U), np.array([ranks[t] for t in self.at_slot], np.int64)
        self.key_at[self.hash.slot] = keys

    @classmethod
    def load(cls, path: str | None = None) -> Encoder:
        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the splitter is written for another pattern")
        path = path or public_tokenizers.path(RANKS)
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())})

    def merge(self, word: bytes) -> list[int]:
        """Merges pairs of neighbours, lowest rank and then leftmost first."""
        rank, n = self.ranks.get, len(word)
        due = [rank(word[i : i + 2], -1) for i in range(n - 1)]  # the rank of the pair that starts at a place
        due.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(due) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & place
            if due[i] != x >> bits:
                continue
            j = after[i]
            end = after[i] = after[j]
            due[j] = -1
            if end < n:
                before[end] = i
                due[i] = r = rank(word[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r << bits | i)
            else:
                due[i] = -1
            p = before[i]
            if p >= 0:
                due[p] = r = rank(word[p:end], -1)
                if r >= 0:
                    heappush(heap, r << bits | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def distinct(self, data: np.ndarray, offsets: np.ndarray):
        """The distinct pre-tokens of a piece, the id of each that is one token, else -1, and each row's pre-tokens as
        numbers of distinct ones, with the n + 1 offsets of the rows."""
        text = data.tobytes().decode()
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        starts = split(cps, at)
        ends = np.append(starts[1:], len(cps))
        rows = np.searchsorted(starts, at)
        h = flat.run_hashes(cps, starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        lengths = ends - starts
        if len(starts) and not ((lengths == lengths[first][inverse]).all() and (cps[flat.spread(starts, lengths)] == cps[flat.spread(starts[first][inverse], lengths)]).all()):
            tokens: dict[str, int] = {}  # two pre-tokens share a hash: number them by their text
            inverse = np.array([tokens.setdefault(text[a:b], len(tokens)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            made = [t.encode() for t in tokens]
            return made, [self.ranks.get(t, -1) for t in made], inverse, rows
        made = [text[a:b].encode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slots = self.hash(keys)
        ids = np.where(self.key_at[slots] == keys, self.id_at[slots], -1).tolist()
        return made, [i if i >= 0 and self.at_slot[s] == t else -1 for i, s, t in zip(ids, slots.tolist(), made, strict=True)], inverse, rows


class Memo(dict):
    """What make() gives for the ids of pre-tokens: by id for those that are one token, and a memo, which forgets all beyond MEMO
    entries, for merged ones."""

    def __init__(self, encoder: Encoder, make):
        super().__init__()
        self.encoder, self.make = encoder, make
        self.single = [None] * (max(encoder.token, default=-1) + 1)

    def of(self, words: list[bytes], ids: list[int]) -> list:
        if len(self) > MEMO:
            self.clear()
        out, make, encoder, get, single = [], self.make, self.encoder, self.get, self.single
        for word, one in zip(words, ids, strict=True):
            if one >= 0:
                x = single[one]
                if x is None:
                    x = single[one] = make([one], encoder)
            else:
                x = get(word)
                if x is None:
                    x = make(encoder.merge(word), encoder)
                    if len(word) <= 64:
                        self[word] = x
            out.append(x)
        return out


def _digest(ids: list[int], encoder: Encoder) -> tuple[int, bytes, bytes]:
    return len(ids), b",".join([b"%d" % i for i in ids]), encoder.decode(ids)


def _packed(ids: list[int], _: Encoder) -> bytes:
    return array("i", ids).tobytes()


def _short(ids: list[int], _: Encoder) -> bytes:
    return array("H", ids).tobytes()


_memos: dict[tuple, Memo] = {}


def memo(shared, make) -> Memo:
    """This worker's memo for a broadcast encoder."""
    key = (shared.value.__class__, id(shared.value), make.__name__)
    if key not in _memos:
        _memos.clear()
        _memos[key] = Memo(shared.value, make)
    return _memos[key]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, SHA-256 of the ids joined by commas and of the decoded bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.load(path))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memo(shared, _digest)
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            counts, ids, texts = np.zeros(len(offsets) - 1, np.int64), [], []
            for a, b, i, j in portions(data, offsets):
                words, whole, inverse, rows = found.encoder.distinct(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
                made = found.of(words, whole)
                sizes = np.array([m[0] for m in made], np.int64)
                strings, decoded = [m[1] for m in made], [m[2] for m in made]
                ends = np.concatenate([[0], np.cumsum(sizes[inverse])]) if len(made) else np.zeros(1, np.int64)
                for r, x, y in zip(range(i, j), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    own = inverse[x:y].tolist()
                    if r == len(ids):
                        ids.append(hashlib.sha256())
                        texts.append(hashlib.sha256())
                    elif own and counts[r]:
                        ids[r].update(b",")  # a row that was cut goes on
                    ids[r].update(b",".join([strings[k] for k in own]))
                    texts[r].update(b"".join([decoded[k] for k in own]))
                counts[i:j] += np.diff(ends[rows])
            digest = lambda x: pa.array([h.hexdigest() for h in x], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), digest(ids), digest(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def packed_rows(found: Memo, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The ids of each row, of the width that the memo packs them in."""
    held = b""
    for a, b, i, j in portions(data, offsets):
        words, whole, inverse, rows = found.encoder.distinct(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
        made = found.of(words, whole)
        for r, x, y in zip(range(i, j), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            held += b"".join([made[k] for k in inverse[x:y].tolist()])
            if offsets[r + 1] <= b:
                yield held
                held = b""


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, tokens (array of ids) and decoded (the text that decoding them gives)."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.load(path))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memo(shared, _packed)
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                data, offsets = flat.flat(batch.column(1))
                ids = [np.frombuffer(x, np.int32) for x in packed_rows(found, data, offsets)]
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edges), pa.int64()), tokens, pa.array([found.encoder.decode(x.tolist()).decode() for x in ids], pa.string())], ["doc_id", "n_tokens", "tokens", "decoded"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, tokens array<int>, decoded string")


def op2(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
