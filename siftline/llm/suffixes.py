"""Removal of byte passages that an earlier document has, from suffix arrays built column by column.

Which windows of 50 bytes can be equal is found first: each window's anchor is its 20 bytes of smallest
hash, so equal windows have equal anchors at equal places. Windows that follow each other and share their
anchor are one segment. Anchors that only one document has are set aside by sums of packed keys over all
documents. Segments of the others go, distinct ones once from each chunk, to the leaf of their anchor; relays on the
way merge equal ones. An anchor that over HOT documents have would gather too many segments there: its segments go as single
windows instead, each to the leaf of its own hash.

A leaf sorts the suffixes of all distinct segments that share an anchor with others by the multi-document construction: in each
round it inserts one symbol of every segment, from the last to the first, into the collection's Burrows-Wheeler
transform, and updates the common prefixes of neighbours. The columns (symbol, common prefix, suffix) are read and written from front to
end, block by block: a first pass over the last round's columns finds the new rows' places and common prefixes, a second merges
them in. Columns stay in memory up to FILE_ROWS rows; beyond, they are files in the shared folder, one set for each round. Rows whose
common prefixes reach 50 bytes are equal windows; their smallest document goes back to the chunks.

Ids are integers; other types are refused. Null is an empty text. Texts of under 50 bytes lose nothing. Rows with the same id don't shorten one another.
A null id counts as larger than any other. Identical segments are told by 64-bit hashes. Long texts are worked on in overlapping pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import flat, scatter, shared

WINDOW = 50
ANCHOR = 20
DROP = 17  # bits of an anchor's key that aren't sent
HOT = 1 << 14  # documents with an anchor, beyond which its windows go each by itself
COLLECTION = 8192  # segments that are sorted together, but for those that share an anchor
BLOCK = 1 << 20  # rows of a column that are read at a time
FILE_ROWS = 1 << 24
LAST = np.iinfo(np.int64).max
_U = np.uint64


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Anchor hash, start, end and row of each segment of a piece."""
    none = np.zeros(0, np.int64)
    starts_ok = np.maximum(np.diff(offsets) - window + 1, 0)  # windows of each row
    if not starts_ok.any():
        return np.zeros(0, _U), none, none, none
    n = len(data)
    up, down = flat.powers(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    h = flat.mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    low = _U(0xFFFFFFFF)
    least = (h & ~low) | np.arange(len(h), dtype=_U)  # the smallest hash, then the first
    span, width = 1, window - anchor + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    at = flat.spread(offsets[:-1], starts_ok)
    row = np.repeat(np.arange(len(starts_ok)), starts_ok)
    place = (least[at] & low).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    k = np.flatnonzero(first)
    ends = at[np.append(k[1:], len(at)) - 1] + window
    # The smallest hashes crowd at the low end; mixed again, they spread over the buckets.
    return flat.mix(h[place[k]] + _U(1)), at[k], ends, row[k]


class Columns:
    """The columns of one round, written once from front to end and then read so, any number of times."""

    def __init__(self, folder: str | None = None):
        self.rows, self.blocks, self.sizes, self.folder = 0, [], [], folder
        if folder:
            from siftline.llm import warc

            self.fs, top = warc.open_folder(folder)
            self.fs.create_dir(top, recursive=True)
            self.path = f"{top}/{uuid.uuid4().hex}"
            self.sink = self.fs.open_output_stream(self.path)

    def add(self, *block: np.ndarray) -> None:
        self.rows += len(block[0])
        if self.folder:
            self.sizes.append(len(block[0]))
            self.kinds = [x.dtype for x in block]
            for x in block:
                self.sink.write(np.ascontiguousarray(x).data)
        else:
            self.blocks.append(block)

    def done(self) -> Columns:
        if self.folder:
            self.sink.close()
        return self

    def read(self) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.folder:
            yield from self.blocks
            return
        with self.fs.open_input_stream(self.path) as source:
            for n in self.sizes:
                yield tuple(np.frombuffer(source.read(n * kind.itemsize), kind) for kind in self.kinds)

    def drop(self) -> None:
        if self.folder:
            self.fs.delete_file(self.path)


class _Neighbours:
    """While blocks go by: the least common prefix since the last row of each symbol, and rows that wait for the next one of theirs."""

    def __init__(self):
        self.since = np.full(256, 255, np.uint8)
        self.seen = np.zeros(256, bool)
        self.waiting = np.full(256, -1)
        self.after = np.full(256, 255, np.uint8)


def _place(columns: Columns, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows by place: the number of rows with their symbol before, and one more than the least common prefix since the last
    of them and up to the next one, 0 if there is none, 254 at most; and the number of rows of each symbol."""
    count = np.zeros(256, np.int64)
    rank, before, after = np.empty(len(place), np.int64), np.zeros(len(place), np.uint8), np.zeros(len(place), np.uint8)
    state, a, many = _Neighbours(), 0, columns.rows > BLOCK
    for bwt, lcp, _ in columns.read():
        n = len(bwt)
        i, j = np.searchsorted(place, [a, a + n])
        own, c = place[i:j] - a, symbol[i:j]
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        sizes = np.bincount(bwt, minlength=256)
        first = np.cumsum(sizes) - sizes
        at = np.empty(n, np.int32)
        at[order] = np.arange(n, dtype=np.int32)
        k = at[own]
        rank[i:j] = count[c] + k - first[c]
        tied, followed = k > first[c], k + 1 < first[c] + sizes[c]
        before[i:j] = _least(lcp, order[k - 1] + 1, own + 1, tied)
        after[i:j] = _least(lcp, own + 1, order[np.minimum(k + 1, n - 1)] + 1, followed)
        if many:
            here = sizes > 0
            up, down = np.minimum.accumulate(lcp), np.minimum.accumulate(lcp[::-1])[::-1]
            alone = np.flatnonzero(~tied & state.seen[c])
            before[i:j][alone] = np.minimum(np.minimum(state.since[c[alone]], up[own[alone]]), 253) + 1
            due = np.flatnonzero(here & (state.waiting >= 0))
            after[state.waiting[due]] = np.minimum(np.minimum(state.after[due], up[order[first[due]]]), 253) + 1
            state.waiting[here] = -1
            state.after = np.minimum(state.after, up[-1])
            last = order[(first + sizes - 1)[here]].astype(np.int64)
            rest = np.append(down, 255)[last + 1]
            state.since = np.minimum(state.since, up[-1])
            state.since[here], state.seen[here] = rest, True
            open_ = np.flatnonzero(~followed)
            state.waiting[c[open_]], state.after[c[open_]] = i + open_, np.append(down, 255)[own[open_] + 1]
        count += sizes
        a += n
    return rank, before, after, count


def _least(lcp: np.ndarray, first: np.ndarray, last: np.ndarray, which: np.ndarray) -> np.ndarray:
    """One more than the least of lcp[first:last], where which holds; else 0."""
    out = np.zeros(len(first), np.uint8)
    a, b = first[which], last[which]
    if len(a):
        at = np.empty(2 * len(a), np.int64)
        at[::2], at[1::2] = a, b
        out[which] = np.minimum(np.minimum.reduceat(lcp if at.max() < len(lcp) else np.append(lcp, np.uint8(255)), at)[::2], 253) + 1
    return out


def construct(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, folder: str | None = None) -> Columns:
    """The columns of the strings text[start:end]: the transform, each row's common prefix with the row before, 254 at
    most, and the row's suffix, as string * (1 + the longest length) + the suffix's length. Row i < m is the end of string i; ends
    differ and precede all symbols. 0 in the transform stands for the end of a string, and a symbol for its
    place among those that occur."""
    m = len(starts)
    used = np.zeros(256, bool)
    used[text] = True
    symbols = np.cumsum(used).astype(np.uint8)[text]  # UTF-8 never uses all byte values, so none overflows
    lengths = ends - starts
    base = int(lengths.max(initial=0)) + 1
    kind = np.uint32 if m * base < 1 << 32 else np.uint64
    held = folder if int(lengths.sum()) + m > FILE_ROWS else None
    live, symbol = np.flatnonzero(lengths > 0), symbols[ends[lengths > 0] - 1]
    place, columns = live, Columns(held)
    for a in range(0, m, BLOCK):
        own = np.arange(a, min(a + BLOCK, m))
        bwt = np.zeros(len(own), np.uint8)
        bwt[lengths[own] > 0] = symbols[ends[own[lengths[own] > 0]] - 1]
        columns.add(bwt, np.zeros(len(own), np.uint8), (own * base).astype(kind))
    columns.done()
    done = 0
    while len(live):
        rank, before, after, count = _place(columns, place, symbol)
        count[0] = m
        new = (np.cumsum(count) - count)[symbol] + rank
        by = np.argsort(new)
        live, new, before, after = live[by], new[by], before[by], after[by]
        done += 1
        more = lengths[live] > done
        symbol = np.where(more, symbols[np.maximum(ends[live] - done - 1, 0)], 0).astype(np.uint8)
        suffix = (live * base + done).astype(kind)
        gap = new - np.arange(len(new))  # the old row that each new one comes before
        following, now, a, old_rows = new + 1, Columns(held), 0, columns.rows
        for bwt, lcp, who in columns.read():
            b = a + len(bwt)
            i, j = np.searchsorted(gap, [a, b]) if b < old_rows else (np.searchsorted(gap, a), len(gap))
            out, n = a + int(i), len(bwt) + int(j - i)
            old = np.ones(n, bool)
            old[new[i:j] - out] = False
            made = np.empty(n, np.uint8), np.empty(n, np.uint8), np.empty(n, kind)
            for column, was, own in zip(made, (bwt, lcp, who), (symbol, before, suffix), strict=True):
                column[old] = was
                column[~old] = own[i:j]
            p, q = np.searchsorted(following, [out, out + n])
            made[1][following[p:q] - out] = after[p:q]
            for k in range(0, n, BLOCK):
                now.add(*(x[k : k + BLOCK] for x in made))
            a = b
        columns.drop()
        columns = now.done()
        live, place, symbol = live[more], new[more], symbol[more]
    return columns


def first_owner(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, window: int = WINDOW, folder: str | None = None) -> np.ndarray:
    """For each window of each string, one after the other, the smallest owner of a string with an equal window."""
    lengths = ends - starts
    columns = construct(text, starts, ends, folder)
    base = int(lengths.max(initial=0)) + 1
    windows = np.maximum(lengths - window + 1, 0)
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)

    def settle(lcp: np.ndarray, who: np.ndarray) -> None:
        string, size = np.divmod(who.astype(np.int64), base)
        whole = size >= window
        heads = np.flatnonzero(np.append(True, lcp[1:] < window))
        least = np.minimum.reduceat(np.where(whole, owner[string], LAST), heads)
        least = np.repeat(least, np.diff(np.append(heads, len(lcp))))
        out[first[string[whole]] + lengths[string[whole]] - size[whole]] = least[whole]

    lcps, whos = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
    for _, lcp, who in columns.read():
        lcps, whos = np.append(lcps, lcp), np.append(whos, who)
        cut = np.flatnonzero(lcps < window)  # rows of a group may go on in the next block
        if len(cut) and cut[-1]:
            settle(lcps[: cut[-1]], whos[: cut[-1]])
            lcps, whos = lcps[cut[-1] :], whos[cut[-1] :]
    if len(lcps):
        settle(lcps, whos)
    columns.drop()
    return out


# --- segments of a chunk --------------------------------------------------------------------------------


def _all_segments(table: pa.Table, window: int):
    """Bytes, offsets, and of all segments: anchor, start, end and row."""
    data, offsets = flat.flat(table.column("text"))
    parts = [(np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3)]
    for i, j in flat.pieces(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        long = b - a > flat.PIECE
        for x in range(a, max(a + 1, b - window + 1), flat.PIECE if long else b - a or 1):
            y = min(x + flat.PIECE + window - 1, b) if long else b
            key, start, end, row = segments(data[x:y], np.array([0, y - x]) if long else offsets[i : j + 1] - a, window)
            parts.append((key, start + x, end + x, row + i))
    key, start, end, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    return data, offsets, key & ~_U((1 << DROP) - 1), start, end, row


def _candidates(table: pa.Table, met: pa.Table, window: int, hot: int):
    """Bytes, offsets, and key, start, end, row and hash of the strings of a chunk that other documents may have: segments, or windows of hot anchors."""
    data, offsets, key, start, end, row = _all_segments(table, window)
    own, inverse = np.unique(key, return_inverse=True)
    documents, _ = scatter.in_order(met)
    keep = documents[inverse] > 1 if len(own) else np.zeros(0, bool)
    key, start, end, row, often = key[keep], start[keep], end[keep], row[keep], documents[inverse[keep]] > hot
    if often.any():
        windows = (end - start - window + 1)[often]
        at, rows = flat.spread(start[often], windows), np.repeat(row[often], windows)
        mine = flat.mix(flat.hashes(data, at, at + window) + _U(1)) & ~_U((1 << DROP) - 1)
        key, start, end, row = (np.concatenate([x[~often], y]) for x, y in ((key, mine), (start, at), (end, at + window), (row, rows)))
        by = np.argsort(start, kind="stable")
        key, start, end, row = key[by], start[by], end[by], row[by]
    return data, offsets, key, start, end, row, flat.hashes(data, start, end)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(LAST).to_numpy()


def _distinct(hashes: np.ndarray, ids: np.ndarray):
    """Of each distinct hash: one place, the smallest id and whether there are several."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(h))[: len(first)] - 1
    return order[first], i[first], i[first] != i[last]


class Strings:
    """The strings that a relay or a leaf was sent, and the distinct ones among them, which are told by their hashes."""

    def __init__(self, bodies: list):
        parts = [self._unpacked(b) for b in bodies]
        self.counts = [len(p[0]) for p in parts]
        key, lengths, self.ids, self.several, self.text = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum(lengths)
        h = flat.hashes(self.text, ends - lengths, ends)
        self.own, place, self.inverse = np.unique(h, return_index=True, return_inverse=True)
        self.key, self.lengths, self.ends = key[place], lengths[place], ends[place]
        self.owner, most = np.full(len(self.own), LAST), np.full(len(self.own), -LAST - 1)
        np.minimum.at(self.owner, self.inverse, self.ids)
        np.maximum.at(most, self.inverse, self.ids)
        self.shared = (self.owner < most) | (np.bincount(self.inverse, self.several, minlength=len(self.own)) > 0)
        self.by_key = np.argsort(self.key, kind="stable")

    @staticmethod
    def _unpacked(body):
        key, at = scatter.unpack_sorted(body)
        n = len(key)
        lengths = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
        ids = np.frombuffer(bytes(body[at + n : at + 9 * n]), np.int64)
        return key << _U(DROP), lengths, ids, np.frombuffer(body, np.uint8, n, at + 9 * n).astype(bool), np.frombuffer(body, np.uint8, offset=at + 10 * n)

    @staticmethod
    def packed(key, lengths, ids, several, data, starts, ranges: int) -> dict[int, bytes]:
        """Bodies for ranges; strings by key."""
        return {
            p: scatter.pack_sorted(key[i:j], DROP) + lengths[i:j].astype(np.uint8).tobytes() + ids[i:j].tobytes() + several[i:j].astype(np.uint8).tobytes() + data[flat.spread(starts[i:j], lengths[i:j])].tobytes()
            for p, i, j in scatter.spans(key, ranges)
        }

    def merged(self, ranges: int) -> dict[int, bytes]:
        k = self.by_key
        return self.packed(self.key[k], self.lengths[k], self.owner[k], self.shared[k], self.text, (self.ends - self.lengths)[k], ranges)

    def answers(self, found: np.ndarray, known: np.ndarray, window: int) -> list[bytes]:
        """For each sender those strings that aren't its own alone, each with its hash and, by runs of windows, their first owners.
        found: of all windows of distinct strings; known: which of these have any."""
        windows = np.where(known, self.lengths - window + 1, 0)
        first = np.cumsum(windows) - windows
        lowest = np.full(len(self.own), LAST)
        if known.any():
            lowest[known] = np.minimum.reduceat(found, first[known])
        out, at = [], 0
        for n in self.counts:
            g = self.inverse[at : at + n]
            g = g[known[g] & (self.several[at : at + n] | (lowest[g] < self.ids[at : at + n]))]
            at += n
            changes = found[flat.spread(first[g], windows[g])]
            new = np.ones(len(changes), bool)
            new[1:] = changes[1:] != changes[:-1]
            new[np.cumsum(windows[g]) - windows[g]] = True
            runs = np.flatnonzero(new)
            out.append(np.array([len(g), len(runs)], np.uint32).tobytes() + self.own[g].tobytes() + changes[runs].tobytes() + windows[g].astype(np.uint8).tobytes() + np.diff(np.append(runs, len(changes))).astype(np.uint8).tobytes())
        return out


def _told(bodies: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the strings told of, sorted, their numbers of windows, and the first owners of all these windows."""
    hashes, owners, widths, lens = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for body in bodies:
        n, r = np.frombuffer(body, np.uint32, 2).tolist()
        hashes.append(np.frombuffer(body, _U, n, 8))
        owners.append(np.frombuffer(body, np.int64, r, 8 + 8 * n))
        widths.append(np.frombuffer(body, np.uint8, n, 8 + 8 * n + 8 * r))
        lens.append(np.frombuffer(body, np.uint8, r, 8 + 9 * n + 8 * r))
    hashes, owners, widths, lens = (np.concatenate(x) for x in (hashes, owners, widths, lens))
    by, widths = np.argsort(hashes), widths.astype(np.int64)
    first = np.cumsum(widths) - widths
    return hashes[by], widths[by], np.repeat(owners, lens)[flat.spread(first[by], widths[by])]


def _looked_up(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among the sorted known ones, and where."""
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    return known[at] == hashes if len(known) else np.zeros(len(hashes), bool), at


def _sort(bodies: list, window: int, folder: str | None) -> list[bytes]:
    """A leaf's answers."""
    s = Strings(bodies)
    windows = s.lengths - window + 1
    first = np.cumsum(windows) - windows
    found = np.repeat(s.owner, windows)  # an anchor's only segment has no windows in common with others
    keys = s.key[s.by_key]
    alone = np.ones(len(keys), bool)
    alone[1:] &= keys[1:] != keys[:-1]
    alone[:-1] &= keys[1:] != keys[:-1]
    rest, keys = s.by_key[~alone], keys[~alone]
    i = 0
    while i < len(rest):
        j = min(i + COLLECTION, len(rest))
        j = int(np.searchsorted(keys, keys[j - 1], "right"))  # an anchor's segments stay together
        p = rest[i:j]
        size = s.lengths[p]
        local = np.cumsum(size)
        found[flat.spread(first[p], windows[p])] = first_owner(s.text[flat.spread(s.ends[p] - size, size)], local - size, local, s.owner[p], window, folder)
        i = j
    return s.answers(found, np.ones(len(s.own), bool), window)


def _pass_back(bodies: list, answers: list, window: int) -> list[bytes]:
    s = Strings(bodies)
    hashes, widths, owners = _told(answers)
    known, at = _looked_up(s.own, hashes)
    first = np.cumsum(widths) - widths
    return s.answers(owners[flat.spread(first[at[known]], widths[at[known]])], known, window)


def passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep: bool = False, hot: int = HOT, **layout) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans and kept_sha256. With keep, all columns of docs instead, text
    without the characters that lie wholly in removed bytes."""
    if keep:
        own = {doc_id: "doc_id", text: "text"}
        chunks, kind = docs.toDF(*(own.get(c) or f"kept_{uuid.uuid4().hex}" for c in docs.columns)), docs.schema  # so that no name clashes
    else:
        chunks, kind = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    id_type = chunks.schema["doc_id"].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{doc_id} is {id_type}; ids must be integers, as the smaller one keeps a passage")
    chunks = chunks.withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks, layout = scatter.chunked(chunks, "text", "doc_id", **layout)
    folder = shared.folder(docs.sparkSession, "columns")

    def anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, _, key, _, _, row = _all_segments(table, window)
        order = np.argsort(key, kind="stable")  # rows of an anchor stay in order
        key, row = key[order], row[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        other = fresh.copy()
        other[1:] |= row[1:] != row[:-1]
        return key[first], np.add.reduceat(other.astype(np.int64), first) if len(first) else first

    def candidates(table: pa.Table, met: pa.Table) -> dict[int, bytes]:
        data, _, key, start, end, row, h = _candidates(table, met, window, hot)
        one, least, several = _distinct(h, _ids(table)[row])
        order = np.argsort(key[one], kind="stable")
        one, least, several = one[order], least[order], several[order]
        return Strings.packed(key[one], (end - start)[one], least, several, data, start[one], layout.ranges(1))

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        data, offsets, _, start, _, row, h = _candidates(table, scatter.of_round(told, 0), window, hot)
        hashes, widths, owner = _told(scatter.by_sender(scatter.of_round(told, 1), "_place")[1])
        known, at = _looked_up(h, hashes)
        mine, at = np.flatnonzero(known), at[known]
        later = owner[flat.spread((np.cumsum(widths) - widths)[at], widths[at])] < np.repeat(_ids(table)[row[mine]], widths[at])
        where = flat.spread(start[mine], widths[at])[later]
        gone = flat.covered(where, where + window, len(data))
        if kind is not None:
            return _kept(table, data, offsets, gone)
        begin, _ = flat.runs(gone, offsets)
        removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
        rest = data[~gone].tobytes()
        edges = (offsets - removed).tolist()
        shas = [hashlib.sha256(rest[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(np.searchsorted(begin, offsets))), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def _kept(table: pa.Table, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Table:
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        if len(lead):
            whole = np.minimum.reduceat(gone.astype(np.uint8), lead).astype(bool)
            gone = np.repeat(whole, np.diff(np.append(lead, len(data))))
        rest = data[~gone].tobytes()
        edges = (offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]).tolist()
        null = table.column("text").is_null().to_pylist()
        texts = [None if x else rest[a:b].decode() for a, b, x in zip(edges[:-1], edges[1:], null, strict=True)]
        table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return table.drop_columns(["_chunk"])

    met, _ = scatter.sums(chunks, anchors, layout, DROP)
    asked = scatter.ask(chunks, candidates, layout, met)
    told, _ = scatter.exchange(asked, layout, lambda bodies: _sort(bodies, window, folder), lambda bodies, ranges: Strings(bodies).merged(ranges), lambda bodies, answers: _pass_back(bodies, answers, window))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if kind is None else chunks.drop("_chunk").schema
    out = scatter.beside(chunks, [met, told], layout, cut, fields).withColumn("doc_id", F.col("doc_id").cast(id_type))
    return out if kind is None else out.toDF(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, doc_id, 256 * k AS base, substr(x, 512 * k + 1, 610) AS y FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 512 + 1)) AS k FROM d)),
w AS (SELECT r, doc_id, base + q AS p, substr(y, 2 * q + 1, 100) AS s FROM (SELECT r, doc_id, base, y, unnest(range(0, least(256, length(y) // 2 - 49))) AS q FROM c)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT r, p FROM w JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) > 50 AS fresh FROM h),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY p) AS k FROM g) GROUP BY r, k),
e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
