"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Automata are built in tasks, one for each MAX_ITEM_BYTES of items, and written to the shared folder. A task that scans documents
holds one automaton at a time, so neither the driver nor a broadcast grows with the items; several are read in turn for each
batch of documents, without a shuffle. A document's words are hashed in bulk; only stretches whose neighbouring word pairs all occur in items
reach the automaton, which then reads the words themselves, so a hash collision can't add a match.

Nulls and empty texts have no words and come back clean. Items without words match nothing. An item without an id hits words but isn't
listed or counted; rows with equal ids are one item with the windows of each. Rows of documents with
the same id are judged each by itself. Other columns of the inputs are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import flat, shared, warc

MAX_ITEM_BYTES = 2 << 20  # of an automaton's items; it then takes some 200 MB
WINDOW = 10
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPANS = "array<struct<first_word:long,last_word:long,first_byte:long,last_byte:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.translate(_LOW)) if text else []


_LOW = bytes(flat.LOWER)


class SuffixAutomaton:
    """All word runs of a set of items. Each state has its longest length, its suffix link and the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        seen: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        whole = []
        for k, (_, words) in enumerate(items):
            at = 0
            for word in words:
                at = self._add(at, word, seen)
                seen[at].add(k)
            whole.append(at)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            seen[self.link[v]] |= seen[v]
        #: For each state, the width of the window that ends there and the items with it: the window of
        #: full width, or whole items that are shorter.
        short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                short.setdefault(whole[k], []).append((len(words), k))
        self.ends: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.length)
        for v in reversed(order):
            own = [(w, (k,)) for w, k in short.get(v, ())]
            if self.length[self.link[v]] < window <= self.length[v]:
                own.append((window, tuple(k for k in sorted(seen[v]) if len(items[k][1]) >= window)))
            self.ends[v] = self.ends[self.link[v]] + tuple(own)
        lengths = [min(len(words), window) for _, words in items if words]
        self.least = min(lengths, default=0)
        first = {word: flat.run_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] for _, words in items for word in words}
        self.vocabulary = np.unique(np.array(list(first.values()), np.uint64))
        pairs = {(first[a], first[b]) for _, words in items for a, b in zip(words, words[1:], strict=False)}
        self.pairs = np.unique(flat.mix(np.array([a for a, _ in pairs], np.uint64) * np.uint64(3) + np.array([b for _, b in pairs], np.uint64)))

    def _add(self, last: int, word: bytes, seen: list[set[int]]) -> int:
        def state(length: int, link: int, after: dict, items: set) -> int:
            self.length.append(length)
            self.link.append(link)
            self.next.append(after)
            seen.append(items)
            return len(self.length) - 1

        def split(p: int, q: int) -> int:
            """The state for the runs of q that are one word longer than p's."""
            r = state(self.length[p] + 1, self.link[q], dict(self.next[q]), set())
            self.link[q] = r
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = r
                p = self.link[p]
            return r

        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        new = state(self.length[last] + 1, 0, {}, set())
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged runs first, last + 1 of hit words, and the items with windows there."""
        at, long, hits, items = 0, 0, [], set()
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                long = self.length[at]
            at = self.next[at].get(word, 0)
            long = long + 1 if at else 0
            for width, names in self.ends[at]:
                if width <= long:
                    items.update(names)
                    first = i + 1 - width
                    while hits and hits[-1][1] >= first:
                        first = min(first, hits.pop()[0])
                    hits.append((first, i + 1))
        return hits, items

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """For each row: its number of words, its hit runs (first word, last word + 1, first byte, last byte + 1) and the items."""
        low, starts, ends, rows = flat.words(data, offsets)
        n = len(offsets) - 1
        hits: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
        items: list[set[int]] = [set() for _ in range(n)]
        if len(starts) and self.least:
            h = flat.run_hashes(low, starts, ends)
            known = _within(h, self.vocabulary)
            if self.least == 1:
                stretch = known
            else:
                joined = np.zeros(len(h), bool)
                both = np.flatnonzero(known[:-1] & known[1:])
                joined[both] = _within(flat.mix(h[both] * np.uint64(3) + h[both + 1]), self.pairs)
                joined[rows[(rows > 0) & (rows <= len(h))] - 1] = False
                stretch = joined
            first, last = flat.runs(stretch, rows)
            if self.least > 1:
                last = last + 1
            row = np.searchsorted(rows, first, "right") - 1
            for a, b, r in zip(first.tolist(), last.tolist(), row.tolist(), strict=True):
                if b - a >= self.least:
                    found, which = self.matches([low[starts[k] : ends[k]].tobytes() for k in range(a, b)])
                    hits[r] += [(a + x - int(rows[r]), a + y - int(rows[r]), int(starts[a + x] - offsets[r]), int(ends[a + y - 1] - offsets[r])) for x, y in found]
                    items[r] |= which
        return np.diff(rows), hits, items


def long_scan(automaton: SuffixAutomaton, data: np.ndarray, offsets: np.ndarray, window: int, limit: int = flat.PIECE):
    """automaton.scan() of one long row, in portions that end with a word and begin window - 1 words before the last one's end, so each window is whole in one of them."""
    at, end, before, size = 0, len(data), 0, limit
    hits: list[tuple[int, int, int, int]] = []
    items: set[int] = set()
    while True:
        last = min(end, at + size)
        while last < end and flat.WORD_BYTE[flat.LOWER[data[last]]]:
            gap = ~flat.WORD_BYTE[flat.LOWER[data[last : last + limit]]]
            last += int(gap.argmax()) if gap.any() else len(gap)
        own = np.array([0, last - at])
        (count,), (found,), (which,) = automaton.scan(data[at:last], own)
        hits = _merged(hits + [(x + before, y + before, p + at, q + at) for x, y, p, q in found])
        items |= which
        if last == end:
            return np.array([before + int(count)]), [hits], [items]
        starts = flat.words(data[at:last], own)[1]
        again = min(len(starts), window - 1)
        begin = int(starts[len(starts) - again]) if again else last - at
        if begin:
            before, at, size = before + len(starts) - again, at + begin, limit
        else:  # few words, and long ones
            size = 2 * size


def _within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h


class Automata:
    """The automata of all items, in a shared folder; one at a time is loaded."""

    loaded: tuple | None = None

    def __init__(self, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, max_bytes: int = MAX_ITEM_BYTES):
        items = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("text is not null")
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count, self.folder, self.window = -(-total // max_bytes), shared.folder(items.sparkSession, "automata"), window

        def build(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("name").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r))
            made = SuffixAutomaton([(name, words_of(t.encode())) for name, t in rows], window)
            return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int64()), "body": pa.array([pickle.dumps(made)], pa.binary())})

        dealt = items.withColumn("k", F.pmod(F.xxhash64("name", "text", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))), F.lit(max(self.count, 1))))
        dealt.groupBy("k").applyInArrow(build, "k long, body binary").write.parquet(self.folder)

    def each(self) -> Iterator[SuffixAutomaton]:
        for k in range(self.count):
            if Automata.loaded is None or Automata.loaded[:2] != (self.folder, k):
                Automata.loaded = None
                fs, top = warc.open_folder(self.folder)
                found = pyarrow.dataset.dataset(top, filesystem=fs, format="parquet").to_table(filter=pyarrow.dataset.field("k") == k).column("body")
                Automata.loaded = (self.folder, k, pickle.loads(found[0].as_py()) if len(found) else SuffixAutomaton([]))
            yield Automata.loaded[2]

    def scan(self, column) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[set[str]]]:
        """For each text: its number of words, its merged hit runs and the ids of the items."""
        data, offsets = flat.flat(column)
        n = len(offsets) - 1
        counts, hits, names = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
        if not self.count:
            for a, b, i, j in flat.portions(data, offsets, flat.WORD_BYTE):
                counts[i:j] += np.diff(flat.words(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)[3])
        for automaton in self.each():
            for i, j in flat.pieces(offsets):
                scan = automaton.scan if offsets[j] - offsets[i] <= flat.PIECE else lambda *whole: long_scan(automaton, *whole, self.window)  # noqa: B023
                counts[i:j], found, which = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for r, (runs, items) in enumerate(zip(found, which, strict=True), i):
                    if runs:
                        hits[r] = _merged(hits[r] + runs)
                        names[r] |= {automaton.names[x] for x in items} - {None}
        return counts, hits, names


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(runs):
        if out and x[0] <= out[-1][1]:
            if x[1] > out[-1][1]:
                out[-1] = (out[-1][0], x[1], out[-1][2], x[3])
        else:
            out.append(x)
    return out


def find(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """For each row of docs: doc_id, n_words, spans and items (sorted texts of ids)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    automata = Automata(items, item_id, item_text, window, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("first_word", "last_word", "first_byte", "last_byte")]))
        for batch in batches:
            counts, hits, names = automata.scan(batch.column(1))
            spans = [[dict(zip(("first_word", "last_word", "first_byte", "last_byte"), s, strict=True)) for s in x] for x in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(spans, kind), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, spans {_SPANS}, items array<string>")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the byte spans, one line break in place of each."""
    data, out, at = text.encode(), [], 0
    for first, last in spans:
        out.append(data[at:first])
        at = last
    return b"\n".join([*out, data[at:]]).decode()


def remove(docs: DataFrame, items: DataFrame, *, max_coverage: float = 0.5, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without hit spans; those with more than max_coverage of their words hit go altogether.

    Cutting may bring words together that make a new window, so it is repeated until none is left.
    All columns of docs are kept; text is the cut text."""
    automata = Automata(items, window=window)
    place, schema = docs.columns.index(text), docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, len(whole), 1000)):
            column = batch.column(place)
            counts, hits, _ = automata.scan(column)
            hit = {r: x for r, x in enumerate(hits) if x}
            dropped = {r for r, x in hit.items() if sum(s[1] - s[0] for s in x) > max_coverage * counts[r]}
            open_ = {r: x for r, x in hit.items() if r not in dropped}
            changed = {r: column[r].as_py() for r in open_}
            while open_:
                changed |= {r: cut(changed[r], [s[2:] for s in x]) for r, x in open_.items()}
                rows = list(open_)
                again = automata.scan(pa.array([changed[r] for r in rows], pa.string()))[1]
                open_ = {r: x for r, x in zip(rows, again, strict=True) if x}
            if changed:
                batch = batch.set_column(place, batch.schema.field(place), pa.array([changed.get(r, x) for r, x in enumerate(column.to_pylist())], column.type))
            if dropped:
                batch = batch.filter(pa.array([r not in dropped for r in range(len(batch))], pa.bool_()))
            yield batch

    return docs.mapInArrow(clean, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.last_word - s.first_word)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS k, w[p : p + least(len(w), 10) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, p, w[p : p + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, p, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM m)) GROUP BY r),
n AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
