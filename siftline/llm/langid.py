"""Language identification of mixed texts.

The script of a word's first letter narrows the languages to those whose training texts use that script.
A word's score in a language is the sum of the log probabilities of its letter trigrams, word ends included,
in a table of SLOTS hashed trigrams. Viterbi over the words, with a penalty for each switch, labels spans;
all texts of a batch step along together. A text's language is the one with most letters in spans.

The model is fitted on labelled texts, of each language about MAX_TRAINING at most, chosen by a hash of the
text; its size depends on SLOTS and the number of languages only, and more than MAX_LANGS languages are refused.

Null, empty and letterless texts are "und" with score 0. With no labelled text every text is "und". Ties go
to the first language by name. Rows are judged each by itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import bpe, flat

SLOTS = 1 << 16
MAX_TRAINING = 20_000
MAX_LANGS = 256
PENALTY = 6.0  # nats
SCRIPT_SHARE = 0.001  # of a language's letters, for the script to count as its own
BATCH = 8 << 20  # bytes of text that step along together
#: First and last code points of scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its script, 0 for none of the list."""
    if not _tables:
        script = np.zeros(0x110000, np.uint8)
        for k, spans in enumerate(SCRIPTS.values(), 1):
            for first, last in spans:
                script[first : last + 1] = k
        _tables.append((bpe.classes() == bpe.LETTER, script))
    return _tables[0]


class Words:
    """The words of a piece of texts: runs of letters. slots: of each letter's trigram, all words' one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, script = tables()
        text = data.tobytes().decode()
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case; they stay as they are
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        cps = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        inside = letter[cps]
        starts, ends = flat.runs(inside, at)
        x = np.where(inside, cps, 0).astype(np.uint64)
        ends_at = at[(at > 0) & (at < len(x))]
        before, after = np.zeros_like(x), np.zeros_like(x)
        before[1:], after[:-1] = x[:-1], x[1:]
        before[ends_at], after[ends_at - 1] = 0, 0
        mixed = (before * np.uint64(0x9E3779B1) + x) * np.uint64(0x85EBCA77) + after
        self.slots = ((mixed * np.uint64(flat.BASE)) >> np.uint64(48)).astype(np.int64)[inside]
        self.lengths = ends - starts
        self.first = np.cumsum(self.lengths) - self.lengths
        self.scripts = script[cps[starts]]
        self.starts, self.ends = starts, ends
        self.rows = np.searchsorted(starts, at)
        self.letter_scripts = script[cps[inside]]


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", max_training: int = MAX_TRAINING):
    """Languages by name, the log probability of each slot in each, and which scripts each uses."""
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{lang} has {len(sizes)} values; at most {MAX_LANGS} languages fit in the model")
    if not sizes:
        return [], np.zeros((0, SLOTS), np.float32), np.zeros((0, 256), bool)
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, int(min(1.0, max_training / n) * (1 << 30))).otherwise(share)
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = flat.flat(batch.column(0))
            for a, b, i, j in flat.portions(data, offsets, flat.SOLID_BYTE):
                words = Words(data[a:b], np.clip(offsets[i : j + 1], a, b) - a)
                per_row = np.add.reduceat(np.append(words.lengths, 0), words.rows[:-1]) * (np.diff(words.rows) > 0)
                of = np.repeat(langs[i:j], per_row)
                for name in set(langs[i:j].tolist()):
                    mine = of == name
                    own = seen.setdefault(name, np.zeros(SLOTS + 256, np.int64))
                    own[:SLOTS] += np.bincount(words.slots[mine], minlength=SLOTS)
                    own[SLOTS:] += np.bincount(words.letter_scripts[mine], minlength=256)
        for name, own in seen.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(own[used], pa.int64())], ["lang", "slot", "n"])

    langs = sorted(sizes)
    counts = np.zeros((len(langs), SLOTS + 256))
    for r in chosen.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SLOTS + 256 rows for each language
        counts[langs.index(r["lang"]), r["slot"]] = r["n"]
    grams, letters = counts[:, :SLOTS], counts[:, SLOTS:]
    used = max(1, int((grams.sum(0) > 0).sum()))
    logs = np.log((grams + 0.1) / (grams.sum(1, keepdims=True) + 0.1 * used + 1)).astype(np.float32)
    scripts = letters > SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    scripts[:, ~scripts.any(0)] = True  # a script that none uses narrows nothing
    return langs, logs, scripts


def viterbi(scores: np.ndarray, rows: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word. scores: words x languages; rows: the n + 1 offsets of the texts' words."""
    n = len(scores)
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = rows[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more than t words
    best_of = np.zeros(n, np.int16)
    switched = np.zeros(scores.shape, bool)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(steps):
        m = live[t]
        at = first[:m] + t
        v = value[:m]
        if t:
            best = v.argmax(1)
            top = np.take_along_axis(v, best[:, None], 1) - penalty
            sw = top > v
            best_of[at], switched[at] = best, sw
            v = np.where(sw, top, v)
            v -= v.max(1, keepdims=True)
        value[:m] = v + scores[at]
    out = np.zeros(n, np.int16)
    now = value.argmax(1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        own = now[:m]
        out[at] = own
        sw = switched[at, own]
        now[:m] = np.where(sw, best_of[at], own)
    return out


def predict(docs: DataFrame, model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """The columns keep, then lang_pred and score; with spans also spans: first and last + 1 character, and language."""
    langs, logs, scripts = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logs, scripts))
    docs = docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")]))
    width, place = len(keep), keep.index(text) if text in keep else len(keep)
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs, scripts = shared.value
        for whole in batches:
            data, offsets = flat.flat(whole.column(place))
            for i, j in flat.pieces(offsets, BATCH):
                tallies, paths, (starts, ends, rows) = _label(data, offsets, i, j, langs, logs, scripts, penalty)
                total = tallies.sum(1)
                best = tallies.argmax(1) if len(langs) else np.zeros(j - i, np.int64)
                preds = [langs[b] if n else "und" for b, n in zip(best.tolist(), total.tolist(), strict=True)]
                batch = whole.slice(i, j - i)
                made = [pa.array(preds, pa.string()), pa.array(np.where(total > 0, tallies.max(1, initial=0) / np.maximum(total, 1), 0.0), pa.float64())]
                names = [*batch.schema.names[:width], "lang_pred", "score"]
                if spans:
                    found = []
                    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                        own, out = paths[a:b], []
                        if b > a and langs:
                            cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                            out = [{"first": int(starts[a + x]), "last": int(ends[a + y - 1]), "lang": langs[own[x]]} for x, y in zip(cut, np.append(cut[1:], b - a), strict=True)]
                        found.append(out)
                    made.append(pa.array(found, span_type))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names)

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:width]), "lang_pred string", "score double", *(["spans array<struct<first:long,last:long,lang:string>>"] * spans)])
    return docs.mapInArrow(run, fields)


def _label(data, offsets, i, j, langs, logs, scripts, penalty):
    """Letters by row and language, each word's language, and the words' places in their texts."""
    scores, lengths, starts, ends = [], [], [], []
    offsets = offsets[i : j + 1]
    counts, begin, chars = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), 0
    for a, b, first, last in flat.portions(data, offsets, flat.SOLID_BYTE):
        own_offsets = np.clip(offsets[first : last + 1], a, b) - a
        words = Words(data[a:b], own_offsets)
        n = len(words.lengths)
        own = np.full((n, len(langs)), -1e6, np.float32)
        for k in range(len(langs)):
            open_ = scripts[k][words.scripts]  # words that may be in this language; the others aren't scored
            if open_.all():
                own[:, k] = np.add.reduceat(logs[k][words.slots], words.first) if n else 0
            elif open_.any():
                sizes = words.lengths[open_]
                own[open_, k] = np.add.reduceat(logs[k][words.slots[np.repeat(open_, words.lengths)]], np.cumsum(sizes) - sizes)
        scores.append(own)
        lengths.append(words.lengths)
        counts[first:last] += np.diff(words.rows)
        before = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
        fresh = offsets[first:last] >= a  # rows that begin here
        begin[first:last][fresh] = chars + before[own_offsets[:-1][fresh]]
        starts.append(words.starts + chars)
        ends.append(words.ends + chars)
        chars += int(before[-1])
    rows = np.concatenate([[0], np.cumsum(counts)])
    shift = np.repeat(begin, counts)
    lengths, scores = np.concatenate(lengths), np.concatenate(scores)
    path = viterbi(scores, rows, penalty) if len(langs) else np.zeros(len(lengths), np.int16)
    row = np.repeat(np.arange(j - i), np.diff(rows))
    wide = max(len(langs), 1)
    tallies = np.bincount(row * wide + path, lengths, minlength=(j - i) * wide).reshape(j - i, wide)[:, : len(langs)]
    return tallies, path, (np.concatenate(starts) - shift, np.concatenate(ends) - shift, rows)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id is."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(True))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
