"""Decontamination, BPE, language ID, n-gram scores and token counts against plain versions of them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from siftline.llm import backoff, bpe, counts, decontaminate, flat, langid, neardup, scatter, shared, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, items string, _words string"


def documents(spark, texts):
    """With columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", "y", "z") for i, t in texts], DOCS)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# --- flat ----------------------------------------------------------------------------------------------


def test_flat_columns():
    data, offsets = flat.flat(pa.chunked_array([pa.array(["a", None]), pa.array(["", "é"])]))
    assert bytes(data) == "aé".encode() and offsets.tolist() == [0, 1, 1, 1, 3]
    assert flat.flat(pa.array([], pa.string()))[1].tolist() == [0]
    assert flat.flat(pa.array(["xx", "abc"])[1:])[0].tobytes() == b"abc"


def test_equal_runs_have_equal_hashes():
    data = np.frombuffer(b"abcXabc", np.uint8)
    h = flat.run_hashes(data, np.array([0, 4, 1]), np.array([3, 7, 3]))
    assert h[0] == h[1] != h[2]


def test_packed_keys_and_counts():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    for drop in (0, 10):
        assert (scatter.unpack_sorted(scatter.pack_sorted(keys, drop))[0] == keys >> np.uint64(drop)).all()
    for n in (0, 1):
        assert len(scatter.unpack_sorted(scatter.pack_sorted(keys[:n]))[0]) == n
    c = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert scatter.unpack_counts(scatter.pack_counts(c))[0].tolist() == c.tolist()


# --- decontamination -----------------------------------------------------------------------------------


def plain_hits(text, rows, window=10):
    words, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
    for name, item in rows:
        own = decontaminate.words_of((item or "").encode())
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[i : i + k]:
                    hit.update(range(p, p + k))
                    found |= {str(name)} - {"None"}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("blocks", [1, 4])
def test_decontamination_is_brute_force(spark, blocks):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    rows = [(k, say(rng.choice([1, 3, 9, 10, 11, 30])) if k else "a") for k in range(12)] + [(90, None), (91, ""), (92, "...")]
    rows[0] = (0, "é É ab")
    rows.append((None, rows[11][1] + " q"))
    texts = [(k, say(rng.randint(0, 90))) for k in range(40)] + [(50, None), (51, ""), (52, "x É, é... AB y"), (53, rows[11][1] + "\n" + rows[10][1]), (53, "a b"), (53, "a b")]
    total = sum(len((t or "").encode()) for _, t in rows)
    got = decontaminate.find(documents(spark, texts), items(spark, rows), max_bytes=-(-total // blocks)).collect()
    assert len(got) == len(texts)
    want = Counter((i, *map(str, plain_hits(t, rows))) for i, t in texts)
    assert Counter((r.doc_id, str(r.n_words), str(sum(s.last_word - s.first_word for s in r.spans)), str(r["items"])) for r in got) == want


def test_decontamination_of_nothing(spark):
    assert decontaminate.find(documents(spark, []), items(spark, [(1, "a b")])).count() == 0
    got = decontaminate.find(documents(spark, [(1, "a b")]), items(spark, [])).first()
    assert (got.n_words, got.spans, got["items"]) == (2, [], [])


def test_removal(spark):
    item = " ".join(f"w{k}" for k in range(12))
    clean = " ".join(f"c{k}" for k in range(60))
    halves = item.split()
    texts = [(1, clean), (2, f"{clean}, {item}! {clean}"), (3, item), (4, None), (5, f"{clean} {' '.join(halves[:6])} {item} {' '.join(halves[6:])} {clean}")]
    got = {r.doc_id: r.text for r in decontaminate.remove(documents(spark, texts), items(spark, [(1, item)])).collect()}
    assert got[1] == clean and got[2] == f"{clean}, \n! {clean}" and 3 not in got and got[4] is None
    assert plain_hits(got[5], [(1, item)])[1] == 0


# --- BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.load()


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


BITS = ["'s", "'re", "'", "'ll", "'d", "  ", " ", "\n", "\t", "a", "Z", "é", "9", "٣", "漢", "😀", "-", "!", "ing", "'ve", "r", "l", "\u3000", "<|endoftext|>", "\x00", "́"]


def test_encoding_is_the_library_one(encoder, reference):
    rng = random.Random(6)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None, "x" * 9000, " " * 700, "don't you'll\n\n x'"]
    memo = bpe.Memo(encoder, bpe._packed)
    got = [np.frombuffer(x, np.int32).tolist() for x in bpe.packed_rows(memo, *flat.flat(pa.array(texts)))]
    assert got == [reference.encode_ordinary(t or "") for t in texts]
    assert all(encoder.decode(g).decode() == (t or "") for g, t in zip(got, texts, strict=True))


def test_perfect_hash_is_minimal(encoder):
    assert sorted(encoder.hash.slot.tolist()) == list(range(encoder.hash.n))


def test_other_patterns_are_refused(monkeypatch):
    monkeypatch.setattr(public_tokenizers, "PATTERN", r"\s+")
    with pytest.raises(ValueError, match="another pattern"):
        bpe.Encoder.load()


def test_whole_pre_tokens_come_from_the_hash(encoder, monkeypatch):
    monkeypatch.setattr(encoder, "ranks", {})  # ids of whole pre-tokens don't come from it
    words, ids, _, _ = encoder.distinct(np.frombuffer(b"the of zqzqzqzq", np.uint8), np.array([0, 15]))
    assert {w: i >= 0 for w, i in zip(words, ids, strict=True)} == {b"the": True, b" of": True, b" zqzqzqzq": False}


def test_digests(spark, reference):
    texts = [(1, "Hello, world"), (2, None), (2, "Hello, world"), (3, ""), (4, "é" * 50)]
    for r in bpe.digests(documents(spark, texts)).collect():
        assert any(r.doc_id == i and r.ids_sha256 == hashlib.sha256(",".join(map(str, reference.encode_ordinary(t or ""))).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts)
    assert bpe.digests(documents(spark, [])).count() == 0
    got = {r.doc_id: r for r in bpe.encode(documents(spark, [(1, "Hello"), (2, None)])).collect()}
    assert got[1].decoded == "Hello" and got[1].tokens == reference.encode_ordinary("Hello") and got[2].tokens == []


# --- language ID ---------------------------------------------------------------------------------------


def plain_viterbi(scores, penalty):
    value, back = scores[0].astype(float).copy(), []
    for s in scores[1:]:
        best = value.argmax()
        step = [i if value[i] >= value[best] - penalty else best for i in range(len(value))]
        value = np.array([value[j] - (0 if j == i else penalty) for i, j in enumerate(step)]) + s
        back.append(step)
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def test_viterbi():
    rng = np.random.default_rng(3)
    sizes = [5, 0, 1, 30, 7]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(rows[-1], 3)).astype(np.float32) * 4
    got = langid.viterbi(scores, rows, 3.0)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b > a:
            assert got[a:b].tolist() == plain_viterbi(scores[a:b], 3.0)


def plain_languages(rows, train):
    """Trigram counts, script ranges and the best path, letter by letter; the hash of a trigram is the operator's."""
    import regex

    scripts = {c: k for k, spans in enumerate(langid.SCRIPTS.values(), 1) for a, b in spans for c in range(a, b + 1)}
    words = lambda t: regex.findall(r"\p{L}+", "".join(c.lower() if len(c.lower()) == 1 else c for c in t or ""))

    def slots(word):
        run = [0, *map(ord, word), 0]
        return [((((a * 0x9E3779B1 + b) * 0x85EBCA77 + c) * flat.BASE) % (1 << 64)) >> 48 for a, b, c in zip(run, run[1:], run[2:])]

    grams, used = {}, {}
    for text, lang in train:
        for w in words(text):
            grams.setdefault(lang, Counter()).update(slots(w))
            used.setdefault(lang, Counter()).update(scripts.get(ord(c), 0) for c in w)
    langs, every = sorted(grams), len(set().union(*grams.values()))
    totals = {x: sum(grams[x].values()) for x in langs}
    allowed = {x: {s for s, n in used[x].items() if n > langid.SCRIPT_SHARE * sum(used[x].values())} for x in langs}
    known = set().union(*allowed.values())
    for key, text in rows:
        own = words(text)
        if not own:
            yield key, "und", 0.0
            continue
        scores = []
        for w in own:
            s = scripts.get(ord(w[0]), 0)
            at = slots(w)
            scores.append([sum(math.log((grams[x][k] + 0.1) / (totals[x] + 0.1 * every + 1)) for k in at) if s not in known or s in allowed[x] else -1e6 for x in langs])
        path, tally = plain_viterbi(np.array(scores), langid.PENALTY), Counter()
        for w, k in zip(own, path, strict=True):
            tally[k] += len(w)
        best = min(tally, key=lambda k: (-tally[k], k))
        yield key, langs[best], tally[best] / sum(tally.values())


def test_languages_are_the_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", langid.held_out().alias("h")).where("length(text) < 4000").collect()
    frame = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.h) for r in rows] + [(9001, "Ñandú кошка the 漢字", None, True)], "doc_id long, text string, lang string, h boolean")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, langid.train(frame.where("not h"))).collect()}
    want = plain_languages([(r.doc_id, r.text) for r in frame.collect()], [(r.text, r.lang) for r in rows if not r.h and r.lang and r.text])
    off = [k for k, lang, score in want if got[k][0] != lang or abs(got[k][1] - score) > 0.02]
    assert len(got) == len(rows) + 1 and off == []  # sums of 32 and 64 bits may cut a span a word earlier


def test_languages_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs.where(~langid.held_out())), keep=("doc_id", "lang")).where(langid.held_out())
    row = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.right > 0.97 and row.low >= 0 and row.high <= 1


def test_mixed_and_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog were there " * 20, "en"), ("der hund und die katze waren da " * 20, "de"), ("кошка и собака были там " * 20, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    assert model[0] == ["de", "en", "ru"]
    docs = documents(spark, [(1, "the dog and the cat. der hund und die katze"), (2, None), (3, "12 !?"), (4, ""), (5, "собака"), (6, "the cat"), (6, "the cat"), (7, "漢字")])
    got = {r.doc_id: r for r in langid.predict(docs, model, spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].spans[0].first == 0
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4))
    assert got[5].lang_pred == "ru" and got[6].lang_pred == "en" and got[7].lang_pred in model[0]
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


# --- n-gram scores -------------------------------------------------------------------------------------


def plain_scores(texts, held):
    """Each text's counts and scores, word by word."""
    lists = [(k, [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]) for k, t in texts]
    own = [w for k, w in lists if not held(k)]
    c1, c2, c3 = Counter(x for w in own for x in w), Counter(p for w in own for p in zip([None, *w], w)), Counter(p for w in own for p in zip([None, *w], w, w[1:]))
    n, v = sum(c1.values()), len(c1)

    def p(before, w):
        p1 = (c1[w] + 1) / (n + v + 1)
        u = before[-1]
        p2 = (c2[u, w] + backoff.K * p1) / (c1[u] + backoff.K)
        if len(before) == 1:
            return p2
        return (c3[before[0], u, w] + backoff.K * p2) / (c2[before[0], u] + backoff.K)

    for k, w in lists:
        base = sum(math.log10((c1[x] + 1) / (n + v + 1)) for x in w)
        run = [None, *w]
        yield k, held(k), len(w), sum(c1[x] > 0 for x in w), n, base, sum(math.log10(p(run[max(0, i - 1) : i + 1], x)) for i, x in enumerate(w))


@pytest.mark.parametrize("layout", [{}, {"chunk_bytes": 60, "bucket_bytes": 40, "fan": 3}])
def test_scores_are_the_model_s(spark, layout):
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choice(["a", "B", "c", "dd", "é"]) for _ in range(rng.randint(0, 12)))) for k in range(40)]
    texts += [(90, None), (91, "new words"), (91, "a\x0bA"), *[(92, "again and again")] * 20, (93, "again and")]
    got = backoff.score(documents(spark, texts), F.col("doc_id") % 3 != 0, **layout).collect()
    want = sorted(plain_scores(texts, lambda k: k % 3 == 0), key=lambda x: (*x[:5], round(x[6], 4)))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda x: (*x[:5], round(x[6], 4)))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5:] for x in got] == [pytest.approx(x[5:], abs=1e-7) for x in want]
    assert backoff.score(documents(spark, []), F.lit(True)).count() == 0


def test_a_row_without_an_id_is_held_out(spark):
    got = backoff.score(documents(spark, [(None, "a b"), (1, "a")]), F.col("doc_id") > 0).collect()
    assert {(r.doc_id, r.held_out, r.train_tokens) for r in got} == {(None, True, 2), (1, False, 2)}


def test_failure_arcs_lead_from_pairs_to_words_to_the_root():
    import pyarrow as pa

    runs = backoff.Runs(pa.table({"text": ["a b c", "b d", "x b c"], "_train": [True, True, False]}))
    one, two, three = runs.own
    a = backoff.Automaton(one, two, three, runs.words_of_pairs(), runs.pairs_of_triples(), int(one.sum()), int((one > 0).sum()))
    assert set(a.size.tolist()) == {0, 1, 2} and a.back[a.root - 1] <= a.root
    for state in range(a.root):
        assert a.size[a.back[state]] < a.size[state]


# --- very long texts -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_text():
    """50 MB of words, most of them rare."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{k:x}" for k in range(100_000)])
    return " ".join(words[rng.integers(0, len(words), 8_300_000)].tolist())[: 50 << 20]


def plain_words(text):
    return text.count(" ") + 1


def test_very_long_text(spark, long_text):
    """One text of 50 MB beside a short one, for each operator that reads documents."""
    short = "a few words of no length that stand alone here"
    docs = documents(spark, [(1, long_text), (2, short)])
    n = plain_words(long_text)
    got = {r.doc_id: r for r in backoff.score(docs, F.lit(True)).collect()}
    assert got[1].n_tokens == n + 1 and got[2].n_tokens == 11
    item = " ".join(long_text[25_000_000:25_000_400].split()[1:31])
    hit = {r.doc_id: r for r in decontaminate.find(docs, items(spark, [(1, item)])).collect()}
    assert hit[1].n_words == n and sum(s.last_word - s.first_word for s in hit[1].spans) >= 30 and not hit[2].spans


def test_very_long_text_without_copies(spark, long_text):
    docs = documents(spark, [(1, long_text), (2, long_text[30_000_000:30_000_500]), (3, None)])
    got = {r.doc_id: r for r in suffixes.passages(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == got[2].n_bytes == 500
    assert {r.doc_id: r.class_id for r in neardup.class_ids(docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_very_long_text_in_tokens_and_languages(spark, long_text, reference):
    text = "Der Hund und die Katze waren da. " * 20 + long_text[: 20 << 20]
    docs = documents(spark, [(1, text), (2, "short")])
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    ids = reference.encode_ordinary(text)
    assert got[1].n_tokens == len(ids) and got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[2].n_tokens == len(reference.encode_ordinary("short"))
    model = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"))
    part = documents(spark, [(1, text[: 3 << 20]), (2, "short")])
    found = {r.doc_id: r for r in langid.predict(part, model, spans=True).collect()}
    assert found[1].spans[0].first == 0 and found[1].spans[-1].last <= 3 << 20 and found[2].spans[0].last == 5


@pytest.mark.parametrize("limit", [1, 50, 1000])
def test_portions_change_no_token_and_no_span(spark, monkeypatch, limit):
    rng = random.Random(limit)
    texts = [(k, "".join(rng.choice([*BITS, " the", " und ", "word "]) for _ in range(rng.randint(0, 200)))) for k in range(20)]
    want = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents(spark, texts)).collect()}
    model = langid.train(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"))
    langs = [tuple(r) for r in langid.predict(documents(spark, texts), model, spans=True).collect()]
    encoder, label = bpe.Encoder.load(), lambda data, offsets: langid._label(data, offsets, 0, len(offsets) - 1, *model, langid.PENALTY)
    import pyarrow as pa

    data, offsets = flat.flat(pa.array([t for _, t in texts]))
    before = label(data, offsets)
    monkeypatch.setattr(flat, "PIECE", limit)
    monkeypatch.setattr(bpe, "PIECE", limit)
    rows = list(bpe.packed_rows(bpe.Memo(encoder, bpe._packed), data, offsets))
    assert {k: (len(x) // 4, hashlib.sha256(",".join(map(str, np.frombuffer(x, np.int32).tolist())).encode()).hexdigest()) for (k, _), x in zip(texts, rows, strict=True)} == {k: v[:2] for k, v in want.items()}
    after = label(data, offsets)
    assert (before[0] == after[0]).all() and (before[1] == after[1]).all() and all((x == y).all() for x, y in zip(before[2], after[2], strict=True))
    assert len(langs) == len(texts)


def test_words_are_cut_whole():
    text = ("long" * 50 + " x " * 30 + "tail").encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    for limit in (1, 7, 64, 1 << 18):
        parts = list(flat.portions(data, offsets, flat.SOLID_BYTE, limit))
        assert b"".join(bytes(data[a:b]) for a, b, _, _ in parts) == text * 2
        assert all(a == 0 or a in offsets or not flat.SOLID_BYTE[data[a]] or not flat.SOLID_BYTE[data[a - 1]] for a, *_ in parts)


# --- token counts --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "group"), [(3, 2), (1 << 20, 1024)])
def test_token_counts_round_trip(spark, reference, block, group):
    texts = [(1, "Hello, world"), (2, None), (3, ""), (3, "again and again " * 9), (None, "x"), (4, "y " * 50)]
    folder = shared.folder(spark, "tokens")
    counts.write(documents(spark, texts).repartition(3), folder, file_ids=20)
    listed = spark.read.parquet(f"{folder}/list")
    found = counts.scan(spark, folder, listed.select("file").distinct(), block=block, group=group)
    got = listed.join(found, ["file", "place"]).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((i, len(reference.encode_ordinary(t or ""))) for i, t in texts)


def test_no_join_of_token_counts_is_broadcast(spark):
    plan = counts.count(documents(spark, [(1, "a b")]), shared.folder(spark, "tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_counts_of_nothing(spark):
    assert counts.count(documents(spark, []), shared.folder(spark, "tokens")).count() == 0


def test_split_of_held_out_documents(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


@pytest.mark.parametrize("limit", [1, 40, 333, 5000])
def test_long_texts_in_overlapping_portions(limit):
    """The same hits, words and items as in one piece, wherever it is cut."""
    import random

    rng = random.Random(limit)
    words = [rng.choice(["a", "bb", "ccc", "Dd", "é", "x" * 60]) for _ in range(900)]
    text = "".join(w + rng.choice([" ", ", ", "\n", "  "]) for w in words).encode()
    rows = [(str(k), [w.lower().encode() for w in words[s : s + n]]) for k, (s, n) in enumerate([(5, 10), (100, 25), (110, 30), (300, 12), (700, 3), (885, 15)])]
    automaton = decontaminate.SuffixAutomaton(rows)
    data = np.frombuffer(text, np.uint8)
    whole = automaton.scan(data, np.array([0, len(data)]))
    cut = decontaminate.long_scan(automaton, data, np.array([0, len(data)]), decontaminate.WINDOW, limit)
    assert cut[0].tolist() == whole[0].tolist() and cut[2] == whole[2]
    assert [s[0] for s in decontaminate._merged(list(whole[1][0]))] and decontaminate._merged(list(whole[1][0])) == cut[1][0]
