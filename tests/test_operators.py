"""Rules at their boundaries, and operators against plain models."""

from __future__ import annotations

import base64
import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import albums, audit, dedupe, identity, matching, naming, overlap, placement, relabel, review, similarity
from siftline.plans import collection
from siftline.sources import files
from siftline.streaming import streams


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("kbps", "tier"), [(300.0, 5), (299.9, 4), (230.0, 4), (229.0, 3), (180.0, 3), (120.0, 2), (119.9, 1), (None, 1)])
def test_quality_tiers(spark, kbps, tier):
    assert one(spark, expr.quality_tier(F.lit(False), F.lit(kbps).cast("double"))) == tier
    assert one(spark, expr.quality_tier(F.lit(True), F.lit(kbps).cast("double"))) == 6


@pytest.mark.parametrize(("path", "want"), [("A/b/c 12 x.mp3", ("A/b/", "A", 12, "mp3", "c 12 x")), ("loose.FLAC", ("", "", None, "flac", "loose")), ("A/.hidden", ("A/", "A", None, "", ".hidden"))])
def test_paths(spark, path, want):
    p = F.lit(path)
    row = spark.range(1).select(expr.folder(p), expr.top_dir(p), expr.first_number(p), expr.extension(p), expr.stem(p)).first()
    assert tuple(row) == want


@pytest.mark.parametrize(("title", "want"), [("Help Us (Dub)", "help us"), ("Straße", "strae"), ("Émile [x] {y}", "emile"), (None, ""), ("A--B", "a b")])
def test_normal_titles(spark, title, want):
    assert one(spark, expr.norm_title(F.lit(title).cast("string"))) == want


@pytest.mark.parametrize(("a", "b", "same"), [("abcdefgh", "abcdefgh one", True), ("abcdefg", "abcdefg one", False), ("x", "x", True), ("", "", False)])
def test_titles_agree(spark, a, b, same):
    assert one(spark, expr.titles_agree(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize(("text", "other"), [("abc é", False), ("日本", True), ("", False), (None, False), ("Привет", True), ("12 !", False)])
def test_scripts(spark, text, other):
    assert one(spark, expr.non_latin(F.lit(text).cast("string"))) is other


def test_small_expressions(spark):
    assert one(spark, expr.names_list(F.array(*map(F.lit, "abcde")))) == "a, b, c and 2 more"
    assert one(spark, expr.names_list(F.array(F.lit("a")))) == "a"
    assert one(spark, expr.without_suffix(F.lit("Album [1989]"))) == "Album"
    assert one(spark, expr.clock_seconds(F.lit("1:02:03.5"))) == 3723.5
    assert bytes(one(spark, expr.from_url_base64(F.lit("-_-_")))) == base64.urlsafe_b64decode("-_-_")
    assert one(spark, expr.version_word(F.lit("Songs (Instrumental)"), F.lit("Songs"))) == "instrumental"
    assert one(spark, expr.version_word(F.lit(None).cast("string"), F.lit("Songs"))) is None
    assert one(spark, expr.unsorted_name(F.lit("/in/.processed/2024/x/y.mp3"))) == "x - y.mp3"
    assert one(spark, expr.identity(F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert one(spark, expr.gap(F.array(F.lit(0.1)))) == 1.0


@pytest.mark.parametrize(("decoded", "expected", "other", "want"), [(90.0, 100.0, None, False), (89.9, 100.0, None, True), (40.0, 100.0, 0.0, True), (40.0, 100.0, 41.0, False), (0.0, 0.0, None, False), (None, 100.0, None, False)])
def test_damaged(spark, decoded, expected, other, want):
    assert one(spark, expr.damaged(F.lit(decoded).cast("double"), F.lit(expected), F.lit(other).cast("double"))) is want


RECS = "array<struct<id:string,score:double>>"


@pytest.mark.parametrize(("tag", "status", "recs", "want"), [("a", None, None, "no_lookup"), ("a", "ok", [("a", 0.8)], "confirmed"), ("a", "ok", [("b", 0.9), ("a", 0.85)], "confirmed"), ("a", "ok", [("a", 0.79)], "unverifiable"), ("a", "ok", [], "unverifiable"), ("a", "ok", [("b", 0.9)], "mismatch"), (None, "ok", [("b", 0.9)], "suggest"), ("", "ok", [], "unknown")])
def test_verdicts(spark, tag, status, recs, want):
    rows = spark.createDataFrame([(tag, status, recs)], f"tag string, status string, recs {RECS}")
    assert rows.select(identity.verdict(F.col("tag"), F.col("status"), F.col("recs"))).first()[0] == want


def test_alternative_recording(spark):
    rows = spark.createDataFrame([("a", "ok", [("b", 0.9)], "help us", {"b": "help us"})], f"tag string, status string, recs {RECS}, title string, titles map<string,string>")
    assert rows.select(identity.verdict(F.col("tag"), F.col("status"), F.col("recs"), F.col("title"), F.col("titles"))).first()[0] == "alt_recording"


def test_parsed_results(spark):
    rows = spark.createDataFrame([([("x", 0.5, ["r1", "r2"]), ("y", 0.9, ["r2"])],)], "r array<struct<id:string,score:double,recordings:array<string>>>")
    assert [tuple(x) for x in rows.select(identity.parsed(F.col("r"))).first()[0]] == [("r2", 0.9, "y"), ("r1", 0.5, "x")]


def fold(sets, rank):
    """The definition: best first, a set stays if it is first or adds a key."""
    seen, out = set(), {}
    for k, s in enumerate(sorted(sets, key=lambda s: rank[s], reverse=True)):
        out[s] = ("keep" if k == 0 or not sets[s] <= seen else "drop", round(len(sets[s] & seen) / len(sets[s]), 3))
        seen |= sets[s]
    return out


def test_greedy_cover_is_the_fold(spark):
    rng = random.Random(3)
    for _ in range(5):
        sets = {i: {f"k{rng.randrange(12)}" for _ in range(rng.randint(1, 9))} for i in range(8)}
        rank = {i: (rng.randrange(3), -i) for i in sets}
        members = spark.createDataFrame([(s, k) for s, keys in sets.items() for k in keys], "set long, key string")
        ranks = spark.createDataFrame([(s, r) for s, r in rank.items()], "set long, rank struct<a:long,b:long>")
        clusters = spark.createDataFrame([(s, 0) for s in sets], "node long, root long")
        got = {r["set"]: (r["role"], r["coverage"]) for r in dedupe.greedy_cover(members, clusters, ranks).collect()}
        assert got == fold(sets, rank)


def test_disc_folders_stay_and_a_worse_whole_goes(spark):
    sets = {1: {f"t{i}" for i in range(18)}, 2: {f"t{i}" for i in range(18, 34)}, 3: {f"t{i}" for i in range(34)}}
    members = spark.createDataFrame([(s, k) for s, keys in sets.items() for k in keys], "set long, key string")
    pairs = dedupe.containment_pairs(members)
    clusters = dedupe.components(pairs)
    ranks = spark.createDataFrame([(1, (320, 1)), (2, (320, 0)), (3, (150, 0))], "set long, rank struct<a:long,b:long>")
    got = {r["set"]: r["role"] for r in dedupe.greedy_cover(members, clusters, ranks).collect()}
    assert got == {1: "keep", 2: "keep", 3: "drop"}


@pytest.mark.parametrize(("shared", "found"), [(9, True), (8, False)])
def test_containment_boundary(spark, shared, found):
    rows = [(1, f"k{i}") for i in range(10)] + [(2, f"k{i}") for i in range(shared)] + [(2, f"x{i}") for i in range(15 - shared)]
    assert bool(dedupe.containment_pairs(spark.createDataFrame(rows, "set long, key string")).count()) is found


def test_keys_of_many_sets_say_nothing(spark):
    rows = [(s, "noise") for s in range(51)]
    assert dedupe.containment_pairs(spark.createDataFrame(rows, "set long, key string")).count() == 0
    assert dedupe.containment_pairs(spark.createDataFrame(rows[:50], "set long, key string")).count() == 50 * 49 // 2


def test_components_of_chains_and_none(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = dict(dedupe.components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert dedupe.components(edges.limit(0)).count() == 0


def test_null_hashes_are_no_copies(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "h", 5), (4, "h", 6)], "id long, digest string, bytes long").withColumn("order", F.struct("bytes", "id"))
    got = dedupe.identical_groups(rows, rows.select("id").limit(0)).collect()
    assert [(r.digest, r.keeper, r.copies, r.reclaimable) for r in got] == [("h", 3, 2, 6)]


@pytest.mark.parametrize(("gap", "copy"), [(1.999, True), (2.0, False)])
def test_second_copy_gap(spark, gap, copy):
    rows = spark.createDataFrame([("f", 1, 100.0, 1), ("f", 2, 100.0 + gap, None)], "g string, id long, seconds double, number int")
    found = lambda frame, gone=None: [(r.id, r.action) for r in dedupe.second_copies(frame, ["g"], [F.col("id").asc()], "seconds", 2.0, gone).collect()]
    assert found(rows) == ([(2, "auto")] if copy else [])
    assert found(rows.na.fill({"number": 2})) == ([(2, "review")] if copy else [])
    assert found(rows, spark.createDataFrame([(1,)], "id long")) == []  # what was dropped before is no keeper


def pack(values):
    """A fingerprint of items, the straightforward way."""
    bits3, bits5, before = [], [], 0
    for v in values:
        x, last = v ^ before, 0
        before = v
        for b in range(32):
            if x >> b & 1:
                step = b + 1 - last
                last = b + 1
                bits3.append(min(step, 7))
                if step >= 7:
                    bits5.append(step - 7)
        bits3.append(0)

    def pour(numbers, width):
        acc = sum(v << width * i for i, v in enumerate(numbers))
        return acc.to_bytes((len(numbers) * width + 7) // 8, "little")

    return base64.urlsafe_b64encode(b"\x01" + len(values).to_bytes(3, "big") + pour(bits3, 3) + pour(bits5, 5)).decode().rstrip("=")


def test_fingerprints_round_trip(spark):
    rng = random.Random(1)
    lists = [[rng.getrandbits(32) for _ in range(n)] for n in (1, 7, 60)] + [[0, 0, 1 << 31, 0xFFFFFFFF]]
    rows = spark.createDataFrame([(pack(v),) for v in lists] + [("!!",), (None,)], "f string")
    assert [r[0] for r in rows.coalesce(1).select(similarity.decode("f")).collect()] == [*lists, None, None]


def test_similarity(spark):
    rng = random.Random(2)
    x = [rng.getrandbits(32) for _ in range(70)]
    y = x[3:] + [rng.getrandbits(32) for _ in range(3)]
    noisy = [v ^ 1 for v in x]
    rows = spark.createDataFrame([(x, x), (x, y), (x, noisy), (x[:49], x[:49])], "a array<long>, b array<long>")
    assert [r[0] for r in rows.coalesce(1).select(similarity.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, round(1 - 1 / 32, 3), 0.0]


def test_range_pairs_at_the_edge(spark):
    x = spark.createDataFrame([("b", 1, 10.0), ("b", 2, 20.0), ("b", 3, 20.5), ("c", 4, 10.0)], "k string, id long, m double")
    got = {(r.id_1, r.id_2) for r in similarity.near_in_range(x, x, ["k"], "m", 10.0).collect() if r.id_1 < r.id_2}
    assert got == {(1, 2), (2, 3)}


def test_replay_is_the_sequential_one(spark):
    rng = random.Random(5)
    log = [(i, f"s{rng.randrange(6)}", f"d{rng.randrange(5)}", rng.choice(["import", "move", "remove"])) for i in range(80)]
    alive = {}
    for _, s, d, a in log:
        if a == "remove":
            alive = {k: v for k, v in alive.items() if v != d}
        else:
            alive[s] = d
    frame = spark.createDataFrame(log, "id long, source string, dest string, action string")
    assert {r.source: r.dest for r in placement.placements(frame, F.col("action") == "remove").collect()} == alive


@pytest.mark.parametrize(("d", "kind"), [(0.0999, "close"), (0.1, "weak"), (0.4999, "weak"), (0.5, "none"), (None, "none")])
def test_kinds(spark, d, kind):
    assert one(spark, review.kind(F.lit("review"), F.lit(False), F.lit(d).cast("double"))) == kind
    assert one(spark, review.kind(F.lit("review"), F.lit(True), F.lit(d).cast("double"))) == "dupe"
    assert one(spark, review.kind(F.lit("auto"), F.lit(False), F.lit(d).cast("double"))) is None


GOOD = {"distance": 0.05, "gap": 0.2, "confirmed": 9, "files": 10, "mismatch": 1, "missing": 1, "extra": 2, "rival": False, "bad": False, "penalties": ["media", "missing_tracks"]}


@pytest.mark.parametrize(("change", "why"), [({}, ""), ({"distance": 0.1}, "distance=0.100"), ({"gap": 0.14}, "gap=0.14"), ({"confirmed": 8}, "confirmed=8/10"), ({"mismatch": 2}, "mismatch=2"), ({"missing": 2}, "missing=2"), ({"extra": 3}, "extra=3"), ({"penalties": ["odd", "even"]}, "penalties=even,odd"), ({"rival": True}, "rival"), ({"bad": True}, "bad_file")])
def test_close_rule(spark, change, why):
    row = GOOD | change
    c = {k: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for k, v in row.items()}
    assert one(spark, review.close_rule(c["distance"], c["gap"], c["confirmed"], c["files"], c["mismatch"], c["missing"], c["extra"], c["penalties"], c["rival"], c["bad"])) == why


@pytest.mark.parametrize(("d", "extra", "missing", "fits"), [(0.34, 0, 0, True), (0.35, 0, 0, False), (0.1, 1, 0, False), (0.1, 0, 1, False), (None, 0, 0, False)])
def test_rival(spark, d, extra, missing, fits):
    assert one(spark, review.rival_fits(F.lit(d).cast("double"), F.lit(extra), F.lit(missing))) is fits


@pytest.mark.parametrize(("d", "gap", "rule"), [(0.05, 0.3, "D22"), (0.1, 0.3, "D26"), (0.2, 0.3, None), (0.05, 0.29, None)])
def test_exact_rule(spark, d, gap, rule):
    assert one(spark, review.exact_rule(F.lit(d), F.lit(gap), F.lit(0), F.lit(0), F.lit(0), F.array(F.lit("year")), F.lit(False))) == rule


def test_unmatched_rule(spark):
    rule = lambda d, local, titles: one(spark, review.no_candidate_rule(F.lit(d).cast("double"), F.lit(False), F.lit(False), F.lit(local), F.array(*map(F.lit, titles))))
    assert rule(0.6, "greatest hits", ["other"]) == ""
    assert rule(0.4, "greatest hits", ["other"]) == "near_candidate"
    assert rule(None, "greatest hits", ["the greatest hits vol 1"]) == "same_title"


@pytest.mark.parametrize(("args", "want"), [(("r1", "r2", 0, False, 1, 1, 0), ("review", "edition")), (("r1", "", 1, False, 2, 2, 0), ("review", "upgrade")), (("", "", 1, True, 2, 2, 0), ("review", "wanted")), (("", "", 0, False, 3, 2, 1), ("review", "upgrade")), (("", "", 0, False, 2, 2, 1), ("review", "extra_tracks")), (("r", "r", 0, False, 1, 2, 0), ("skip", "duplicate"))])
def test_outcomes(spark, args, want):
    assert tuple(spark.range(1).select(*overlap.outcome(*map(F.lit, args))).first()) == want


def test_reconciliation(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    current = spark.createDataFrame([("b", "open"), ("c", "fulfilled"), ("d", "dismissed"), ("e", "open"), ("f", "dismissed")], "key string, status string")
    assert {r.key: r.action for r in audit.reconciled(found, current, "key").collect()} == {"a": "insert", "b": "update", "c": "reopen", "d": "keep", "e": "fulfil", "f": "keep"}


def test_drift_slacks(spark):
    now = spark.createDataFrame([("a", 1, 1000.0, 700.0), ("b", 1, 1000.0, 699.0), ("c", 1, 1000.0, 995.0), ("d", 1, 1000.0, 994.0), ("e", 1, 1000.0, None)], "p string, size long, mtime double, known_mtime double")
    base = spark.createDataFrame([("c", 1, 5.0), ("d", 1, 5.0), ("e", 1, 1000.0)], "p string, size long, mtime double")
    assert {r.p: r.flagged for r in audit.drifted(now, base, "p").collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_unique_pairs_in_two_passes(spark):
    old = spark.createDataFrame([("o1", "A", "x"), ("o2", "B [1]", "y"), ("o3", "C", "z"), ("o4", "C", "z")], "old_id string, album string, name string")
    new = spark.createDataFrame([("n1", "A", "x"), ("n2", "B", "y"), ("n3", "C", "z")], "new_id string, album string, name string")
    exact, loose = F.concat("album", "name"), F.concat(expr.without_suffix(F.col("album")), F.col("name"))
    assert {(r.old_id, r.new_id) for r in matching.unique_pairs(old, new, [(exact, exact), (loose, loose)]).collect()} == {("o1", "n1"), ("o2", "n2")}


def test_majority_takes_the_first_seen_of_equals(spark):
    rows = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4)], "g string, v string, at long")
    assert matching.majority(rows, "g", "v", "at").first()["v"] == "b"


TRACKS = [("al", "t1", "song one", 100.0), ("al", "t2", "song two", 200.0), ("al", "t3", "song three", 300.0)]
FILES = "album string, file string, track string, extra boolean, heard array<string>, titles array<string>, title string, confirmed boolean, seconds double, forced boolean, displaced boolean"


def album(spark, *files_):
    """Files as (name, track, ids heard, seconds), and what else is said of them."""
    rows = [("al", f[0], f[1], False, f[2], [], "own", False, f[3], False, False) for f in files_]
    rows = [tuple((f[4] if len(f) > 4 else {}).get(k, v) for k, v in zip(("album", "file", "track", "extra", "heard", "titles", "title", "confirmed", "seconds", "forced", "displaced"), r, strict=True)) for f, r in zip(files_, rows, strict=True)]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame(TRACKS, "album string, track string, title string, length double")


EXTRA, FORCED = {"extra": True}, {"extra": True, "forced": True}


@pytest.mark.parametrize(("files_", "changes", "problems"), [
    ([("f1", "t1", ["t1"], 100.0), ("f2", "t2", ["t2"], 200.0)], set(), set()),
    ([("f1", "t2", ["t1"], 100.0), ("f2", "t1", ["t2"], 200.0)], {("f1", "t1", "moves", None), ("f2", "t2", "moves", None)}, set()),
    ([("f1", "t2", ["t1"], 200.0), ("f2", "t1", ["t2"], 100.0)], {("f1", "t1", "moves", None), ("f2", "t2", "moves", None)}, {("f1", "length"), ("f2", "length")}),
    ([("f1", "t1", ["x"], 250.0)], {("f1", "t1", "demoted", None)}, set()),
    ([("f1", "t1", ["x"], 110.0)], set(), {("f1", "foreign_fits")}),
    ([("f1", "t1", ["x"], 110.1)], {("f1", "t1", "demoted", None)}, set()),
    ([("f1", "t1", [], 101.0)], set(), set()),
    ([("f1", None, ["t1", "t2"], 197.0)], {("f1", "t2", "moves", None)}, set()),
    ([("f1", None, ["t1", "t2"], 196.9)], set(), {("f1", "unclear")}),
    ([("f1", "t1", ["t1"], 100.0), ("f2", "t2", ["t1"], 205.0)], set(), {("f2", "foreign_fits")}),
    ([("f1", "t1", ["x"], 101.0), ("e1", None, ["t1"], 100.0, EXTRA)], {("e1", "t1", "fills", "f1")}, set()),
    ([("f1", "t1", ["x"], 101.0), ("e1", None, ["t1"], 111.0, EXTRA)], set(), {("f1", "extra_length")}),
    ([("f1", "t1", ["x"], 101.0), ("e1", None, ["t1"], 100.0, EXTRA), ("e2", None, ["t1"], 100.0, EXTRA)], {("f1", "t1", "demoted", None)}, {(None, "several_extras")}),
    ([("f1", "t1", ["t1"], 104.0), ("e1", None, ["t1"], 100.0, EXTRA)], {("e1", "t1", "promoted", "f1")}, set()),
    ([("f1", "t1", ["t1"], 103.0), ("e1", None, ["t1"], 100.0, EXTRA)], set(), set()),
    ([("f1", "t1", [], 100.0), ("e1", None, ["t1"], 103.0, EXTRA)], {("e1", "t1", "promoted", "f1")}, set()),
    ([("f1", "t1", [], 100.0), ("e1", None, ["t1"], 103.1, EXTRA)], set(), set()),
    ([("f1", "t1", ["t1"], 100.0), ("e1", None, ["t1"], 500.0, FORCED)], {("e1", "t1", "promoted", "f1")}, set()),
    ([("f1", "t1", [], 100.0), ("e1", None, ["t1"], 100.0, EXTRA | {"displaced": True})], set(), set()),
    ([("f1", "t1", ["t2", "t3"], 100.0), ("e1", None, ["t1"], 100.0, EXTRA)], {("e1", "t1", "promoted", "f1")}, {("f1", "unclear")}),
    ([("f1", "t1", ["t1"], 100.0, {"forced": True}), ("e1", None, [], 1.0, FORCED)], set(), {("f1", "not_an_extra"), ("e1", "forced_unclear")}),
    ([("f1", "t2", ["t1"], 100.0), ("e1", None, [], 201.0, EXTRA | {"title": "song two", "confirmed": True})], {("f1", "t1", "moves", None), ("e1", "t2", "fills", None)}, set()),
])
def test_relabel(spark, files_, changes, problems):
    made = relabel.Plan(*album(spark, *files_))
    assert {(r.file, r.track, r.change, r.replaces) for r in made.changes().collect()} == changes
    assert {(r.file, r.problem) for r in made.problems.collect()} == problems


def test_relabel_without_tracks_or_files(spark):
    files_, tracks = album(spark, ("f1", "t9", ["t1"], 1.0))
    assert {(r.file, r.state) for r in relabel.assigned(files_, tracks.limit(0)).collect()} == {("f1", "unclear")}
    assert relabel.Plan(files_.limit(0), tracks).changes().count() == 0


@pytest.mark.parametrize(("swapped", "seconds", "want"), [(True, 100.0, "relabelled"), (False, 100.0, "nothing"), (True, 200.0, "noted")])
def test_what_an_import_does_by_itself(spark, swapped, seconds, want):
    made = relabel.Plan(*album(spark, ("f1", "t2", ["t1"], seconds), ("f2", "t1", ["t2"], 200.0)))
    assert made.gates(spark.createDataFrame([("al",)] if swapped else [], "album string")).first().after_import == want


def test_news_of_runs(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 1), (2, "a", 2), (2, "c", 1), (3, "a", 4), (3, "b", 1), (4, "a", 6), (5, "a", 6)], "run long, key string, n long")
    assert {tuple(r) for r in streams.new_keys(rows, "run", "key").collect()} == {(2, "c"), (3, "b")}
    assert {(r.run, r.key, r.by) for r in streams.grown(rows, "run", "key", "n").collect()} == {(2, "c", 1), (3, "a", 2), (3, "b", 1), (4, "a", 2)}
    assert {(r.run, r.key) for r in streams.changed(rows, "run", "key", "n").collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "b"), (4, "a")}
    counts = spark.createDataFrame([("k", i, v) for i, v in enumerate([5, 2, 4, 6])], "k string, at long, n long")
    assert [r.n for r in streams.told_once(counts, ["k"], "at", F.col("n")).orderBy("at").collect()] == [5, 4, 6]


def test_one_fault_ends_one_batch(spark):
    def step(batch):
        if batch == 2:
            raise RuntimeError("no")

    assert streams.run_pass([1, 2, 3], [("scan", step), ("match", lambda b: None)]) == [(1, "scan", None), (1, "match", None), (2, "scan", "RuntimeError: no"), (3, "scan", None), (3, "match", None)]


def test_overlaps_need_no_common_key_of_all(spark):
    rng = random.Random(5)
    ours = {i: {rng.randrange(30) for _ in range(rng.randint(1, 8))} for i in range(30)}
    theirs = {i: {rng.randrange(30) for _ in range(rng.randint(1, 8))} for i in range(30)}
    frame = lambda sets: spark.createDataFrame([(s, k) for s, keys in sets.items() for k in keys], "set long, key long")
    want = {(a, b, len(x & y)) for a, x in ours.items() for b, y in theirs.items() if len(x & y) >= 0.5 * min(len(x), len(y))}
    assert {(r.ours, r.theirs, r.shared) for r in overlap.overlaps(frame(ours), frame(theirs)).collect()} == want


def test_titles_must_not_be_empty(spark):
    side = lambda name: spark.createDataFrame([("b", 1, 1, f"{name}k", "", 10.0), ("b", 1, 2, f"{name}l", "x", 10.0), ("b", 1, 3, "same", "", None)], f"block string, {name}_set long, {name}_item long, {name}_key string, {name}_title string, {name}_seconds double")
    assert {(r.ours_item, r.theirs_item) for r in overlap.same_recordings(side("ours"), side("theirs"), ["block"]).collect()} == {(2, 2), (3, 3)}


def test_whereabouts(spark):
    log = spark.createDataFrame([(1, "a", "remove_from_library", "r"), (2, "a", "import_album", "i"), (3, "b", "skip_extra", "s"), (4, "b", "import_extra", "i"), (5, "c", "retag_by_fingerprint", "t")], "id long, source string, action string, detail string")
    matches = spark.createDataFrame([("d", False, None, "auto", None), ("e", False, "skip", "review", None), ("a", True, None, "auto", None)], "source string, imported boolean, decision string, action string, detail string")
    every, copies = spark.createDataFrame([(x,) for x in "abcdefg"], "source string"), spark.createDataFrame([("c", "k"), ("d", "k"), ("b", "k")], "source string, detail string")
    assert {r.source: r.status for r in placement.whereabouts(every, log, matches, copies).collect()} == {"a": "removed", "b": "duplicate", "c": "imported", "d": "duplicate", "e": "review", "f": "unmatched", "g": "unmatched"}
    assert {r.source: r.status for r in placement.manifest(every, log, matches, copies).collect()} == {"a": "imported", "b": "imported", "c": "imported", "d": "duplicate", "e": "decided:skip", "f": "unmatched", "g": "unmatched"}


@pytest.mark.parametrize(("name", "title", "album_title", "others", "seconds", "verdict", "whole"), [("My Album", "", "My Album", 4, 320.0, None, True), ("My Album", "", "My Album", 3, 320.0, None, False), ("My Album", "", "My Album", 4, 319.0, None, False), ("track", "", "My Album", 4, 320.0, None, False), ("x (Full Album)", "", "", 4, 320.0, None, True), ("My Album", "", "My Album", 4, 320.0, "confirmed", False), ("x", "Full album", "", 4, 320.0, None, True)])
def test_whole_album_files(spark, name, title, album_title, others, seconds, verdict, whole):
    rows = [("al", 0, name, title, album_title, seconds, verdict)] + [("al", i + 1, f"{i}", "", album_title, 400.0 / others, None) for i in range(others)]
    frame = spark.createDataFrame(rows, "album string, id long, name string, title string, album_title string, seconds double, verdict string")
    assert [r.id for r in albums.whole_album_files(frame).collect()] == ([0] if whole else [])


@pytest.mark.parametrize(("args", "want"), [((1, 1.0, 1, 1.0, 1, 1.0, 90.0, 100.0, None), None), ((None, None, 1, 1.0, 1, 1.0, 90.0, 100.0, None), "missing"), ((1, 1.0, 1, 2.0, 1, 1.0, 90.0, 100.0, None), "unseen"), ((1, 1.0, None, None, 1, 1.0, 90.0, 100.0, None), "unseen"), ((1, 1.0, 1, 1.0, None, None, None, None, None), "undecoded"), ((1, 1.0, 1, 1.0, 1, 1.0, 89.0, 100.0, None), "short"), ((1, 1.0, 1, 1.0, 1, 1.0, 89.0, 100.0, 90.0), None)])
def test_verified_copies(spark, args, want):
    assert one(spark, collection.unverified(*(F.lit(x).cast("double") for x in args))) == want


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('source = "in"\nlibrary = "lib"\nkey = "x"\n')
    (tmp_path / "a.local.toml").write_text('library = "other"\n')
    made = files.Settings.load(str(tmp_path / "a.toml"), {"LOOKUP_KEY": "y"})
    assert made.library == str(tmp_path / "other") and made.key == "y" and made.state == str(tmp_path / "state")
    for text, why in (('source = "in"\nlibrary = "in/lib"\n', "inside: library"), ('source = "in"\nlibrary = "l"\ninbox = "l/i"\n', "inside: inbox"), ('source = "in"\nlibrary = "i/l"\ninbox = "i"\n', "inside: library"), ('source = "in"\nstate = "in"\n', "inside: state"), ('library = "l"\n', "missing: source")):
        (tmp_path / "b.toml").write_text(text)
        with pytest.raises(ValueError, match=why):
            files.Settings.load(str(tmp_path / "b.toml"), {})


def test_lookups_turn_faults_into_rows(spark):
    def ask(keys):
        if "k7" in keys:
            raise OSError("down")
        return [k.upper() for k in keys]

    got = {r.id: (r.answer, r.error) for r in files.looked_up(spark.createDataFrame([(f"k{i}",) for i in range(12)], "id string").coalesce(1), ask, "string", batch=5, tries=2, wait=0.0).collect()}
    assert sum(a is not None for a, _ in got.values()) == 7 and got["k7"] == (None, "OSError: down")


def test_new_rows_must_be_one(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (None, "d"), (None, "e")], "k long, v string")
    assert sorted(r.v for r in files.upserted(old, new, "k").collect()) == ["a", "c", "d", "e"]
    with pytest.raises(Exception, match="several new rows"):
        files.upserted(old, new.unionAll(new), "k").collect()


def test_a_batch_by_name(spark):
    batches = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "1")], "batch long, folder string")
    assert [r.batch for r in albums.batch_of(batches, "x").collect()] == [1]
    for name in ("y", "1"):
        with pytest.raises(Exception, match="several batches"):
            albums.batch_of(batches, name).collect()
    with pytest.raises(Exception, match="z names no batch"):
        albums.batch_of(batches, "z").collect()
    names = spark.createDataFrame([("x",), ("y",), ("1",), ("2",), ("z",), (None,)], "name string")
    assert {(r.name, r.batch, r.refused) for r in albums.named(batches, names).collect()} == {("x", 1, None), ("y", None, "several"), ("1", None, "several"), ("2", 2, None), ("z", None, "none"), (None, None, "none")}


@pytest.mark.parametrize(("changed", "state"), [("2024-05-18 23:59:00", "not_due"), ("2024-05-18 00:01:00", "ready"), ("2024-05-18 00:01:01", "not_due")])
def test_whole_days_must_have_passed(spark, changed, state):
    batches = spark.createDataFrame([(1, "imported", None, True)], "batch long, status string, note string, inside boolean").withColumn("changed", F.lit(changed).cast("timestamp"))
    none = spark.createDataFrame([], "batch long, path string, why string, folder string, id long, action string")
    made = collection.prunable(batches, none.select("batch", "path"), none.select("path", "why"), none.select("path"), none.select("folder"), none.select("id", "path", "action"), F.lit("2024-06-01 00:01:00").cast("timestamp"))
    assert made.first().state == state


def test_plans(spark):
    assert one(spark, collection.match_action(F.lit(True), F.lit(0.0), F.lit(True))) == "review"
    assert one(spark, collection.match_action(F.lit(False), F.lit(None).cast("double"), F.lit(False))) == "unsorted"
    rows = spark.createDataFrame([("A/b/x",), ("A/bc/x",), ("loose",)], "path string")
    below = lambda *f: {r.path for r in collection.under(rows, spark.createDataFrame([(x,) for x in f], "folder string")).collect()}
    assert below("A/b/") == {"A/b/x"} and below("A/") == {"A/b/x", "A/bc/x"} and below("") == {"loose"}
    extras = spark.createDataFrame([("al", "e1", "x", 103.0), ("al", "e2", "x", 103.1), ("al", "e3", "x", None)], "album string, extra_id string, extra_title string, extra_seconds double")
    tracks = spark.createDataFrame([("al", "t1", "x", 100.0)], "album string, track_id string, track_title string, track_seconds double")
    assert [r.extra_id for r in collection.copies_of_tracks(extras, tracks).collect()] == ["e1"]
    swapped = spark.createDataFrame([("al", "f1", "one", ["two"], "mismatch"), ("al", "f2", "two", ["one"], "mismatch"), ("al", "f3", "three", ["odd"], "mismatch")], "album string, file string, title string, titles array<string>, verdict string")
    assert collection.swaps(swapped).first().swaps == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.MP3").write_bytes(b"one")
    (tmp_path / "a/y.txt").write_bytes(b"two!")
    found = {r.path.rsplit("/", 1)[1]: (r.kind, r["size"]) for r in files.listing(spark, str(tmp_path / "a")).collect()}
    assert found == {"x.MP3": ("audio", 3), "y.txt": ("other", 4)}
    assert files.hashes(spark, str(tmp_path / "a/b")).first().sha256.startswith("7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"[:12])
    pairs = [("TXXX:Artist", [b"A", b" B ", b"\xff"]), ("title", [b"x" * 2100]), ("APIC:", [b"p"]), ("wm/AlbumTitle", [b""])]
    rows = spark.createDataFrame([(pairs,)], "raw array<struct<name:string,values:array<binary>>>").select(files.raw_tags(F.col("raw")).alias("raw"))
    got = rows.select(*(c.alias(n) for n, c in files.tags(F.col("raw")).items())).first()
    assert (got.artist, len(got.title), got.album) == ("A; B", 2000, None)
    assert [one(spark, files.codec(*map(F.lit, x))) for x in (("EasyMP4", "alac.1", "m4a"), ("MP4", "mp4a", "m4a"), ("OggVorbis", "", "ogg"), ("", "", "wav"), ("FLAC", "", "x"))] == ["alac", "aac", "vorbis", "wav", "flac"]
    assert one(spark, files.kind_of(F.lit("mp4"))) == "audio" and one(spark, files.kind_of(F.lit("mkv"))) == "video"
    with pytest.raises(ValueError, match="nothing written"):
        files.all_or_nothing(spark.range(3), F.col("id") == 2, str(tmp_path / "out"))
    part = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    files.replace_partition(part, str(tmp_path / "p"), "k")
    files.replace_partition(part.where("k = 1").withColumn("v", F.lit("z")), str(tmp_path / "p"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "z"), (2, "y")}
    files.report(spark.createDataFrame([("secret", "</x>")], "path string, v string"), str(tmp_path / "r"))
    assert "secret" not in spark.read.text(str(tmp_path / "r")).first()[0]


def test_streams_tell_once(spark, tmp_path):
    folder = tmp_path / "in"
    for k, rows in enumerate([[(2, "a", 2), (1, "a", 5), (1, "b", 1)], [(3, "a", 4), (4, "a", 6), (2, "b", 1)]]):
        spark.createDataFrame(rows, "at long, k string, v long").coalesce(1).write.parquet(str(folder / f"{k}"))
        news = streams.told_stream(spark.readStream.schema("at long, k string, v long").parquet(str(folder / "*")), "k", "at", "v")
        news.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    told = {(r.at, r.k, r.news) for r in spark.read.schema(news.schema).parquet(str(tmp_path / "out")).collect()}
    assert told == {(1, "a", "new"), (1, "b", "new"), (3, "a", "grew"), (4, "a", "grew")}


def plain_names(wanted, taken):
    """One name after the other."""
    seen, out = set(taken), {}
    for order, name in sorted(wanted):
        folder, slash, last = name.rpartition("/")
        dot = last.rfind(".")
        stem, suffix = (last[:dot], last[dot:]) if 0 < dot < len(last) - 1 else (last, "")
        given, n = name, 2
        while given in seen:
            given, n = f"{folder}{slash}{stem} ({n}){suffix}", n + 1
        seen.add(given)
        out[order] = given
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_free_names(spark, monkeypatch, seed):
    monkeypatch.setattr(naming, "RANGE_ROWS", 40)
    rng = random.Random(seed)
    some = lambda: f"{rng.choice(['m/', 'm.d/', ''])}{rng.choice(['a', 'a', 'a (2)', 'a (2) (2)', 'a (3)', 'b.c', '.h', 'a (02)', 'a (1)'])}{rng.choice(['.mp3', '.mp3', '', '.'])}"
    wanted = [(k, some()) for k in range(150)] + [(1000 + k, "m/hot.mp3") for k in range(120)]
    taken = {some() for _ in range(12)} | {"m/hot.mp3", "m/hot (2).mp3", "m/hot (5).mp3", "m/hot (500).mp3", "m/hot (04).mp3"}
    given = naming.free_names(spark.createDataFrame(wanted, "order long, name string"), spark.createDataFrame([(t,) for t in taken], "name string"))
    got = {r.order: r.given for r in given.collect()}
    assert got == plain_names(wanted, taken) and not set(got.values()) & taken


def test_no_names(spark):
    none = spark.createDataFrame([], "order long, name string")
    assert naming.free_names(none, none.select("name")).count() == 0
    one = spark.createDataFrame([(1, "x"), (2, None)], "order long, name string")
    assert [r.given for r in naming.free_names(one, none.select("name")).collect()] == ["x"]


def test_fingerprints_in_batches():
    """Whole, cut, damaged and foreign texts, as one by one."""
    import pyarrow as pa

    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    texts = []
    for _ in range(3000):
        text = pack([rng.getrandbits(32) & rng.getrandbits(32) for _ in range(rng.randrange(0, 40) if rng.random() < 0.98 else 400)])
        kind = rng.randrange(8)
        if kind == 0:
            text = text[: rng.randrange(len(text) + 1)]
        elif kind == 1:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(alphabet + "+/ =é") + text[k + 1 :]
        elif kind == 2:
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        texts.append(None if rng.random() < 0.02 else text)
    want = [None if t is None else similarity.decode_one(t) for t in texts]
    assert similarity.decode_all(pa.array(texts, pa.string())).to_pylist() == want
    assert similarity.decode_all(pa.array(["x", *texts], pa.string())[1:]).to_pylist() == want and sum(w is None for w in want) > 300
    assert similarity.decode_all(pa.array([], pa.string())).to_pylist() == []


def test_rows_with_one_url_are_seen_each_by_itself(spark, tmp_path):
    from siftline.plans import queries

    rows = [(1, "http://a"), (2, "http://a"), (3, "ftp://a"), (4, "http://b"), (5, None), (7, "http://b")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in queries.prune_unseen(spark, str(tmp_path)).collect()) == [2, 3, 4, 5]


@pytest.mark.parametrize("common", [0, 2, 5, 1000])
def test_overlaps_count_frequent_keys_where_they_must(spark, common):
    rng = random.Random(21)
    own = lambda: {k: {min(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(1, 9))} for k in range(25)}
    ours, theirs = own(), own()
    rows = lambda sets: spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "set long, key long")
    want = {(a, b, len(s & t)) for a, s in ours.items() for b, t in theirs.items() if 2 * len(s & t) >= min(len(s), len(t))}
    got = overlap.overlaps(rows(ours), rows(theirs), common=common)
    assert sorted((r.ours, r.theirs, r.shared) for r in got.collect()) == sorted(want)


def test_refining_sends_no_prints_with_the_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 1, 2, 2, 0.5, False)], "ours long, theirs long, shared long, size_ours long, size_theirs long, share double, certain boolean")
    side = lambda name, keys: spark.createDataFrame([(1 if name == "ours" else 2, k, 10.0, p) for k, p in keys], f"{name}_set long, {name}_key long, {name}_seconds double, {name}_print array<long>")
    seen = overlap.refined(pairs, side("ours", [(1, [1]), (2, [7])]), side("theirs", [(1, [1]), (3, [7])]), F.when(F.col("ours_print") == F.col("theirs_print"), 1.0).otherwise(0.0))
    assert [tuple(r) for r in seen.collect()] == [(1, 2, 2, 1.0, 1.0)]
    assert "_print" not in seen._jdf.queryExecution().optimizedPlan().toString()


def test_prints_are_made_where_they_are_compared(spark, monkeypatch):
    from siftline.plans import queries

    plans, write = {}, dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda rows, name: plans.update({name: rows._jdf.queryExecution().executedPlan().toString().splitlines()}) or write(rows, name))
    queries.refined_overlaps(spark, "/root/testdata/sf0.001")
    assert set(plans) == {"overlaps", "near", "alike"}
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for plan in plans.values():
        for at, line in enumerate(plan):
            if "BroadcastExchange" in line:
                sent = itertools.takewhile(lambda x: depth(x) > depth(line), plan[at + 1 :])
                assert not any("array_repeat" in x for x in sent)
    assert any("array_repeat" in x for x in plans["alike"])
    assert not any("SortAggregate" in x for x in plans["alike"])
    assert any("REPARTITION_BY_NUM" in x for x in plans["near"])


def test_groups_of_many_keys_are_dealt_before_they_are_made(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    here = albums.only_here(rows([(1, 1, 5), (1, 2, 5), (1, 2, 6), (1, 2, 6), (2, 1, 7), (1, None, 8), (1, None, 9), (1, 3, 9)], "group long, album long, item long"))
    assert sorted(map(tuple, here.collect()), key=str) == [(1, 2, 1), (1, None, 1), (2, 1, 1)]
    gone = albums.upgrade_removals(rows([("in/a/1", "l/"), ("in/a/2", "l/x/")], "path string, replaced string"), rows([(1, "in/a/", "imported", "approve")], "album long, folder string, status string, decision string"), rows([("old/1", "l/x/1"), ("in/2", "l/x/2")], "source string, dest string"), F.lit("in/"))
    assert [tuple(r) for r in gone.collect()] == [(1, "l/x/1")]
    paths = rows([("m/a (CD1)/1",), ("m/a (CD2)/1",), ("m/b/1",), ("m/b/2",), ("m/c/d/1",)], "path string")
    discs = albums.disc_albums(paths, rows([("m/b/2",)], "path string"), rows([("m/c/",)], "folder string"))
    assert sorted(map(tuple, discs.collect())) == [("m/a/", 2, 2, "m/a (CD1)/"), ("m/b/", 1, 1, "m/b/")]
    for found in (here, gone, discs):
        assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_one_name_or_recording_of_many_makes_no_squared_pairs(spark):
    n = 3000
    many = spark.range(n)
    want = many.select(F.col("id").alias("key"), F.lit("A").alias("artist"), F.lit("T").alias("title"))
    lib = many.select(F.col("id").alias("album"), F.lit("the a").alias("artist"), F.lit("t").alias("title"))
    new = albums.arrivals(want, lib, spark.createDataFrame([(0, 0), (0, 1), (5, 0), (6, 1)], "key long, album long"))
    tracks = many.select(F.lit(1).alias("album"), F.col("id").alias("track"), F.lit(1).alias("recording"), (F.col("id") % 3).alias("disc"), F.lit(1).alias("place"))
    items = many.select(F.lit(1).alias("album"), F.col("id").alias("item"), F.lit(None).cast("long").alias("release_track"), F.lit(1).alias("recording"), (F.col("id") % 4).alias("disc"), F.lit(1).alias("place"))
    held = matching.release_tracks(items, tracks)
    assert {r.key: r.album for r in new.collect()} == {k: {0: 2, 5: 1}.get(k, 0) for k in range(n)}
    assert sorted((r.item, r.track) for r in held.collect()) == [(k, k % 4) for k in range(n) if k % 4 < 3]
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "place#" in plan(new) and plan(held).count("Aggregate") >= 3  # before anything meets


def test_evidence_is_dealt_by_album_once(spark):
    kind = "album long, id long, name string, albumartist string, artist string, title string, date string, codec string, minutes double, verdict string"
    rows = spark.createDataFrame([(1, k, f"n{k}", "", "a" if k else "b", "t", None, "x", 1.5, "confirmed") for k in range(3)], kind)
    found = albums.evidence(rows)
    assert [(r.files, r.minutes, r.artist, r.sample) for r in found.collect()] == [(3, 4.5, "a", "1:n0;2:n1;3:n2")]
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan


def test_relabelling_groups_the_lines_once(spark):
    """A plan reads its files and tracks a dozen times; none of that may read and group all lines again."""
    from siftline.plans import relabelling

    for rows in relabelling._files(spark, "/root/testdata/sf0.001"):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan


def test_a_batch_is_dealt_by_folder_once(spark):
    rows = spark.createDataFrame
    dropped = rows([("b/1/", "folder", True, "b/9/", 1.0), ("b/2/", "folder", False, "b/9/", 1.0), ("b/5/y", "file", True, "b/9/y", 1.0)], "path string, scope string, auto boolean, other string, share double")
    pairs = rows([("b/1/", "l/1/", 1.0), ("b/2/", "l/2/", 0.9), ("b/2/", "l/1/", 0.95), ("b/2/", "l/1/", 0.95), ("b/3/", "l/8/", 1.0)], "ours string, theirs string, share_ours double")
    same = rows([("b/2/", "l/2/", 0.5, True), ("b/3/", "l/3/", 0.5, False), ("b/4/", "l/3/", 0.6, True)], "ours_set string, theirs_set string, covered double, held boolean")
    facts = rows([(f"b/{k}/", f"l/{n}/", "skip", "duplicate") for k in range(1, 5) for n in range(1, 4)] * 2, "ours string, theirs string, outcome string, kind string")
    files = rows([(f"b/{k}/", f"b/{k}/{name}", digest) for k in range(1, 6) for name, digest in (("x", 7), ("y", 7), ("z", None))], "folder string, path string, digest long")
    library = rows([("l/b", 7), ("l/a", 7), ("l/c", None)], "path string, digest long")
    elsewhere = rows([("b/1/", "d/1/", 0.9), ("b/5/", "d/1/", 0.9), ("b/5/", "d/1/", 0.9), ("b/5/", "d/1/", 0.8)], "ours string, theirs string, share double")
    plan = overlap.batch_plan(dropped, pairs, same, facts, files, library, elsewhere)
    assert sorted(tuple(r) for r in plan.collect()) == sorted([
        ("b/1/", "folder", "skip", "in_batch", "b/9/", 1.0), ("b/2/", "folder", "review", "in_batch_review", "b/9/", 1.0), ("b/5/y", "file", "skip", "in_batch", "b/9/y", 1.0),
        ("b/2/", "folder", "skip", "duplicate", "l/1/", 0.95), ("b/3/", "folder", "review", "edition", "l/3/", 0.5), ("b/4/", "folder", "skip", "duplicate", "l/3/", 0.6),
        ("b/5/x", "file", "skip", "identical", "l/a", 1.0), ("b/5/", "folder", "flag", "dump_overlap", "d/1/", 0.9), ("b/5/", "folder", "flag", "dump_overlap", "d/1/", 0.8)])
    dealt = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning(ours#" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]  # which adaptive plans leave as they are
