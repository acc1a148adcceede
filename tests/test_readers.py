"""Walks, digests, tags and look-ups against plain versions, with links, damage and a service that misbehaves."""

from __future__ import annotations

import hashlib
import os
import struct
import time

import pytest

from siftline.plans import filesets
from siftline.sources import lookups, readers

TAGS = {"artist": "Björk", "title": "Jóga", "track": "5", "mb_trackid": "T1", "acoustid_id": "A1"}


def test_walk(spark, tmp_path):
    for name in ("a/b/c/1.mp3", "a/2.FLAC", "3", "a/.hidden/4.ogg", "ä ö/x y.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/link.mp3").symlink_to(tmp_path / "3")
    (tmp_path / "round").symlink_to(tmp_path / "a")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    os.mkfifo(tmp_path / "a/pipe")
    (tmp_path / "shut").mkdir()
    (tmp_path / "shut/5.mp3").write_bytes(b"x")
    os.chmod(tmp_path / "shut", 0)
    want = {}
    for folder, _, names in os.walk(tmp_path):
        for name in names:
            full = os.path.join(folder, name)
            if os.path.isfile(full) and not os.path.islink(full):
                want[full] = (os.stat(full).st_size, os.stat(full).st_mtime)
    got = {r.path: (r.size, r.mtime) for r in readers.walk(spark, str(tmp_path)).collect()}
    assert got == want and str(tmp_path / "a/b/c/1.mp3") in got
    assert {r.path for r in readers.walk(spark, f"file://{tmp_path}").collect()} == {f"file://{x}" for x in want}
    os.chmod(tmp_path / "shut", 0o700)
    assert readers.walk(spark, str(tmp_path / "empty")).count() == 0 and readers.walk(spark, str(tmp_path / "not there")).count() == 0


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large", "wb") as file:
        file.truncate((2 << 30) + 12345)
    (tmp_path / "small").write_bytes(b"")
    made = hashlib.sha256()
    for _ in range(2048):
        made.update(bytes(1 << 20))
    made.update(bytes(12345))
    paths = spark.createDataFrame([(str(tmp_path / x),) for x in ("large", "small", "missing")], "path string")
    got = {os.path.basename(r.path): (r.sha256, r.error) for r in readers.digests(paths).collect()}
    assert got["large"] == (made.hexdigest(), None) and got["small"] == (hashlib.sha256().hexdigest(), None)
    assert got["missing"][0] is None and "FileNotFoundError" in got["missing"][1]


def v23(unsync: bool, extended: bool) -> bytes:
    """ID3v2.3, with what its flags change."""
    frame = lambda name, body: name + len(body).to_bytes(4, "big") + b"\0\0" + body
    body = (b"\0\0\0\6" + bytes(6) if extended else b"") + frame(b"TPE1", b"\1" + "A\0B".encode("utf-16")) + frame(b"TALB", b"\0Ol\xe9") + frame(b"TYER", b"\0" + b"1999")
    if unsync:
        body = body.replace(b"\xff", b"\xff\x00")
    n = len(body)
    return b"ID3\3\0" + bytes([0x80 * unsync | 0x40 * extended]) + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_tags(spark, tmp_path):
    made = {name: write(TAGS) for name, write in filesets.CONTAINERS.items()}
    long = dict(TAGS, title="x" * 200000)
    made |= {"ogg_pages": filesets.ogg(long, 7), "flac_many": filesets.flac(TAGS).replace(b"Title", b"title"), "v23": v23(False, False), "v23_all": v23(True, True)}
    for name, data in list(made.items()):
        made[f"cut_{name}"] = data[: data.find("Björk".encode()) + 3 if "Björk".encode() in data else 30]
    made |= {"none": b"", "zeros": bytes(100), "text": b"ID3 is only said here", "no_tags": b"fLaC\x80\0\0\x22" + bytes(34), "mp4_none": struct.pack(">I", 8) + b"ftyp"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.path): r for r in readers.read_tags(readers.walk(spark, str(tmp_path))).collect()}
    assert set(got) == set(made)
    for name in (*filesets.CONTAINERS, "flac_many"):
        r = got[name]
        assert (r.artist, r.title, r.track, r.mb_trackid, r.acoustid_id, r.album, r.error) == ("Björk", "Jóga", "5", "T1", "A1", None, None), name
    assert got["ogg_pages"].title == "x" * 2000 and got["ogg_pages"].artist == "Björk"
    for name in ("v23", "v23_all"):
        assert (got[name].artist, got[name].album, got[name].date, got[name].error) == ("A; B", "Olé", "1999", None), name
    for name in ("none", "zeros", "text", *(x for x in made if x.startswith("cut_"))):
        assert got[name].error and got[name].artist is None, name
    for name in ("no_tags", "mp4_none"):
        assert got[name].error is None and got[name].artist is None


def test_a_service_that_fails_slows_down_and_answers_short(spark, tmp_path):
    seen = str(tmp_path)

    def ask(keys):
        now = time.time()
        turn = len([x for x in os.listdir(seen) if x.endswith(keys[0])])
        with open(f"{seen}/{now:.6f} {keys[0]}", "w"):
            pass
        if keys[0] == "k000" and turn < 2:
            raise OSError("try later")
        if keys[0] == "k003":
            return ["short"]
        if keys[0] == "k006":
            time.sleep(0.5)
        return [k.upper() for k in keys]

    lookups.register(spark, "moody", ask, "string")
    keys = spark.createDataFrame([(f"k{n:03}",) for n in range(30)] * 2 + [(None,)], "k string")
    began = time.time()
    rows = lookups.looked_up(keys.coalesce(1).orderBy("k"), "moody", slots=1, batch=3, tries=3, wait=0.1, interval=0.05).collect()
    got = {r.key: (r.answer, r.error) for r in rows}
    assert len(rows) == len(got) == 30
    bad = {k for k, (a, e) in got.items() if e}
    assert all(a == k.upper() for k, (a, e) in got.items() if not e) and all("1 answers to 3 keys" in got[k][1] for k in bad)
    times = sorted(float(x.split()[0]) for x in os.listdir(seen))
    assert len(times) >= 10 and times[-1] - began >= 0.05 * (len(times) - 1) and min(b - a for a, b in zip(times, times[1:])) >= 0.045


def test_slots_share_one_rate(spark, tmp_path):
    seen = str(tmp_path)

    def ask(keys):
        with open(f"{seen}/{time.time():.6f} {keys[0]}", "w"):
            pass
        return [len(k) for k in keys]

    lookups.register(spark, "steady", ask, "long")
    keys = spark.createDataFrame([("x" * n,) for n in range(1, 25)], "k string")
    assert {(len(r.key), r.answer) for r in lookups.looked_up(keys, "steady", slots=4, batch=2, interval=0.1).collect()} == {(n, n) for n in range(1, 25)}
    times = sorted(float(x.split()[0]) for x in os.listdir(seen))
    for a in times:  # in a stretch of 0.4 s each slot makes one request, and two at its ends
        assert sum(a <= t < a + 0.39 for t in times) <= 4


def test_refusal_ends_the_read(spark):
    def ask(keys):
        raise lookups.Refused("invalid key")

    lookups.register(spark, "shut", ask, "string")
    with pytest.raises(Exception, match="invalid key"):
        lookups.looked_up(spark.createDataFrame([("a",)], "k string"), "shut").collect()


def test_digests_send_no_list_of_files_to_the_driver(spark):
    """What a walk knows of a file goes along with its path: no join, and so nothing that is broadcast."""
    from siftline.plans import catalog

    plan = catalog.QUERIES["file_digests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
