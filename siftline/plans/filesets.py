"""Files that tasks write from the test tables and find again: walks, digests, tags and a service, with SQL that says what they hold."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import dedupe, naming
from siftline.plans.registry import query, table
from siftline.sources import lookups, readers


def put(rows: DataFrame, content: Callable[[dict], bytes], suffix: str) -> str:
    """Writes a file for each row (id, ...) below a new folder, in tasks, and gives the folder."""
    top = dedupe.shared_folder(rows.sparkSession, "files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = readers.opened(top)
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{at}/{row['id'] % 7}/{row['id'] % 3}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{row['id']}.{suffix}") as file:
                    file.write(content(row))
            yield batch.select(["id"])

    rows.mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()
    return top


def _id(path: str) -> F.Column:
    return F.regexp_extract(path, r"([0-9]+)\.[a-z0-9]+$", 1).cast("long").alias("id")


# --- containers ------------------------------------------------------------------------------------------


def _frame(name: bytes, body: bytes) -> bytes:
    n = len(body)
    return name + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0" + body


def id3(tags: dict[str, str]) -> bytes:
    """ID3v2.4: texts as UTF-8 or UTF-16, a picture between them, padding and something like sound behind."""
    body = _frame(b"TPE1", b"\3" + tags["artist"].encode()) + _frame(b"APIC", b"\0image/png\0\3\0" + bytes(3000)) + _frame(b"TIT2", b"\1" + tags["title"].encode("utf-16")) + _frame(b"TRCK", b"\0" + tags["track"].encode("latin-1")) + _frame(b"UFID", readers.RECORDING.encode() + b"\0" + tags["mb_trackid"].encode()) + _frame(b"TXXX", b"\3Acoustid Id\0" + tags["acoustid_id"].encode()) + bytes(64)
    n = len(body)
    return b"ID3\4\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + b"\xff\xfb" * 500


def _vorbis(tags: dict[str, str]) -> bytes:
    names = {"artist": "ARTIST", "title": "Title", "track": "TRACKNUMBER", "mb_trackid": "MUSICBRAINZ_TRACKID", "acoustid_id": "ACOUSTID_ID"}
    texts = [f"{names[k]}={v}".encode() for k, v in tags.items()] + [b"METADATA_BLOCK_PICTURE=AAAA"]
    return struct.pack("<I", 4) + b"made" + struct.pack("<I", len(texts)) + b"".join(struct.pack("<I", len(t)) + t for t in texts)


def flac(tags: dict[str, str]) -> bytes:
    block = lambda kind, body: bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"fLaC" + block(0, bytes(34)) + block(6, bytes(4000)) + block(4 | 128, _vorbis(tags)) + b"\xff\xf8" * 500


def ogg(tags: dict[str, str], most: int = 255) -> bytes:
    """A head packet, and comments over as many pages as so many segments a page make."""

    def pages(packet: bytes, first: int) -> Iterator[bytes]:
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for k in range(0, len(sizes), most):
            own = sizes[k : k + most]
            yield b"OggS\0" + bytes([first if k == 0 else 1]) + bytes(20) + bytes([len(own)]) + bytes(own) + packet[at : at + sum(own)]
            at += sum(own)

    return b"".join([*pages(b"\x01vorbis" + bytes(23), 2), *pages(b"\x03vorbis" + _vorbis(tags) + b"\1", 0)]) + b"OggS" + bytes(23)


def mp4(tags: dict[str, str]) -> bytes:
    atom = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    data = lambda body, kind=1: atom(b"data", struct.pack(">II", kind, 0) + body)
    free = lambda name, text: atom(b"----", atom(b"mean", b"\0\0\0\0com.apple.iTunes") + atom(b"name", b"\0\0\0\0" + name) + data(text.encode()))
    items = atom(b"\xa9ART", data(tags["artist"].encode())) + atom(b"covr", data(bytes(3000), 14)) + atom(b"\xa9nam", data(tags["title"].encode())) + atom(b"trkn", data(struct.pack(">HHHH", 0, int(tags["track"]), 0, 0), 0)) + free(b"MusicBrainz Track Id", tags["mb_trackid"]) + free(b"Acoustid Id", tags["acoustid_id"])
    return atom(b"ftyp", b"M4A \0\0\0\0") + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 2016) + bytes(2000) + atom(b"moov", atom(b"mvhd", bytes(100)) + atom(b"udta", atom(b"meta", bytes(4) + atom(b"hdlr", bytes(25)) + atom(b"ilst", items))))


CONTAINERS = {"mp3": id3, "flac": flac, "ogg": ogg, "mp4": mp4}


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN ['mp3', 'flac', 'ogg', 'mp4'][1 + p_partkey % 4] END AS container, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS artist, CASE WHEN p_partkey % 9 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_partkey % 20 AS VARCHAR) END AS track,
CASE WHEN p_partkey % 9 > 0 THEN 'T' || p_partkey END AS mb_trackid, CASE WHEN p_partkey % 9 > 0 THEN p_type END AS acoustid_id, CASE WHEN p_partkey % 9 = 0 THEN 'ValueError: unknown kind of file' END AS error FROM part""")
def file_tags(spark, sf):
    """SRC-01, SRC-04, SRC-05, SRC-08: tags from the heads of files of four kinds, found by a walk; every ninth is damaged."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), F.col("p_type").alias("type"))

    def content(row: dict) -> bytes:
        tags = {"artist": row["artist"], "title": row["title"], "track": str(row["id"] % 20), "mb_trackid": f"T{row['id']}", "acoustid_id": row["type"]}
        return list(CONTAINERS.values())[row["id"] % 4](tags) if row["id"] % 9 else b"nothing of the kind"

    found = readers.read_tags(readers.walk(spark, put(rows, content, "audio")))
    return found.select(_id("path"), "container", "artist", "title", "track", "mb_trackid", "acoustid_id", "error")


@query("SELECT p_partkey AS id, octet_length(encode(p_name || p_type)) AS size, sha256(p_name || p_type) AS sha256 FROM part")
def file_digests(spark, sf):
    """SRC-01, SRC-03: files found by a walk, read a piece at a time."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", "p_type").alias("text"))
    found = readers.walk(spark, put(rows, lambda row: row["text"].encode(), "txt"))
    return readers.digests(found, keep=("size",)).where("error is null").select(_id("path"), "size", "sha256")


def _service(keys: list[str]) -> list[str]:
    if any(k.endswith("7") for k in keys):
        raise ValueError("unknown key")
    return [hashlib.sha256(k.encode()).hexdigest()[:12] for k in keys]


@query("SELECT DISTINCT p_type || p_brand AS key, CASE WHEN NOT ends_with(p_brand, '7') THEN substr(sha256(p_type || p_brand), 1, 12) END AS answer, CASE WHEN ends_with(p_brand, '7') THEN 'ValueError: unknown key' END AS error FROM part")
def service_answers(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12, SRC-13: a service as a data source, asked by several tasks at one rate; keys that it refuses are rows with an error."""
    lookups.register(spark, "digest_service", _service, "string")
    return dedupe.written(lookups.looked_up(table(spark, sf, "part").select(F.concat("p_type", "p_brand")), "digest_service", slots=4, batch=1, tries=2, wait=0.0, interval=0.0), "answers")


@query("""WITH w AS (SELECT p_partkey AS "order", p_partkey % 40 AS k, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS place FROM part), b AS (SELECT DISTINCT s_suppkey % 40 AS k, CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE s_suppkey % 13 END AS n FROM supplier WHERE s_suppkey % 13 <> 1),
r AS (SELECT k, unnest(range(1, count(*) + 15)) AS n FROM w GROUP BY k), f AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS place FROM r ANTI JOIN b USING (k, n))
SELECT "order", 'm.d/' || k || '.mp3' AS name, 'm.d/' || k || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.mp3' AS given FROM w JOIN f USING (k, place)""")
def free_names(spark, sf):
    """PRJ-15: names for many files that want the same ones, where some exist."""
    part, key = table(spark, sf, "part"), F.col("s_suppkey")
    name = lambda k, more: F.concat(F.lit("m.d/"), k.cast("string"), more, F.lit(".mp3")).alias("name")
    n = key % 13
    taken = table(spark, sf, "supplier").select(name(key % 40, F.when(n == 0, "").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(")")))))
    return naming.free_names(part.select(F.col("p_partkey").alias("order"), name(F.col("p_partkey") % 40, F.lit(""))), taken)
