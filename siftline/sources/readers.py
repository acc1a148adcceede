"""Files read by tasks: a walk by rounds, digests of files of any size, tags from the heads of files (SRC-01, SRC-03, SRC-04, SRC-08)."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import dedupe
from siftline.sources import files

CHUNK = 1 << 20  # bytes read at once
MOST_VALUE = 1 << 20  # bytes of a tag's value; longer ones are passed over
MOST_HEAD = 16 << 20  # bytes of a head that must be held whole
ROWS = 4096  # in a batch

#: Names of ID3 frames and of MP4 atoms.
FRAMES = {"TPE1": "artist", "TPE2": "albumartist", "TALB": "album", "TIT2": "title", "TRCK": "tracknumber", "TPOS": "discnumber", "TDRC": "date", "TYER": "date", "TDOR": "originaldate"}
ATOMS = {b"\xa9ART": "artist", b"aART": "albumartist", b"\xa9alb": "album", b"\xa9nam": "title", b"\xa9day": "date", b"trkn": "tracknumber", b"disk": "discnumber"}
ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
RECORDING = "http://musicbrainz.org"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there, which may hold any characters."""
    scheme, mark, rest = path.partition("://") if "://" in path else ("file", "", path.removeprefix("file:"))
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    host, _, below = rest.partition("/")
    system, top = fs.FileSystem.from_uri(f"{scheme}{mark}{host}/")
    return system, f"{top.rstrip('/')}/{below}"


# --- walk ------------------------------------------------------------------------------------------------


def entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """What a folder holds: path, whether it is a folder, size and time of change. Links and what can't be read are left out; a folder that can't be read has nothing."""
    system, at = opened(folder)
    if isinstance(system, fs.LocalFileSystem):
        mark = folder[: len(folder) - len(at)]
        try:
            with os.scandir(at) as found:
                for entry in found:
                    try:
                        inside, plain = entry.is_dir(follow_symlinks=False), entry.is_file(follow_symlinks=False)
                        if inside or plain:
                            state = entry.stat(follow_symlinks=False)
                            yield f"{mark}{entry.path}", inside, state.st_size, state.st_mtime
                    except OSError:
                        continue
        except OSError:
            return
    else:
        mark = folder[: len(folder) - len(at)]
        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield f"{mark}{info.path}", info.type == fs.FileType.Directory, info.size or 0, info.mtime.timestamp() if info.mtime else 0.0


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def walk(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """SRC-01: path, size and mtime of every regular file below root: tasks list the folders of one depth after the other, so the driver holds no list, and there are
    as many rounds as folders are deep. Links to files or folders aren't followed; what can't be read is left out."""
    tasks = tasks or spark.sparkContext.defaultParallelism
    schema = pa.schema([("path", pa.string()), ("inside", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for batch in batches for folder in batch.column(0).to_pylist() for row in entries(folder)), schema)

    kinds, at, depth = "path string, inside boolean, size long, mtime double", dedupe.shared_folder(spark, "walk"), 0
    todo = spark.range(1).select(F.lit(root.rstrip("/") or "/").alias("path"))
    while True:
        todo.repartition(tasks, "path").mapInArrow(listed, kinds).write.parquet(f"{at}/depth={depth}")
        todo = spark.read.schema(kinds).parquet(f"{at}/depth={depth}").where("inside").select("path")
        if todo.isEmpty():
            break
        depth += 1
    return spark.read.schema(kinds).parquet(*(f"{at}/depth={d}" for d in range(depth + 1))).where("not inside").select("path", "size", "mtime")


# --- digests ---------------------------------------------------------------------------------------------


def digest(path: str, chunk: int = CHUNK) -> str:
    system, at = opened(path)
    made = hashlib.sha256()
    with system.open_input_stream(at) as file:
        while data := file.read(chunk):
            made.update(data)
    return made.hexdigest()


def _tried(read: Callable, path: str) -> tuple:
    """What read(path) gives and no fault, or nothing and the fault (SRC-08)."""
    try:
        return read(path), None
    except Exception as fault:  # whatever is wrong with a file becomes a row
        return None, f"{type(fault).__name__}: {fault}"[:300]


def digests(paths: DataFrame, tasks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-03: path, sha256, error and the columns of `keep` of each file of paths (path, ...), read CHUNK bytes at a time: a file's size doesn't matter. Files are dealt to
    tasks by their paths; what is known of them goes along, as a join would send it to the driver while it looks small."""
    kept = paths.select(*keep).schema
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = zip(*((path, *_tried(digest, path)) for path in part.column(0).to_pylist()), strict=True)
                own = [pa.array(c, f.type) for c, f in zip(made, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *part.columns[1:]], names=[*schema.names, *part.schema.names[1:]])

    tasks = tasks or paths.sparkSession.sparkContext.defaultParallelism
    out = T.StructType([T.StructField(n, T.StringType()) for n in schema.names] + list(kept))
    return paths.select("path", *keep).repartition(tasks, "path").mapInArrow(run, out)


# --- tags ------------------------------------------------------------------------------------------------


class Head:
    """A file from its beginning; only what is asked for is read."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def get(self, at: int, n: int) -> bytes:
        if n > MOST_HEAD or at + n > self.size:
            raise ValueError(f"{n} bytes at {at} of {self.size}")
        return self.file.read_at(n, at)


def _syncsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _texts(body: bytes) -> list[bytes]:
    """The values of an ID3 text: a byte of encoding, then texts between zero characters."""
    text = body[1:].decode(ENCODINGS[body[0]])
    return [x.lstrip("﻿").encode() for x in text.rstrip("\0").split("\0")]


def _id3(head: Head) -> list[tuple[str, list[bytes]]]:
    mark = head.get(0, 10)
    version, flags, end = mark[3], mark[5], 10 + _syncsafe(mark[6:10])
    if version not in (3, 4):
        raise ValueError(f"ID3 version 2.{version}")
    source, at = head, 10
    if flags & 0x80 and version == 3:  # bytes that were put in all over the tag
        plain = pa.BufferReader(mark + head.get(10, end - 10).replace(b"\xff\x00", b"\xff"))
        source, end = Head(plain), plain.size()
    if flags & 0x40:
        own = source.get(at, 4)
        at += _syncsafe(own) if version == 4 else 4 + int.from_bytes(own, "big")
    out = []
    while at + 10 <= end:
        frame = source.get(at, 10)
        if frame[0] == 0:
            break
        name, size = frame[:4].decode("ascii"), _syncsafe(frame[4:8]) if version == 4 else int.from_bytes(frame[4:8], "big")
        if at + 10 + size > end:
            raise ValueError(f"frame {name} ends behind the tag")
        if name[0] == "T" and 0 < size <= MOST_VALUE:
            body = source.get(at + 10, size)
            if version == 4 and frame[9] & 1:  # its length stands before it
                body = body[4:]
            if version == 4 and frame[9] & 2:
                body = body.replace(b"\xff\x00", b"\xff")
            values = _texts(body)
            out.append((f"TXXX:{values[0].decode()}", values[1:]) if name == "TXXX" else (FRAMES.get(name, name), values))
        elif name == "UFID" and size <= MOST_VALUE:
            owner, _, value = source.get(at + 10, size).partition(b"\0")
            out.append(("musicbrainz_trackid" if owner.decode("latin-1") == RECORDING else f"UFID:{owner.decode('latin-1')}", [value]))
        else:
            out.append((name, []))
        at += 10 + size
    return out


def _comments(data: bytes) -> list[tuple[str, list[bytes]]]:
    """Vorbis comments: a name of who wrote them, then texts name=value; equal names together."""
    at = 4 + struct.unpack_from("<I", data)[0]
    (count,), at, found = struct.unpack_from("<I", data, at), at + 4, {}
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("a comment ends behind its block")
        name, _, value = data[at + 4 : at + 4 + n].partition(b"=")
        found.setdefault(name.decode("ascii").lower(), []).append(value)
        at += 4 + n
    return list(found.items())


def _flac(head: Head) -> list[tuple[str, list[bytes]]]:
    at, last = 4, False
    while not last:
        mark = head.get(at, 4)
        last, kind, size = mark[0] > 127, mark[0] & 127, int.from_bytes(mark[1:], "big")
        if kind == 4:
            return _comments(head.get(at + 4, size))
        at += 4 + size
    return []


def _ogg(head: Head) -> list[tuple[str, list[bytes]]]:
    """The second packet of the stream, which may reach over several pages."""
    packet, seen, at = bytearray(), 0, 0
    while True:
        page = head.get(at, 27)
        if page[:4] != b"OggS":
            raise ValueError("no page where one should be")
        sizes = head.get(at + 27, page[26])
        at += 27 + len(sizes)
        for size in sizes:
            if seen == 1:
                packet += head.get(at, size)
                if len(packet) > MOST_HEAD:
                    raise ValueError("comments are too long")
            at += size
            if size < 255:
                seen += 1
                if seen == 2:
                    kind = next((x for x in (b"\x03vorbis", b"OpusTags") if packet.startswith(x)), None)
                    if kind is None:
                        raise ValueError("no comments in the second packet")
                    return _comments(bytes(packet[len(kind) :]))


def _atoms(head: Head, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, first byte of the body and end of each atom."""
    while at + 8 <= end:
        size, name = int.from_bytes(head.get(at, 4), "big"), head.get(at + 4, 4)
        skip = 8
        if size == 1:
            size, skip = int.from_bytes(head.get(at + 8, 8), "big"), 16
        size = size or end - at
        if size < skip or at + size > end:
            raise ValueError(f"atom {name!r} ends behind what holds it")
        yield name, at + skip, at + size
        at += size


def _mp4(head: Head) -> list[tuple[str, list[bytes]]]:
    found = [(0, head.size)]
    for step in (b"moov", b"udta", b"meta", b"ilst"):
        found = [(a + 4 * (step == b"meta"), b) for first, end in found for name, a, b in _atoms(head, first, end) if name == step]
    out = []
    for first, end in found:
        for name, a, b in _atoms(head, first, end):
            parts: dict[bytes, list[bytes]] = {}
            for kind, x, y in _atoms(head, a, b):
                if y - x <= MOST_VALUE and (name in ATOMS or name == b"----"):
                    parts.setdefault(kind, []).append(head.get(x, y - x))
            values = [v[8:] for v in parts.get(b"data", [])]
            if name in (b"trkn", b"disk"):
                pairs = [struct.unpack_from(">HH", v, 2) for v in values]
                values = [(f"{n}/{of}" if of else f"{n}").encode() for n, of in pairs]
            own = parts[b"name"][0][4:].decode() if name == b"----" else ATOMS.get(name, name.decode("latin-1"))
            out.append((own, values))
    return out


def pairs(path: str) -> tuple[str, list[tuple[str, list[bytes]]]]:
    """The kind of a file and its raw names with their values; pictures and other large values aren't read."""
    system, at = opened(path)
    with system.open_input_file(at) as file:
        head = Head(file)
        mark = head.get(0, min(12, head.size))
        if mark[:3] == b"ID3":
            return "mp3", _id3(head)
        if mark[:4] == b"fLaC":
            return "flac", _flac(head)
        if mark[:4] == b"OggS":
            return "ogg", _ogg(head)
        if mark[4:8] == b"ftyp":
            return "mp4", _mp4(head)
        raise ValueError("unknown kind of file")


def read_tags(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """SRC-04, SRC-05, SRC-08: path, container, the fields of files.ALIASES and error, of each file of paths (path, ...), from ID3v2, FLAC, Ogg and MP4 heads. A damaged file is a row with
    its error."""
    one = pa.struct([("name", pa.string()), ("values", pa.list_(pa.binary()))])
    schema = pa.schema([("path", pa.string()), ("container", pa.string()), ("raw", pa.list_(one)), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, why = _tried(pairs, path)
                kind, held = found or (None, None)
                yield path, kind, held and [{"name": n, "values": v} for n, v in held], why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    tasks = tasks or paths.sparkSession.sparkContext.defaultParallelism
    read = paths.select("path").repartition(tasks, "path").mapInArrow(run, "path string, container string, raw array<struct<name:string,values:array<binary>>>, error string")
    named = read.withColumn("raw", files.raw_tags(F.coalesce("raw", F.array().cast("array<struct<name:string,values:array<binary>>>"))))
    return named.select("path", "container", *(c.alias(n) for n, c in files.tags(F.col("raw")).items()), "error")
