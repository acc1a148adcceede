"""WARC records in ZIP archives, and a reader that never unpacks them.

An archive holds two stored members, which ZIP itself doesn't compress: archive/data.warc.gz, each record a
gzip member of its own, and indexes/index.cdxj, whose lines have a record's offset and length. The reader opens an archive by its end: the end record, the ZIP64 end
record if there is one, the central directory, then each wanted member's local header; it reads the index,
then each record by its range. Archives go to a folder that all executors share.

A null html is an empty payload. Of records with equal payloads of at least min_bytes the one with the
largest page_id is the response; rows that repeat that page_id too are all responses. A null page_id is
smaller than any other. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import shared

MIN_BYTES = 0
ARCHIVE_BYTES = 64 << 20  # of records, after which a task begins another archive
HOT_ROWS = 256
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://"))


# --- ZIP ---------------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, one after the other, each of a length known only at its end; ZIP64 where it must be or always."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.members = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # Bit 3: sizes follow the data; the central directory has them as well.
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> None:
        self._put(data)
        own = self.members[-1]
        own[2] += len(data)
        own[3] = zlib.crc32(data, own[3])

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        wide = self.zip64 or size >= FULL32
        self._put(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, crc, size, size))

    def close(self) -> None:
        first = self.at
        for raw, at, size, crc in self.members:
            wide = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            small = (FULL32, FULL32, FULL32) if wide else (size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, small[0], small[1], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        size, n = self.at - first, len(self.members)
        if self.zip64 or first >= FULL32 or size >= FULL32 or n >= FULL16:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, size, first = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, first, 0))


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Where the data of each stored member begins in a ZIP file, and its length."""
    tail = min(size, 22 + 65535)
    data = file.read_at(tail, size - tail)
    at = len(data) - 22
    while at >= 0 and not (data[at : at + 4] == struct.pack("<I", END) and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data)):
        at -= 1
    if at < 0:
        raise ValueError("not a ZIP file: it has no end record")
    n, length, first = struct.unpack_from("<HII", data, at + 10)
    place = size - tail + at - 20
    if place >= 0 and (n == FULL16 or length == FULL32 or first == FULL32):
        mark, _, where, _ = struct.unpack("<IIQI", file.read_at(20, place))
        if mark == LOCATOR64:
            head = struct.unpack("<IQHHIIQQQQ", file.read_at(56, where))
            if head[0] != END64:
                raise ValueError("the ZIP64 end record isn't where its locator says")
            n, length, first = head[7], head[8], head[9]
    directory, at, out = file.read_at(length, first), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # those fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, x + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                local = next(wide) if local == FULL32 else local
            x += 4 + long
        at += 46 + n_name + n_extra + n_note
        if method == 0 and not flags & 1:
            mark, n_name, n_extra = struct.unpack("<I22xHH", file.read_at(30, local))
            if mark != LOCAL:
                raise ValueError(f"no local header for {name}")
            out[name] = (local + 30 + n_name + n_extra, packed)
    return out


# --- WARC --------------------------------------------------------------------------------------------


def record(page_id: int | None, payload: bytes, digest: str, url: str | None, refers_to: int | None) -> bytes:
    """A response, or a revisit, which has no payload but its digest and length."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", "".join((url or "").splitlines())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = MIN_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """page_id, url, html and refers_to: null for a response. Digests that over HOT_ROWS rows and a thousandth of all have are at most
    a thousand; they are broadcast, and their rows are spread over the join with the others."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("_digest", F.sha2("html", 256))
    first = pages.select(F.col(page_id).alias("page_id"), F.sha2(F.coalesce(F.col(html), F.lit("")), 256).alias("_digest"), F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("_bytes"))
    copies = first.where(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null")
    limit = max(hot_rows, pages.count() // 1000)
    hot = copies.where(F.col("_n") > limit).select("_digest", F.col("_last").alias("_hot"))
    rows = rows.join(F.broadcast(hot), "_digest", "left")
    place = F.concat_ws("-", "_digest", F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_digest", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(place))
    joined = rows.join(copies.where(F.col("_n") <= limit).select("_digest", "_last"), "_digest", "left").withColumn("_last", F.coalesce("_hot", "_last"))
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"))


def write(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> None:
    """Writes archives into a shared folder and their list, a Parquet table, beside them. An archive appears
    under its name only when it is whole; a task that runs again writes others, and only those that are in
    the list count."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        fs.create_dir(top, recursive=True)
        sink = zipped = None
        name, lines, at, n = "", [], 0, 0

        def done() -> pa.RecordBatch:
            zipped.end()
            zipped.begin(INDEX)
            zipped.write("".join(lines).encode())
            zipped.end()
            zipped.close()
            sink.close()
            fs.move(f"{top}/_{name}", f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [zipped.at], "records": [n]}, schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if zipped is None:
                    name, lines, at, n = f"{uuid.uuid4().hex}.zip", [], 0, 0
                    sink = fs.open_output_stream(f"{top}/_{name}")
                    zipped = ZipWriter(sink, zip64)
                    zipped.begin(WARC)
                payload = html.encode()
                data = gzip.compress(record(page_id, payload, base32_sha1(payload), url, refers), 6, mtime=0)
                zipped.write(data)
                lines.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}) + "\n")
                at, n = at + len(data), n + 1
                if at >= archive_bytes:
                    yield done()
                    zipped = None
        if zipped is not None:
            yield done()

    listed = records.select("page_id", "url", "html", "refers_to").mapInArrow(put, "archive string, bytes long, records long")
    listed.repartition(records.sparkSession.sparkContext.defaultParallelism).write.parquet(f"{folder}/list")  # a row for each archive: few files


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    payload (empty for a revisit)."""
    found = spark.read.schema("archive string, bytes long, records long").parquet(f"{folder}/list")

    def number(text: str) -> int | None:
        return int(text.removeprefix("<urn:page:").removesuffix(">") or 0) if text != "<urn:page:>" else None

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_folder(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/{name}") as file:
                    where = members(file, size)
                    (first, _), (start, length) = where[WARC], where[INDEX]
                    rows: list[tuple] = []
                    held = 0
                    for line in file.read_at(length, start).decode().splitlines():
                        entry = json.loads(line)
                        fields, payload = parse(gzip.decompress(file.read_at(entry["length"], first + entry["offset"])))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"damaged record {entry} in {name}")
                        refers = fields.get("WARC-Refers-To")
                        rows.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(refers) if refers else None, payload))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "archive").mapInArrow(get, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8(spark, sf_dir: str) -> DataFrame:
    folder = shared.folder(spark, "warc")
    write(plan(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY sha256(body)) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
