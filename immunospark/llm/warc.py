"""WARC archives of individually compressed records under a shared Zstandard dictionary.

Layout of an archive (.warc.zst): a skippable frame of magic 0x184D2A5D that holds the dictionary,
itself compressed, then one Zstandard frame per WARC/1.1 record. The dictionary is trained on a
bounded sample of the distinct payloads, SAMPLE_RECORDS drawn by their digests' hash and cut to SAMPLE_BYTES each
where they are read; a table too small to train on gets archives without one. Any record can be read alone, given the dictionary.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the largest page_id is
the response and the others are revisits. Digests are grouped with map-side combining and only the
revisits, if any, meet the pages again; that join broadcasts them if Spark's size limit allows it
and else shuffles by (page_id, digest), which no group of equal payloads can make uneven.

A task streams its partition into archives of at most ARCHIVE_BYTES in the shared folder. File names
hold the task attempt, and only the manifest of successful attempts is read, so lost executors and
repeated tasks leave no doubt about what belongs to the result. The reader checks every response's
digest against its payload.

Defined results: a null html is an empty payload; a null url gets the URI `urn:page:<id>`; rows that
repeat a page_id are records of their own, and all with the largest page_id of a group are
responses; a null page_id is always a response; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stored, table

MIN_REVISIT = 1000
SAMPLE_RECORDS = 600
SAMPLE_BYTES = 16 << 10
DICT_BYTES = 110 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 6
#: The skippable frame of a WARC dictionary, and Zstandard's own frame. Fixed values.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path STRING, records BIGINT, bytes BIGINT"
OUT = "page_id BIGINT, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; digest is the payload's SHA-1 in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) if url else f"urn:page:{page_id}"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    block = http if refers_to is not None else http + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> bytes | None:
    """A dictionary, or None if there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return None


class Writer:
    """An archive at a time in a folder; close() returns the manifest rows."""

    def __init__(self, folder: str, stem: str, dictionary: bytes | None, archive_bytes: int = ARCHIVE_BYTES):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.stem, self.limit = folder, stem, archive_bytes
        self.dictionary, self.done, self.out = dictionary, [], None
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data is not None:
            data.precompute_compress(level=LEVEL)
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{self.stem}-{len(self.done):03d}.warc.zst"
            self.out, self.n, self.size = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, 0
            if self.dictionary:
                held = zstandard.ZstdCompressor(level=19).compress(self.dictionary)
                self.size += self.out.write(struct.pack("<II", DICT_MAGIC, len(held)) + held)
            info = b"software: immunospark\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.name)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self.size += self.out.write(self.coder.compress(head.encode() + info + b"\r\n\r\n"))
        self.size += self.out.write(self.coder.compress(data))
        self.n += 1
        if self.size >= self.limit:
            self.finish()

    def finish(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.n, self.size))
            self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        self.finish()
        return self.done


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard or skippable frame at `at`, or 0 if data ends before its end."""
    have = len(data) - at
    if have < 18 and have < 8:
        return 0
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return 8 + size if have >= 8 + size else 0
    if magic != FRAME_MAGIC:
        raise ValueError("not a Zstandard frame")
    flags = data[at + 4]
    single, content, ids = flags >> 5 & 1, flags >> 6, flags & 3
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[ids] + ((1 if single else 0), 2, 4, 8)[content]
    while True:
        if pos + 3 > len(data):
            return 0
        block = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    return pos - at if pos <= len(data) else 0


def records(path: str, chunk: int = 4 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive, read in chunks."""
    fs, name = pafs.FileSystem.from_uri(path)
    coder, data = zstandard.ZstdDecompressor(), b""
    with fs.open_input_stream(name) as f:
        while True:
            more = f.read(chunk)
            view, at = memoryview(data + more), 0
            while at < len(view) and (n := frame_size(view, at)):
                frame = view[at : at + n]
                at += n
                if struct.unpack_from("<I", frame)[0] == DICT_MAGIC:
                    held = bytes(frame[8:])
                    if held[:4] == struct.pack("<I", FRAME_MAGIC):
                        held = zstandard.ZstdDecompressor().decompress(held)
                    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                elif struct.unpack_from("<I", frame)[0] == FRAME_MAGIC:
                    head, _, rest = coder.decompress(frame).partition(b"\r\n\r\n")
                    lines = head.decode().split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise ValueError(f"not a WARC record in {path}")
                    fields = dict(x.split(": ", 1) for x in lines[1:])
                    yield fields, rest[: int(fields["Content-Length"])]
            data = bytes(view[at:])
            if not more:
                if data:
                    raise ValueError(f"{path} ends within a frame")
                return


def parsed(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of OUT; None for records that aren't pages."""
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return (page and int(page), size, digest, kind, refers and int(refers))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, n (bytes) and digest of every payload, stored."""
    return stored(pages.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest")), "page-digests")


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages to be archived as revisits. rows: see digests()."""
    rows = rows.where((F.col("n") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups.drop("n"), "digest").where(F.col("page_id") != F.col("refers_to")).distinct()


def sampled(pages: DataFrame, rows: DataFrame) -> list[bytes]:
    """Records of SAMPLE_RECORDS distinct payloads at most, each cut to SAMPLE_BYTES; nothing longer leaves a task. rows: see digests()."""
    payloads = rows.where("page_id IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("page_id"))
    payloads = payloads.withColumn("h", F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    n = payloads.count()
    if not n:
        return []
    # the share leaves each task a few rows to send, of a digest and an id
    near = payloads.where(F.col("h") < int(min(1.0, 2 * SAMPLE_RECORDS / n + 50 / n) * (1 << 40)))
    picked = {r["page_id"]: r["digest"] for r in near.orderBy("h", "digest").limit(SAMPLE_RECORDS).collect()}
    cut = pages.where(F.col("page_id").isin(list(picked))).select("page_id", "url", F.sha1("payload").alias("digest"), F.expr(f"substring(payload, 1, {SAMPLE_BYTES})").alias("payload"))
    wanted = pages.sparkSession.createDataFrame(list(picked.items()), "page_id BIGINT, digest STRING")
    got = cut.join(F.broadcast(wanted), ["page_id", "digest"]).groupBy("page_id", "digest").agg(F.min("url").alias("url"), F.min("payload").alias("payload")).collect()
    return [record(r["page_id"], r["url"], bytes(r["payload"]), r["digest"], None) for r in sorted(got, key=lambda r: r["digest"])]


def written(pages: DataFrame, folder: str) -> DataFrame:
    """Archive page_id, url, html under folder; the manifest of the archives."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    known = digests(pages)
    again = stored(revisits(known), "revisits")
    dictionary = trained(sampled(pages, known))
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)
    rows = pages.withColumn("digest", F.sha1("payload")).join(again, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = Writer(folder, f"pages-{task.partitionId():06d}-{task.taskAttemptId()}", shared.value)
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out.add(record(*(x.as_py() for x in row)))
        got = out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return stored(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row per page record of the archives that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for fields, block in records(path):
                    if (row := parsed(fields, block)) is not None:
                        rows.append(row)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, OUT)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(written(table(spark, sf_dir, "pages"), new_path(spark, "warc")))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM g
"""
