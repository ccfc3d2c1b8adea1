"""FASTA and FASTQ as a Spark data source, `fastx`.

Columns: file_ord, ordinal, id, comment, seq, qual (null for FASTA). A path may be a list joined by
commas; files keep that order. A .gz file is one partition, read as a stream. A plain FASTQ file of
more than `splitBytes` (if given) is read in ranges that start at the next record; its ordinal is then
the record's byte offset, which keeps the order but doesn't count records. Ids lose a final /1 or /2.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_ord INT, ordinal BIGINT, id STRING, comment STRING, seq STRING, qual STRING"
_NAMES = ["file_ord", "ordinal", "id", "comment", "seq", "qual"]
_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
MAX_FILES = 100


def split_header(line: str) -> tuple[str, str | None]:
    name, _, comment = line.partition(" ")
    if "\t" in name:
        name, _, comment = line.partition("\t")
    return (name[:-2] if name.endswith(("/1", "/2")) else name), comment or None


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str | None, str, str | None]]:
    """Records of a stream of lines; sequences and qualities may span lines."""
    head = next((x for x in lines if x.strip()), None)
    while head is not None:
        mark, (name, comment) = head[:1], split_header(head[1:].rstrip().decode())
        if mark not in (b">", b"@"):
            raise ValueError(f"a record begins with {head[:20]!r}")
        seq: list[bytes] = []
        nxt = None
        for line in lines:
            if line[:1] in (b">", b"@", b"+") if mark == b"@" else line[:1] == b">":
                nxt = line
                break
            seq.append(line.rstrip())
        text = b"".join(seq)
        if nxt is None or nxt[:1] != b"+":
            yield name, comment, text.decode(), None
            head = nxt
            continue
        qual, got = [], 0
        for line in lines:
            qual.append(line.rstrip(b"\r\n"))
            got += len(qual[-1])
            if got >= len(text):
                break
        yield name, comment, text.decode(), b"".join(qual).decode()
        head = next((x for x in lines if x.strip()), None)


class _Part(InputPartition):
    def __init__(self, path: str, file_ord: int, start: int = 0, end: int | None = None):
        self.path, self.file_ord, self.start, self.end = path, file_ord, start, end


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, name


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or 0)
        if len(self.paths) > MAX_FILES:
            raise ValueError(f"more than {MAX_FILES} files")

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            fs, name = _open(path)
            size = fs.get_file_info(name).size or 0
            if self.split and size > self.split and not path.endswith(".gz"):
                out += [_Part(path, k, at, min(at + self.split, size)) for at in range(0, size, self.split)]
            else:
                out.append(_Part(path, k))
        return out

    def read(self, partition):
        fs, name = _open(partition.path)
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        if partition.end is None:
            raw = fs.open_input_stream(name, compression=None)
            lines = gzip.open(raw) if partition.path.endswith(".gz") else io.BufferedReader(raw)
            found = ((n, r) for n, r in enumerate(records(iter(lines))))
        else:
            found = _range(fs.open_input_file(name), partition.start, partition.end)
        for n, (rid, comment, seq, qual) in found:
            rows.append((partition.file_ord, n, rid, comment, seq, qual))
            if len(rows) == 20_000:
                yield batch()
                rows = []
        if rows:
            yield batch()


def _range(raw, start: int, end: int):
    """Four-line FASTQ records that begin in [start, end), with their byte offsets."""
    f = io.BufferedReader(raw)
    f.seek(start)
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    window: list[tuple[int, bytes]] = []
    # a record begins where a line starts with @ and the one after next with +
    while True:
        while len(window) < 4:
            line = f.readline()
            if not line:
                break
            window.append((at, line))
            at += len(line)
        if not window or window[0][0] >= end:
            return
        if len(window) < 4:
            return
        if window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and window[1][1][:1] not in b"@+":
            text = [x.rstrip(b"\r\n").decode() for _, x in window]
            name, comment = split_header(text[0][1:])
            yield window[0][0], (name, comment, text[1], text[3])
            window = []
        else:
            window.pop(0)


class FastxSource(DataSource):
    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(dict(self.options))


def read_fastx(spark: SparkSession, *paths: str, split_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("splitBytes", str(split_bytes)).load(",".join(paths))
