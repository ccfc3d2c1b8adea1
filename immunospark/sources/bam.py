"""Alignments: BAM as a Spark data source, `bam`, and SAM text.

Columns: file_ord, ordinal, name, flag, chrom, pos (0-based), mapq, cigar, mate_chrom, mate_pos, seq,
qual, tags (a map of tag to text). A BAM file is a series of small gzip members that tell their own
length, so it is cut into ranges of bytes, each a partition: its task looks for the first member that begins in
the range, then in its text for the first place from which records follow one another, and reads
all records that begin in members of the range, into those behind it where one goes on. The ordinal is a record's virtual
offset (a member's place times 2^16, and the place in its text), which rises through the file whatever the ranges. A gzip
file without lengths is one partition. SAM text is split by lines wherever Spark likes.
"""

from __future__ import annotations

import bisect
import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_ord INT, ordinal BIGINT, name STRING, flag INT, chrom STRING, pos INT, mapq INT, cigar STRING, mate_chrom STRING, mate_pos INT, seq STRING, qual STRING, tags MAP<STRING,STRING>"
_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Fixed values of the format: letters of cigar operations and of four-bit bases; sizes of tag types.
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def tags_of(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[tag], at = chr(data[at]), at + 1
        elif kind in _NUMBERS:
            (value,) = struct.unpack_from(_NUMBERS[kind], data, at)
            out[tag], at = str(value), at + struct.calcsize(_NUMBERS[kind])
        elif kind in "ZH":
            end = data.index(0, at)
            out[tag], at = data[at:end].decode(), end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            size = struct.calcsize(_NUMBERS[of])
            out[tag] = ",".join(str(struct.unpack_from(_NUMBERS[of], data, at + 5 + k * size)[0]) for k in range(n))
            at += 5 + n * size
        else:
            raise ValueError(f"unknown tag type {kind!r}")
    return out


#: Bytes of a file that make a partition; the least fixed part of a record; records that must follow one another where a range begins.
SPLIT = 64 << 20
FIXED, CHAIN = 36, 8
#: Fixed values of the format: how a member begins, and the most bytes that one has.
_MEMBER, _MOST = b"\x1f\x8b\x08\x04", 1 << 16
_GZIP_ONLY = -1


def member_size(head: bytes, at: int = 0) -> int | None:
    """The bytes of the member that begins at a place of head; None if none does, or if it doesn't tell."""
    if head[at : at + 4] != _MEMBER or len(head) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", head, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Members:
    """The text of a file's members from a place on, as one stream that knows where its bytes come from."""

    def __init__(self, f, at: int, size: int):
        self.f, self.next, self.size = f, at, size
        self.data, self.begin = b"", 0  # begin: place in the stream of data's first byte
        self.starts: list[int] = []  # places in the stream where members begin, and the members' places in the file
        self.places: list[int] = []

    def _more(self) -> bool:
        if self.next >= self.size:
            return False
        self.f.seek(self.next)
        raw = self.f.read(_MOST)
        n = member_size(raw)
        if n is None or n > len(raw):
            raise ValueError(f"no whole gzip member at {self.next}")
        self.starts.append(self.begin + len(self.data))
        self.places.append(self.next)
        self.data += zlib.decompress(raw[:n], 31)
        self.next += n
        return True

    def peek(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place in the stream that isn't before what was dropped."""
        while self.begin + len(self.data) < at + n and self._more():
            pass
        return self.data[at - self.begin : at - self.begin + n]

    def drop(self, at: int) -> None:
        """What lies before a place isn't asked for any more."""
        if at - self.begin > 1 << 20:
            self.data, self.begin = self.data[at - self.begin :], at
            k = max(0, bisect.bisect_right(self.starts, at) - 1)
            del self.starts[:k], self.places[:k]

    def origin(self, at: int) -> tuple[int, int]:
        """The place in the file of the member that a byte of the stream is in, and the byte's place in its text."""
        k = bisect.bisect_right(self.starts, at) - 1
        return self.places[k], at - self.starts[k]


def header(stream: Members) -> tuple[list[str], int]:
    """The names of the reference sequences, and where the records begin."""
    if stream.peek(0, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda at: struct.unpack("<i", stream.peek(at, 4))[0]
    at = 8 + number(4)
    names, count, at = [], number(at), at + 4
    for _ in range(count):
        size = number(at)
        names.append(stream.peek(at + 4, size)[:-1].decode())
        at += 8 + size
    return names, at


def plausible(data: bytes, refs: int) -> int | None:
    """The bytes of the record that data begins with, if it can be one."""
    if len(data) < FIXED:
        return None
    size, ref, pos, name_len, _, _, n_cigar, _, n, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data)
    if not (-1 <= ref < refs and -1 <= mate_ref < refs and pos >= -1 and mate_pos >= -1 and name_len >= 1 and n >= 0):
        return None
    if size < 32 + name_len + 4 * n_cigar + (n + 1) // 2 + n:
        return None
    name = data[FIXED : FIXED + name_len]
    if len(name) == name_len and (name[-1] != 0 or not all(33 <= b <= 126 for b in name[:-1])):
        return None
    return size + 4


def first_record(stream: Members, refs: int, end: int) -> int | None:
    """Where in the stream the first record begins, if one does in a member that begins before `end`: from there records follow one another."""
    at = 0
    while stream.peek(at, 1) and stream.origin(at)[0] < end:
        place, good = at, 0
        while good < CHAIN and (head := stream.peek(place, FIXED + 255)):
            size = plausible(head, refs)
            if size is None:
                break
            place, good = place + size, good + 1
        else:
            # as many as wanted, or the file ended behind whole ones
            if good == CHAIN or good and place == stream.begin + len(stream.data):
                return at
        at += 1
    return None


def row(data: bytes, names: list[str]) -> tuple:
    """The columns from name on of a record without its size."""
    chrom = lambda k: names[k] if k >= 0 else None
    ref, pos, name_len, mapq, _, n_cigar, flag, n, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name, at = data[at : at + name_len - 1].decode(), at + name_len
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed, at = data[at : at + (n + 1) // 2], at + (n + 1) // 2
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n]
    raw, at = data[at : at + n], at + n
    qual = None if not n or raw[0] == 255 else bytes(min(93, q) + 33 for q in raw).decode()
    return name, flag, chrom(ref), pos, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or None, chrom(mate_ref), mate_pos, seq, qual, tags_of(data[at:])


class _Whole:
    """A gzip file that can't be cut, with the calls of Members."""

    def __init__(self, f):
        self.data = gzip.open(f).read()
        self.begin = 0

    def peek(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def drop(self, at: int) -> None:
        pass

    def origin(self, at: int) -> tuple[int, int]:
        return 0, at


def records(f, size: int, start: int, end: int) -> Iterator[tuple]:
    """ordinal and the columns behind it of the records that begin in the members of a range of a file; end < 0: of the whole of a file that can't be cut."""
    stream = _Whole(f) if end == _GZIP_ONLY else Members(f, 0, size)
    names, at = header(stream)
    if start:
        # a range begins with the first member in it: one whose length leads to another or to the file's end
        f.seek(start)
        ahead = f.read(2 * _MOST + 32)
        here = next((k for k in range(min(len(ahead), end - start)) if (n := member_size(ahead, k)) and (start + k + n == size or ahead[k + n : k + n + 4] == _MEMBER)), None)
        if here is None:
            return
        stream = Members(f, start + here, size)
        at = first_record(stream, len(names), end)
    while at is not None and len(head := stream.peek(at, 4)) == 4:
        place, inside = stream.origin(at)
        if end != _GZIP_ONLY and place >= end:
            return
        (n,) = struct.unpack("<i", head)
        yield (place << 16) + inside, *row(stream.peek(at + 4, n), names)
        at += 4 + n
        stream.drop(at)


class _Range(InputPartition):
    def __init__(self, path: str, file_ord: int, size: int, start: int, end: int):
        self.path, self.file_ord, self.size, self.start, self.end = path, file_ord, size, start, end


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    @staticmethod
    def _at(path: str):
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            fs, name = self._at(path)
            size = fs.get_file_info(name).size
            with fs.open_input_file(name) as f:
                cut = member_size(f.read(1 << 12)) is not None
            out += [_Range(path, k, size, at, min(size, at + self.split)) for at in range(0, size, self.split)] if cut else [_Range(path, k, size, 0, _GZIP_ONLY)]
        return out

    def read(self, partition):
        fs, name = self._at(partition.path)
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if t == _TYPES[-1] else c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

        with fs.open_input_file(name) as f:
            for r in records(f, partition.size, partition.start, partition.end):
                rows.append((partition.file_ord, *r))
                if len(rows) == 20_000:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, *paths: str, split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).load(",".join(paths))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text with the same columns but file_ord and ordinal."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    star = lambda c: F.nullif(c, F.lit("*"))
    pairs = F.transform(F.slice(f, 12, 1000), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 20)))
    return spark.read.text(path).where(~F.col("value").startswith("@")).select(
        at(0).alias("name"), at(1).cast("int").alias("flag"), star(at(2)).alias("chrom"), (at(3).cast("int") - 1).alias("pos"), at(4).cast("int").alias("mapq"), star(at(5)).alias("cigar"),
        F.when(at(6) == "=", star(at(2))).otherwise(star(at(6))).alias("mate_chrom"), (at(7).cast("int") - 1).alias("mate_pos"), at(9).alias("seq"), star(at(10)).alias("qual"), F.map_from_entries(pairs).alias("tags"),
    )
