"""A BAM file gives the same records whatever the ranges it is cut into."""

import gzip
import io
import random
import struct
import zlib

import pytest

from immunospark.sources import bam


def member(data):
    """A gzip member that tells its own length."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = body.compress(data) + body.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def bam_file(records, block, refs=3, rng=None):
    out = [b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", refs) + b"".join(struct.pack("<i", 5) + b"chr%d\0" % k + struct.pack("<i", 10**6) for k in range(refs))]
    for name, ref, pos, seq, tag in records:
        n = len(seq)
        codes = [bam._BASES.index(b) for b in seq] + [0] * (n % 2)
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, 1, 4, n, -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", n << 4)
        body += bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(codes), 2)) + bytes([30] * n) + b"ZZZ" + tag.encode() + b"\0"
        out.append(struct.pack("<i", len(body)) + body)
    data = b"".join(out)
    cuts = [0]
    while cuts[-1] < len(data):
        cuts.append(min(len(data), cuts[-1] + (rng.randrange(1, 2 * block) if rng else block)))
    return b"".join(member(data[a:b]) for a, b in zip(cuts, cuts[1:])) + member(b"")


def reads(rng, n):
    return [(f"read{k}", rng.randrange(-1, 3), rng.randrange(-1, 10**5), "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 50, 100, 151, 3000 if k % 50 == 0 else 30]))), "tag" * rng.randrange(0, 20)) for k in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_ranges_part_the_records(seed):
    rng = random.Random(seed)
    rows = reads(rng, 300)
    data = bam_file(rows, rng.choice([40, 700, 5000, 60_000]), rng=rng)
    whole = list(bam.records(io.BytesIO(data), len(data), 0, len(data)))
    assert [(r[1], r[3] and int(r[3][3:]), r[4], r[9]) for r in whole] == [(name, None if ref < 0 else ref, pos, seq) for name, ref, pos, seq, _ in rows]
    assert all(a[0] < b[0] for a, b in zip(whole, whole[1:]))
    for split in (97, 1000, 7777, len(data) // 2 + 1):
        parts = [r for at in range(0, len(data), split) for r in bam.records(io.BytesIO(data), len(data), at, min(len(data), at + split))]
        assert parts == whole


def test_few_records_and_plain_gzip():
    rng = random.Random(3)
    for n in (0, 1, 3):
        data = bam_file(reads(rng, n), 64)
        parts = [r for at in range(0, len(data), 50) for r in bam.records(io.BytesIO(data), len(data), at, min(len(data), at + 50))]
        assert [r[1] for r in parts] == [f"read{k}" for k in range(n)]
    data = gzip.compress(gzip.decompress(bam_file(reads(rng, 5), 500)))
    assert bam.member_size(data[:64]) is None and len(list(bam.records(io.BytesIO(data), len(data), 0, -1))) == 5
    with pytest.raises(ValueError):
        list(bam.records(io.BytesIO(member(b"SAM\1" + b"\0" * 20)), 60, 0, 60))


def test_spark_reads_ranges(spark, tmp_path):
    rows = reads(random.Random(5), 400)
    for k in range(2):
        (tmp_path / f"{k}.bam").write_bytes(bam_file(rows[200 * k : 200 * k + 200], 900))
    paths = [str(tmp_path / f"{k}.bam") for k in range(2)]
    cut = bam.read_bam(spark, *paths, split_bytes=2000)
    assert cut.rdd.getNumPartitions() > 10
    got = [r.name for r in cut.orderBy("file_ord", "ordinal").collect()]
    assert got == [r[0] for r in rows] == [r.name for r in bam.read_bam(spark, *paths).orderBy("file_ord", "ordinal").collect()]
