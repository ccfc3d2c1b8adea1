"""Codons are looked up once each: the work for a sequence grows with its length."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from immunospark.functions import dna


def plain(s):
    if s is None:
        return None
    return "".join(dna.CODONS.get(s[i : i + 3].upper(), "?") for i in range(0, len(s), 3))


SEQS = ["", "A", "AC", "TGTGCN", "tgtgcatag", "TGTGCAT", None, "TAA", "ACé", "é" * 4 + "TGT", "AC\U0001f600TGTG", "N" * 7, "TGT ACC", None, ""]


def test_codons_of_odd_sequences(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, s string").repartition(3)
    got = {r.i: r.aa for r in rows.select("i", dna.translate_codons(F.col("s")).alias("aa")).collect()}
    assert [got[i] for i in range(len(SEQS))] == [plain(s) for s in SEQS]


def test_codons_of_slices_and_empty_batches():
    for kind in (pa.string(), pa.large_string()):
        every = pa.array(SEQS, kind)
        for a in range(len(SEQS) + 1):
            assert dna._translated(every.slice(a, 4)).to_pylist() == [plain(s) for s in SEQS[a : a + 4]]
    assert dna._translated(pa.nulls(2, pa.string())).to_pylist() == [None, None]


def test_work_grows_with_length(spark):
    """The codons of one long sequence: a look at the whole sequence for each of them would take minutes."""
    rows = spark.range(1).select(F.repeat(F.lit("TGTGCA"), 50_000).alias("s"))
    began = time.time()
    assert rows.select(dna.translate_codons(F.col("s"))).first()[0] == "CA" * 50_000
    assert time.time() - began < 60
