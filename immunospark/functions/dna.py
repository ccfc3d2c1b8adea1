"""Nucleotide expressions: Catalyst, but for codons, which are looked up batch by batch in Arrow; no Python per row."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The standard genetic code in the usual TCAG order; `_` is a stop.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product(_BASES, repeat=3), _AMINO)}


def reverse_complement(seq: Column) -> Column:
    """N stays N."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_complement_strict(seq: Column) -> Column:
    """As read extraction wants it: whatever isn't A, C, G or T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


#: Letters as digits 0 to 3 in the order of the code's table, 4 for all others; amino acids by three such digits.
_DIGITS = np.full(256, 4, dtype=np.int16)
for _i, _b in enumerate(_BASES):
    _DIGITS[[ord(_b), ord(_b.lower())]] = _i
_BY_DIGITS = np.full((5, 5, 5), ord("?"), dtype=np.uint8)
_BY_DIGITS[:4, :4, :4] = np.frombuffer(_AMINO.encode(), dtype=np.uint8).reshape(4, 4, 4)
_BY_DIGITS = _BY_DIGITS.reshape(-1)


def _translated(seqs: pa.Array) -> pa.Array:
    """The amino acids of a batch of sequences: all codons at once."""
    # a letter outside ASCII counts as one letter that no codon has
    text = pc.replace_substring_regex(seqs.cast(pa.large_string()), r"[^\x00-\x7F]", "?")
    if not len(text):
        return pa.array([], pa.string())
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    letters = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    digits = np.concatenate([_DIGITS[letters], np.full(2, 4, dtype=np.int16)])
    size = np.diff(ends)
    n = (size + 2) // 3
    to = np.concatenate([[0], np.cumsum(n)])
    at = 3 * np.arange(to[-1]) + np.repeat(ends[:-1] - 3 * to[:-1], n)
    amino = _BY_DIGITS[25 * digits[at] + 5 * digits[at + 1] + digits[at + 2]]
    amino[to[1:][size % 3 > 0] - 1] = ord("?")  # a last codon that is cut short
    out = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(amino)])
    return (pc.if_else(pc.is_valid(text), out, None) if text.null_count else out).cast(pa.string())


_translate = F.arrow_udf(_translated, StringType())


def translate_codons(seq: Column) -> Column:
    """Amino acids of whole codons from the start; an unknown codon is `?`, and so is a last one that is cut short."""
    return _translate(seq.cast("string"))


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def low_complexity(seq: Column) -> Column:
    """One base makes up half, or N a tenth, or two bases occur at most twice each."""
    n = F.length(seq)
    counts = [count_base(seq, b) for b in "ACGT"]
    rare = sum((c <= 2).cast("int") for c in counts)
    half = F.floor(n / 2)
    dominant = counts[0] >= half
    for c in counts[1:]:
        dominant = dominant | (c >= half)
    return dominant | (count_base(seq, "N") >= F.floor(n / 10)) | (rare >= 2)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases, as an array."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def valid_kmer(kmer: Column) -> Column:
    return ~kmer.rlike("[^ACGT]")


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two sequences of equal length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))


def motif_frames(seq: Column) -> tuple[Column, Column]:
    """Whether one of the three frames holds Y-Y-C, and whether one holds [FW]-G-x-G."""
    aa = [translate_codons(F.substr(seq, F.lit(k), F.length(seq))) for k in (1, 2, 3)]
    v = aa[0].rlike("YYC") | aa[1].rlike("YYC") | aa[2].rlike("YYC")
    j = aa[0].rlike("[FW]G.G") | aa[1].rlike("[FW]G.G") | aa[2].rlike("[FW]G.G")
    return v, j


def n_runs(seq: Column, gap: int = 7) -> Column:
    """The stretches of a contig between runs of `gap` or more N: an array of sequences."""
    return F.split(seq, "N{%d,}" % gap)


def kmer_code(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a number, two bits a base in the order ACGT; codes of one length sort as their k-mers."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_text(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def no_match_gap(k: int) -> float:
    """Bases without a k-mer match beyond which, at 80% identity, an overlap is implausible at 1%."""
    import math

    return k * math.log(0.01) / math.log(1 - 0.8**k) + 1
