"""Filters of reads and contigs by their gene hits: Catalyst predicates over hit structs.

A hit is a struct gene, ref_len, read_start, read_end, ref_start, ref_end, similarity; null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrong_order(hits: list[Column], slack: int = 10) -> Column:
    """A gene later in V, D, J, C order begins before an earlier one ends, by more than the slack."""
    bad = F.lit(False)
    for k, later in enumerate(hits):
        for earlier in hits[:k]:
            bad = bad | F.coalesce(earlier.read_end - slack > later.read_start, F.lit(False))
    return bad


def constant_only(v: Column, j: Column, c: Column, length: Column, strand: Column, end: int = 200) -> Column:
    """A read of the constant gene alone that lies too deep in it: beyond `end`, or beyond 100 and forward or partial if `end` is 200 or less."""
    alone = v.isNull() & j.isNull() & c.isNotNull()
    partial = (c.read_start > 0) | (c.read_end < length - 1)
    deep = (c.ref_start >= end) | (F.lit(end <= 200) & (c.ref_start >= 100) & ((strand == 1) | partial))
    return F.coalesce(alone & deep, F.lit(False))


def too_short(length: Column, first_length: int, least: int = 31) -> Column:
    """Shorter than `least`, or than a third of a library of reads over 200 bases."""
    return (length < least) | (F.lit(first_length > 200) & (length < first_length / 3))


def full_length(v: Column, j: Column, c: Column, seq: Column) -> Column:
    """V, J and C in order and from near their starts, without N."""
    ok = (v.read_end <= j.read_start + 3) & (j.read_end <= c.read_start + 6) & (v.ref_start <= 10) & (c.ref_start <= 10) & ~seq.contains("N")
    return F.coalesce(ok, F.lit(False))


def complete_vdj(v: Column, j: Column, cdr3: Column, seq: Column) -> Column:
    """V from its first base into the CDR3, J from within it to its end, without N."""
    ok = (v.read_end <= j.read_start + 3) & (v.ref_start == 0) & (v.read_end >= cdr3.start) & (j.read_start <= cdr3.end) & (j.ref_end >= j.ref_len - 1) & ~seq.contains("N")
    return F.coalesce(ok, F.lit(False))


def overlap_low_complexity(seq: Column, start: Column, end: Column) -> Column:
    """One or two bases make up nearly all of an overlap: fewer than three bases occur more than twice."""
    part = F.substr(seq, start + 1, end - start + 1)
    often = sum(((F.length(part) - F.length(F.replace(part, F.lit(b), F.lit("")))) > 2).cast("int") for b in "ACGT")
    return often < 3


def trim_to_genes(seq: Column, v: Column, c: Column, j: Column, heavy: Column) -> tuple[Column, Column]:
    """The read from where V begins to where C, or outside IGH also J, ends; and how many bases went from its start."""
    start = F.coalesce(F.when(v.ref_start == 0, v.read_start), F.lit(0))
    stop = F.coalesce(c.read_end, F.when(~heavy, j.read_end), F.length(seq) - 1)
    return F.substr(seq, start + 1, F.greatest(stop - start + 1, F.lit(0))), start


def either_mate(good_1: Column, good_2: Column, barcode: Column | None = None, seq_1: Column | None = None, seq_2: Column | None = None, barcode_low: Column | None = None) -> Column:
    """A pair of a FASTQ file stays if either mate is a good candidate, unless its barcode is one of its reads and of low complexity."""
    good = F.coalesce(good_1, F.lit(False)) | F.coalesce(good_2, F.lit(False))
    if barcode is None:
        return good
    same = F.coalesce(barcode == seq_1, F.lit(False)) | F.coalesce(barcode == seq_2, F.lit(False))
    return good & ~(same & F.coalesce(barcode_low, F.lit(False)))


def both_complex(low_1: Column, low_2: Column, hit_1: Column, hit_2: Column) -> Column:
    """A pair of a BAM file stays if neither mate is of low complexity and either hits the reference."""
    return ~low_1 & ~low_2 & (F.coalesce(hit_1, F.lit(False)) | F.coalesce(hit_2, F.lit(False)))


def plausible(v: Column, j: Column, c: Column, cdr3: Column) -> Column:
    """A contig whose genes lie in order and reach near their ends; without one of them, one whose CDR3 has the full score."""
    size = F.length(cdr3.seq)
    order = (v.read_end <= j.read_start) & (j.read_end <= c.read_start + 6)
    reach = (v.ref_end >= v.ref_len - size) & (j.ref_start <= size) & (j.ref_end >= j.ref_len - 20) & (c.ref_start <= 20)
    return F.coalesce(cdr3.isNotNull() & F.when(v.isNull() | j.isNull() | c.isNull(), cdr3.score >= 100).otherwise(order & reach), F.lit(False))
