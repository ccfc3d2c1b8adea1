"""Mates that read through, or into, one another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.align import mate_overlap

OUT = "id STRING, seq STRING, qual STRING, merged BOOLEAN, mate INT"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def resolve(seq1: str, qual1: str | None, seq2: str, qual2: str | None) -> list[tuple[str, str | None, bool]]:
    """The reads that a pair stands for.

    Mates that read through one another keep what they share, with the better base at each place. Mates
    that overlap by their ends are merged, if alike enough, and count as two reads; else the one with
    clearly better bases in the overlap stays. Other pairs stay as they are.
    """
    back, back_qual = reverse_complement(seq2), qual2[::-1] if qual2 is not None else None
    both = len(seq1) + len(seq2)
    through = mate_overlap(back, seq1, min(both // 10, 31), tandem=False)
    if through:
        at, size, _ = through
        if qual1 is None or back_qual is None:
            return [(seq1[:size], qual1 and qual1[:size], False)]
        better = [back_qual[at + k] > qual1[k] or seq1[k] == "N" for k in range(size)]
        pick = lambda x, y: "".join(y[at + k] if b else x[k] for k, b in enumerate(better))
        return [(pick(seq1, back), pick(qual1, back_qual), False)]
    overlap = mate_overlap(seq1, back, min(both // 20, 31))
    if not overlap:
        return [(seq1, qual1, False), (seq2, qual2, False)]
    at, size, matches = overlap
    if matches >= 0.95 * size:
        end = at + len(back)
        seq, qual = [], []
        for k in range(end):
            mine = k < len(seq1)
            theirs = k >= at
            own = mine and (not theirs or back[k - at] == "N" or qual1 is None or back_qual is None or ord(qual1[k]) >= ord(back_qual[k - at]) - 14)
            seq.append(seq1[k] if own else back[k - at])
            if qual1 is not None and back_qual is not None:
                qual.append(qual1[k] if own else back_qual[k - at])
        return [("".join(seq), "".join(qual) or None, True)]
    if qual1 is not None and qual2 is not None:
        mean = lambda q: sum(ord(c) - 32 for c in q) / size
        if mean(qual1[at:]) + 10 < mean(back_qual[len(back) - size :]):
            return [(seq2, qual2, False)]
    return [(seq1, qual1, False)]


def resolve_pairs(pairs: DataFrame) -> DataFrame:
    """id, seq, qual, merged, mate (1 or 2) from pairs (id, seq, qual, seq_2, qual_2): a map without a shuffle; a merged read comes twice, as id and id.1, and low-complexity reads go. Mates that stay apart share their id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, s1, q1, s2, q2 in pdf.itertuples(index=False):
                reads = [(s1, q1, False)] if s2 is None else resolve(s1, q1, s2, q2)
                for mate, (seq, qual, merged) in enumerate(reads, 1):
                    out.append((rid, seq, qual, merged, mate))
                    if merged:
                        out.append((f"{rid}.1", seq, qual, merged, 2))
            yield pd.DataFrame(out, columns=["id", "seq", "qual", "merged", "mate"])

    got = pairs.select("id", "seq", "qual", "seq_2", "qual_2").mapInPandas(run, OUT)
    return got.where(~dna.low_complexity(F.col("seq")))


def fragment_id(rid: Column, merged: Column) -> Column:
    """The fragment of a read: a merged pair's second copy is the same fragment."""
    return F.when(merged, F.regexp_replace(rid, r"\.1$", "")).otherwise(rid)
