"""Expectation-maximisation of variant abundances from reads that fit several variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, TOLERANCE = 1000, 1e-6


def solve(reads: np.ndarray, variants: np.ndarray, weight: np.ndarray, n_reads: int, n_variants: int) -> np.ndarray:
    """Counts per variant. reads, variants: one entry per compatible pair; weight: how many equal reads each read stands for."""
    alone = np.bincount(reads, minlength=n_reads) == 1
    start = np.bincount(variants[alone[reads]], weights=weight[reads[alone[reads]]], minlength=n_variants)
    if not start.sum():
        out = np.zeros(n_variants)
        out[0] = weight.sum()
        return out
    share, counts = start / start.sum(), start
    for _ in range(ROUNDS):
        total = np.bincount(reads, weights=share[variants], minlength=n_reads)
        each = np.divide(share[variants] * weight[reads], total[reads], out=np.zeros(len(reads)), where=total[reads] > 0)
        counts = np.bincount(variants, weights=each, minlength=n_variants)
        new = counts / counts.sum()
        moved, share = np.abs(new - share).max(), new
        if moved < TOLERANCE:
            break
    return counts


def abundances(compat: DataFrame, group: str = "contig", read: str = "read", variant: str = "variant", weight: str | None = None) -> DataFrame:
    """group, variant, n from (group, read, variant) rows; weight: a column that tells how many equal reads a read stands for.

    Reads that fit the same variants are merged first, in the engine, so a group's task holds its
    distinct sets of variants and not its reads. Variants are taken in their natural order: the first
    one gets everything if no read fits a single variant.
    """
    times = F.col(weight) if weight else F.lit(1)
    sets = compat.groupBy(group, read).agg(F.array_sort(F.collect_set(variant)).alias("vs"), F.max(times).alias("w"))
    merged = sets.groupBy(group, "vs").agg(F.sum("w").alias("w"))
    kinds = dict(compat.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vs", key=lambda s: s.map(tuple), ignore_index=True)
        flat = pdf["vs"].explode()
        names = sorted(set(flat))
        at = {v: i for i, v in enumerate(names)}
        got = solve(flat.index.to_numpy(), flat.map(at).to_numpy(dtype=np.int64), pdf["w"].to_numpy(dtype=float), len(pdf), len(names))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(names), variant: names, "n": got})

    return merged.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {variant} {kinds[variant]}, n double")
