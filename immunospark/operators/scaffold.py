"""Contigs joined by the mates of fragments that lie on two of them.

Reads have been turned to the genes' strand, so a read whose own strand that was (strand 1) has its mate
further on, and one that was turned (strand -1) has it before. A fragment with one of either kind on two
contigs speaks for an edge between them. An edge is a link if it is the best one that leaves its first
contig and the best one that enters its second; links make chains, as no contig has two on a side. A
chain becomes one contig: ends that agree are laid over one another, others are held apart by a gap of N.

Edges and links are equi-joins and aggregations. A task holds one chain's contigs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

#: Letters between contigs whose ends don't meet.
GAP = 7
#: Equal letters by which ends are laid over one another.
LEAST = 10
#: Equal letters by which ends show, without regard to genes, that contigs follow one another.
MEET = 17
#: An edge with this share of the heaviest one's fragments is as good, and the longer span decides.
NEAR = 0.9


def edges(lying: DataFrame) -> DataFrame:
    """src, dst, n, src_span, dst_span: fragments that lead from one contig to another, and how much of either their reads span.

    lying: fragment, strand, cid, offset, length and rank (the place of the read's gene type within a chain, or
    null). Fragments against the order of gene types don't count; each fragment counts once an edge, by the pair
    of its first reads there, so that no task holds the edges of its fragments.
    """
    def side(strand: int, c: str, loosest: Column) -> DataFrame:
        rows = lying.where(F.col("strand") == strand).select("fragment", F.col("cid").alias(c), F.col("offset").alias(f"{c}_from"), (F.col("offset") + F.col("length")).alias(f"{c}_to"), F.col("rank").alias(f"{c}_rank"))
        return rows.repartition("fragment").withColumn(f"{c}_first", F.row_number().over(Window.partitionBy("fragment", c).orderBy(loosest)) == 1)

    # of a fragment's reads on a contig the first one has the rank that the order of gene types holds against least, so it's in a pair wherever any of them is
    both = side(1, "src", F.asc_nulls_first("src_rank")).join(side(-1, "dst", F.desc_nulls_first("dst_rank")), "fragment").where("src <> dst").where(~F.coalesce(F.col("src_rank") > F.col("dst_rank"), F.lit(False)))
    spans = [F.min(f"{c}_from").alias(f"{c}_from") for c in ("src", "dst")] + [F.max(f"{c}_to").alias(f"{c}_to") for c in ("src", "dst")]
    sums = both.groupBy("src", "dst").agg(F.count(F.when(F.col("src_first") & F.col("dst_first"), 1)).alias("n"), *spans)
    return sums.select("src", "dst", "n", *[(F.col(f"{c}_to") - F.col(f"{c}_from")).alias(f"{c}_span") for c in ("src", "dst")])


def fitting(found: DataFrame, lying: DataFrame, contigs: DataFrame, least: int = MEET) -> DataFrame:
    """The edges between contigs (cid, consensus) that can follow one another.

    Either the end of one is the start of the other, by `least` letters or more, or all reads of the first
    are of gene types before those of the second's: contigs of one gene type are other rearrangements.
    """
    ranks = lying.groupBy("cid").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    ends = contigs.select("cid", F.col("consensus").alias("seq")).join(ranks, "cid", "left")
    both = found.join(ends.select(F.col("cid").alias("src"), F.col("seq").alias("_a"), F.col("high").alias("_high")), "src").join(ends.select(F.col("cid").alias("dst"), F.col("seq").alias("_b"), F.col("low").alias("_low")), "dst")
    most = F.least(F.length("_a"), F.length("_b")) - 1
    meets = F.when(most >= least, F.exists(F.sequence(F.lit(least), most), lambda k: F.substr(F.col("_a"), F.length("_a") - k + 1, k) == F.substr(F.col("_b"), F.lit(1), k))).otherwise(False)
    return both.where(meets | F.coalesce(F.col("_high") < F.col("_low"), F.lit(False))).select(*found.columns)


def links(found: DataFrame, least: int = 1) -> DataFrame:
    """src, dst, n of the edges that are the best of both their contigs: heaviest, but among near-heaviest the one that spans most, then the smallest neighbour."""
    rows = found.where(F.col("n") >= least)
    for c, other in (("src", "dst"), ("dst", "src")):
        by = Window.partitionBy(c)
        near = F.col("n") >= F.max("n").over(by) * F.lit(NEAR)
        # the neighbour that the contig prefers
        key = F.struct(-F.col(f"{c}_span"), -F.col("n"), F.col(other))
        rows = rows.withColumn(f"_{c}", F.when(near, key)).withColumn(f"_{c}", F.col(f"_{c}") == F.min(f"_{c}").over(by))
    return rows.where("_src AND _dst").select("src", "dst", "n")


def overlap(a: str, b: str, least: int = LEAST) -> int:
    """The most letters by which a's end equals b's start, where neither lies in the other; 0 below `least`."""
    for n in range(min(len(a), len(b)) - 1, least - 1, -1):
        if a.endswith(b[:n]):
            return n
    return 0


def ordered(names: list[str], steps: dict[str, tuple[str, int]]) -> list[str]:
    """The contigs of a chain in order; a ring is opened at its lightest link (the smallest source among equals). steps: src -> (dst, n)."""
    entered = {dst for dst, _ in steps.values()}
    first = [x for x in names if x not in entered]
    if not first:
        weakest = min(steps, key=lambda s: (steps[s][1], s))
        first, steps = [steps[weakest][0]], {s: t for s, t in steps.items() if s != weakest}
    out = [first[0]]
    while out[-1] in steps:
        out.append(steps[out[-1]][0])
    return out


def joined(parts: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
    """Sequence and position weights (a row of four counts a letter) of contigs laid one after the other."""
    seq, weights = parts[0]
    for text, more in parts[1:]:
        n = overlap(seq, text)
        if n:
            weights = np.concatenate([weights[: len(weights) - n], weights[len(weights) - n :] + more[:n], more[n:]])
            seq += text[n:]
        else:
            weights = np.concatenate([weights, np.zeros((GAP, 4), dtype=weights.dtype), more])
            seq += "N" * GAP + text
    return seq, weights


def scaffolds(contigs: DataFrame, found: DataFrame) -> DataFrame:
    """contigs (cid, consensus, n_reads, pos_weight and others) with each chain of links (src, dst, n) as one contig, named as its first one.

    The other columns are the first contig's, n_reads is the sum. Contigs without a link stay as they are;
    links to contigs that aren't there are left out.
    """
    here = contigs.select("cid")
    found = found.join(here.withColumnRenamed("cid", "src"), "src", "left_semi").join(here.withColumnRenamed("cid", "dst"), "dst", "left_semi")
    chains = components(found, "src", "dst").select(F.col("node").alias("cid"), F.col("root").alias("_chain"))
    rows = contigs.join(chains, "cid").join(found.select(F.col("src").alias("cid"), F.col("dst").alias("_next"), F.col("n").alias("_n")), "cid", "left")

    columns = contigs.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {c: i for i, c in enumerate(pdf["cid"])}
        steps = {c: (d, int(n)) for c, d, n in zip(pdf["cid"], pdf["_next"], pdf["_n"]) if isinstance(d, str)}
        chain = [at[c] for c in ordered(sorted(at), steps)]
        parts = [(pdf["consensus"].iloc[i], np.array([[w["a"], w["c"], w["g"], w["t"]] for w in pdf["pos_weight"].iloc[i]], dtype=np.int64).reshape(-1, 4)) for i in chain]
        seq, weights = joined(parts)
        out = pdf.iloc[[chain[0]]].copy()
        out["consensus"], out["n_reads"] = seq, int(pdf["n_reads"].sum())
        out["pos_weight"] = [[dict(zip("acgt", map(int, row))) for row in weights]]
        return out[columns]

    made = rows.groupBy("_chain").applyInPandas(run, contigs.schema)
    return contigs.join(chains, "cid", "left_anti").select(*columns).unionByName(made)
