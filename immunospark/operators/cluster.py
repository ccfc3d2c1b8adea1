"""CDR3 clusters: sequences of equal V gene, J gene and length, joined by Hamming similarity."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna, genes
from .graph import components, cut

KEY = ["v", "j", "n"]
#: Ways to leave letters out, and letters, up to which sequences meet by what is left of them.
WAYS = 128
LETTERS = 4
#: Rows of all these ways up to which sequences meet at once, without a round for those that differ in one letter.
AT_ONCE = 4_000_000


def keyed(rows: DataFrame, seq: str = "cdr3") -> DataFrame:
    """rows with v and j as main genes and n, the length; rows without either gene stay out."""
    main = lambda g: genes.called(genes.without_allele(genes.first_gene(F.col(g))))
    return rows.withColumns({"v": main("v"), "j": main("j"), "n": F.length(seq)}).where("v IS NOT NULL AND j IS NOT NULL")


def mismatches(n: Column, similarity: float) -> Column:
    return (n - F.ceil(n * F.lit(similarity))).cast("int")


def similar_pairs(distinct: DataFrame, similarity: float, seq: str = "cdr3") -> DataFrame:
    """Pairs a < b of sequences of a key within the allowed mismatches.

    With m mismatches allowed, one of m + 1 even pieces is equal in both, so pairs come from an
    equi-join on pieces instead of from all pairs of a key. distinct: v, j, n and the sequence.
    """
    m = mismatches(F.col("n"), similarity)
    size = F.ceil(F.col("n") / (m + 1)).cast("int")
    pieces = distinct.select(*KEY, seq, F.explode(F.sequence(F.lit(0), m)).alias("_k"), m.alias("_m"), size.alias("_size"))
    pieces = pieces.select(*KEY, seq, "_k", "_m", F.substr(F.col(seq), F.col("_k") * F.col("_size") + 1, F.col("_size")).alias("_p"))
    left, right = pieces.withColumnRenamed(seq, "a"), pieces.drop("_m").withColumnRenamed(seq, "b")
    pairs = left.join(right, [*KEY, "_k", "_p"]).where("a < b").select(*KEY, "a", "b", "_m").distinct()
    return pairs.where(dna.hamming(F.col("a"), F.col("b")) <= F.col("_m")).select(*KEY, "a", "b")


def shortened(rows: DataFrame, less: int, seq: str = "cdr3") -> DataFrame:
    """A row for each way (_way) to leave `less` letters out of the sequence, with the rest (_rest): sequences of a key differ in no more letters than that where they share one."""
    out = rows.withColumns({"_at": F.lit(1), "_way": F.lit(0), "_rest": F.col(seq)})
    for _ in range(less):
        out = out.withColumn("_at", F.explode(F.sequence("_at", F.col("n") - (less - 1))))
        out = out.withColumns({"_way": F.col("_way") * (F.col("n") + 1) + F.col("_at"), "_rest": F.concat(F.substr("_rest", F.lit(1), F.col("_at") - 1), F.substr("_rest", F.col("_at") + 1, F.col("n")))})
    return out.drop("_at")


def met(ways: DataFrame) -> DataFrame:
    """a, b: labels of sequences that share a rest, each b with the smallest one there."""
    return ways.withColumn("a", F.min("label").over(Window.partitionBy(*KEY, "_way", "_rest"))).where("a < label").select("a", F.col("label").alias("b")).distinct()


def apart(nodes: DataFrame, less: int, seq: str = "cdr3") -> DataFrame:
    """met() of nodes that have labels by nearer sequences: only rests that some sequence outside its key's largest label has can join two labels."""
    sizes = nodes.groupBy(*KEY, "label").count()
    largest = sizes.groupBy(*KEY).agg(F.max_by("label", F.struct("count", "label")).alias("_largest"))
    outside = cut(nodes.join(largest, KEY).where("label <> _largest").drop("_largest"))
    asked = cut(shortened(outside, less, seq).select(*KEY, "_way", "_rest").distinct())
    return met(shortened(nodes.join(outside.select(*KEY).distinct(), KEY, "left_semi"), less, seq).join(asked, [*KEY, "_way", "_rest"], "left_semi"))


def single_linkage(rows: DataFrame, similarity: float = 0.8, seq: str = "cdr3") -> DataFrame:
    """rows with cluster: the smallest sequence, with its key, that similar sequences lead to.

    Links are needed, not all pairs. Where there are few ways to leave out the letters that may differ, sequences
    meet by what is left, so rows grow with the sequences however many of a key are similar. Of large tables those
    that differ in one letter meet first, then the clusters of these. Longer sequences meet by pieces (similar_pairs).
    """
    node = lambda c: F.concat_ws("|", "v", "j", F.col("n").cast("string"), F.col(c))
    df = keyed(rows, seq).withColumn("_node", node(seq))
    nodes = cut(df.select(*KEY, seq, "_node").distinct().withColumn("label", F.col("_node")))
    lengths = nodes.where("n IS NOT NULL").groupBy("n").agg(mismatches(F.col("n"), similarity).alias("m"), F.count(F.lit(1)).alias("rows")).where("m > 0").collect()
    few = [r for r in lengths if r.m <= LETTERS and math.comb(r.n, r.m) <= WAYS]
    of = lambda found: nodes.where(F.col("n").isin([r.n for r in found]))
    merged = lambda links: nodes.join(components(links).withColumnsRenamed({"node": "label", "root": "_root"}), "label", "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")
    at_once = sum(r.rows * math.comb(r.n, r.m) for r in few) <= AT_ONCE
    if few and not at_once:
        nodes = cut(merged(met(shortened(of(few), 1, seq))))
    links = []
    for less in sorted({r.m for r in few}):
        some = of([r for r in few if r.m == less])
        if at_once:
            links.append(met(shortened(some, less, seq)))
        elif less > 1:
            links.append(apart(some, less, seq))
    if many := [r for r in lengths if r not in few]:
        links.append(similar_pairs(of(many).select(*KEY, seq), similarity, seq).select(node("a").alias("a"), node("b").alias("b")))
    if links:
        nodes = merged(reduce(DataFrame.unionByName, links))
    return df.join(nodes.select("_node", F.col("label").alias("cluster")), "_node", "left").drop("_node")


def representatives(rows: DataFrame, group: str = "cid", seq: str = "cdr3", amount: str = "count") -> DataFrame:
    """group, seq: each group's sequence with the largest summed amount, the smallest sequence among equals."""
    sums = rows.groupBy(group, seq).agg(F.sum(amount).alias("_n"))
    return sums.groupBy(group).agg(F.min_by(seq, F.struct(-F.col("_n"), seq)).alias(seq), F.max("_n").alias(amount))


def centers(rows: DataFrame, similarity: float = 0.8, seq: str = "cdr3", amount: str = "count") -> DataFrame:
    """Distinct sequences with cluster: by falling amount each joins the center most like it, if that is similar enough, or becomes one."""
    df = keyed(rows, seq).groupBy(*KEY, seq).agg(F.sum(amount).alias(amount))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([amount, seq], ascending=[False, True], ignore_index=True)
        # all sequences of a key have one length
        letters = np.array([list(map(ord, s)) for s in pdf[seq]], dtype=np.int32).reshape(len(pdf), -1)
        made, n = np.empty(16, dtype=np.int64), 0
        centers, out = np.empty((16, letters.shape[1]), dtype=np.int32), []
        for i, row in enumerate(letters):
            same = (centers[:n] == row).sum(1)
            if n and (not row.size or same.max() / row.size >= similarity - 1e-12):
                out.append(made[same.argmax()])
                continue
            if n == len(made):
                made, centers = np.resize(made, 2 * n), np.resize(centers, (2 * n, letters.shape[1]))
            made[n], centers[n], n = i, row, n + 1
            out.append(i)
        return pdf.assign(cluster=pdf[seq].to_numpy()[out])

    kinds = dict(df.dtypes)
    return df.groupBy(*KEY).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in df.columns) + ", cluster string")


def allowed(n: int, similarity: float) -> int:
    return n - math.ceil(n * similarity)
