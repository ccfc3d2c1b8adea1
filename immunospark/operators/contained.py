"""Contigs inside longer ones, and edges between contigs that mates support."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .reference import gene_kmers


def contained(contigs: DataFrame, k: int = 15, group: list[str] | None = None) -> DataFrame:
    """cid, host: contigs (cid, seq) that lie in a longer one with at most one mismatch.

    With one mismatch at most, one half of the contig is exact, so the first k-mer of either half leads
    to its place: an equi-join on k-mers, then the comparison. Contigs shorter than 2k have no seeds, and
    letters other than A, C, G and T part k-mers, so a contig with one in both first k-mers isn't looked up.
    """
    group = group or []
    seeds = contigs.where(F.length("seq") >= 2 * k).select(*group, F.col("cid"), "seq", F.explode(F.array(F.lit(0), F.floor(F.length("seq") / 2).cast("int"))).alias("_at"))
    window = F.substr(F.col("seq"), F.col("_at") + 1, F.lit(k))
    seeds = seeds.where(dna.valid_kmer(window)).withColumn("kmer", dna.kmer_code(window))
    places = gene_kmers(contigs.select(F.struct(*group, "cid").alias("gene_idx"), "seq"), k)
    hosts = places.select("kmer", F.col("gene.cid").alias("host"), *[F.col(f"gene.{g}").alias(g) for g in group], F.col("offset").alias("_o"))
    found = seeds.join(hosts, ["kmer", *group]).where("cid <> host").select(*group, "cid", "seq", "host", (F.col("_o") - F.col("_at")).alias("_start")).distinct()
    both = found.join(contigs.select(*group, F.col("cid").alias("host"), F.col("seq").alias("_host")), [*group, "host"])
    inside = both.where((F.length("_host") > F.length("seq")) & (F.col("_start") >= 0) & (F.col("_start") + F.length("seq") <= F.length("_host")))
    part = F.substr(F.col("_host"), F.col("_start") + 1, F.length("seq"))
    return inside.where(dna.hamming(part, F.col("seq")) <= 1).select(*group, "cid", "host").distinct()


def without_contained(contigs: DataFrame, k: int = 15, group: list[str] | None = None) -> DataFrame:
    keys = [*(group or []), "cid"]
    return contigs.join(contained(contigs, k, group).select(*keys).distinct(), keys, "left_anti")


def mate_edges(placed: DataFrame) -> DataFrame:
    """src, dst, n, first, last: how many fragments (fragment, contig, offset) join two contigs, and the span of their places on the first."""
    a = placed.select("fragment", F.col("contig").alias("src"), "offset")
    b = placed.select("fragment", F.col("contig").alias("dst"))
    pairs = a.join(b, "fragment").where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))
