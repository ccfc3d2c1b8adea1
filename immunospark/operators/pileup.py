"""Position weights of contigs: pile-up, consensus, coverage and the tie-break between equal genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def pile_up(reads: DataFrame, group: list[str], seq: str = "seq", offset: str | None = None) -> DataFrame:
    """group, pos (from 0), a, c, g, t: how many reads have each base there. Only A, C, G and T count."""
    start = F.col(offset) if offset else F.lit(0)
    each = reads.select(*group, start.alias("_o"), F.posexplode(F.split(F.col(seq), "")).alias("_i", "_b")).where(F.col("_b").isin(*BASES))
    return each.groupBy(*group, (F.col("_o") + F.col("_i")).cast("int").alias("pos")).agg(*[F.sum((F.col("_b") == b).cast("bigint")).alias(b.lower()) for b in BASES])


def consensus_base() -> Column:
    """The most frequent base of a pile-up row; the first of A, C, G, T among equals."""
    most = F.greatest("a", "c", "g", "t")
    return F.when(F.col("a") == most, "A").when(F.col("c") == most, "C").when(F.col("g") == most, "G").otherwise("T")


def updated_base(now: Column) -> Column:
    """As consensus_base, but the present base stays among equals."""
    most = F.greatest("a", "c", "g", "t")
    own = F.when(now == "A", F.col("a")).when(now == "C", F.col("c")).when(now == "G", F.col("g")).when(now == "T", F.col("t"))
    return F.when(F.coalesce(own == most, F.lit(False)), now).otherwise(consensus_base())


def contigs(piles: DataFrame, group: list[str]) -> DataFrame:
    """group, consensus (N where nothing is piled up), weight (all counts) and pos_weight."""
    row = F.struct("pos", F.struct(*[F.col(b.lower()) for b in BASES]).alias("w"), consensus_base().alias("base"))
    got = piles.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("_r"), F.max("pos").alias("_last"))
    at = F.map_from_entries(F.transform("_r", lambda x: F.struct(x["pos"], F.struct(x["base"], x["w"]))))
    none = F.struct(F.lit("N").alias("base"), F.struct(*[F.lit(0).cast("bigint").alias(b.lower()) for b in BASES]).alias("w"))
    every = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at(at, i), none))
    got = got.select(*group, every.alias("_e"))
    return got.select(
        *group, F.array_join(F.transform("_e", lambda x: x["base"]), "").alias("consensus"),
        F.aggregate("_e", F.lit(0).cast("bigint"), lambda s, x: s + x["w"]["a"] + x["w"]["c"] + x["w"]["g"] + x["w"]["t"]).alias("weight"),
        F.transform("_e", lambda x: x["w"]).alias("pos_weight"),
    )


def weight_sum(pos_weight: Column) -> Column:
    return F.aggregate(pos_weight, F.lit(0).cast("bigint"), lambda s, x: s + x["a"] + x["c"] + x["g"] + x["t"])


def shallow(pos_weight: Column, least: int) -> Column:
    """A base between the outermost ones of depth `least` is not that deep, or none is."""
    deep = F.transform(pos_weight, lambda x: x["a"] + x["c"] + x["g"] + x["t"] >= least)
    first, last = F.array_position(deep, True), F.size(deep) - F.array_position(F.reverse(deep), True) + 1
    return (first == 0) | F.exists(F.slice(deep, F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0)).cast("int")), lambda d: ~d)


def base_compatible(counts: Column, base: Column) -> Column:
    """A base fits a position if it makes up over a third of it, if the position is empty, or if it is N."""
    own = F.when(base == "A", counts.a).when(base == "C", counts.c).when(base == "G", counts.g).when(base == "T", counts.t)
    return (base == "N") | (counts.a + counts.c + counts.g + counts.t == 0) | (own * 3 > counts.a + counts.c + counts.g + counts.t)


def gene_abundance(hits: DataFrame) -> DataFrame:
    """gene, abundance: the mean weight of the contigs whose best hit it is. hits: contig, gene, weight, length."""
    return hits.groupBy("gene").agg(F.sum(F.col("weight") / F.col("length")).alias("abundance"))


def break_ties(best: DataFrame, equals: DataFrame, abundance: DataFrame) -> DataFrame:
    """For each contig and gene type the most abundant of the best hit and those that equal it; the best hit among equals, then the first. best: contig, type, gene; equals: contig, type, gene, ordinal."""
    every = best.select("contig", "type", "gene", F.lit(-1).alias("ordinal")).unionByName(equals.select("contig", "type", "gene", "ordinal"))
    rated = every.join(abundance, "gene", "left")
    return rated.groupBy("contig", "type").agg(F.max_by("gene", F.struct(F.coalesce("abundance", F.lit(0.0)), -F.col("ordinal"))).alias("gene"))
