"""Repertoire diversity by locus and isotype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cdr3 as fcdr3
from ..functions import genes

#: The rows of the table, in order.
ROWS = ["IGH", *genes.ISOTYPES, "IGK", "IGL", "TRA", "TRB", "TRG", "TRD"]


def measures(species: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """abundance, richness, cpk, entropy (natural) and clonality of groups of species with counts n."""
    x = F.col(n).cast("double")
    sums = species.groupBy(*by).agg(F.sum(n).alias("abundance"), F.count(F.lit(1)).alias("richness"), F.sum(x * F.log(x)).alias("_s"))
    entropy = F.log(F.col("abundance")) - F.col("_s") / F.col("abundance")
    return sums.select(
        *by, "abundance", "richness", (F.col("richness") / F.col("abundance") * 1000).alias("cpk"), entropy.alias("entropy"),
        F.when(F.col("richness") > 1, 1 - entropy / F.log(F.col("richness"))).alias("clonality"),
    )


def diversity(clones: DataFrame, aa: str = "cdr3aa", n: str = "count") -> DataFrame:
    """chain and its measures: IGH over all isotypes, each isotype, every other locus; rows without clonotypes have no measures but abundance and richness 0."""
    good = clones.where(fcdr3.productive(F.col(aa)))
    locus = genes.locus_by_first_called(F.col("v"), F.col("j"), F.col("c"))
    names = F.array_compact(F.array(locus, F.when(locus == "IGH", genes.isotype(F.col("c")))))
    rows = good.select(F.explode(names).alias("chain"), F.col(aa).alias("aa"), F.col(n).alias("n"))
    got = measures(rows.groupBy("chain", "aa").agg(F.sum("n").alias("n")), ["chain"])
    frame = clones.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ROWS)], "row INT, chain STRING")
    out = frame.join(got, "chain", "left")
    return out.select("row", "chain", F.coalesce("abundance", F.lit(0)).alias("abundance"), F.coalesce("richness", F.lit(0)).alias("richness"), "cpk", "entropy", "clonality")


def from_barcodes(report: DataFrame) -> DataFrame:
    """Clonotype rows (v, j, c, cdr3aa, count 1) of a per-cell report, for diversity()."""
    parts = [report.select(F.col(f"chain{s}").alias("x")).where(F.col("x").isNotNull()) for s in (1, 2)]
    return parts[0].unionByName(parts[1]).select("x.v", "x.j", "x.c", "x.cdr3aa", F.lit(1).alias("count"))
