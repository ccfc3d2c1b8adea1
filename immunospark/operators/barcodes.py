"""Barcodes: whitelist correction, translation, counts and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import smallest

#: Barcodes that the background frequencies are taken from; None: all.
SAMPLE = 2_000_000


def whitelist_frequencies(barcodes: DataFrame, whitelist: DataFrame, sample: int | None = SAMPLE, barcode: str = "barcode", order: str | None = None) -> DataFrame:
    """barcode, freq of the whitelist: how often each was seen, and one more. A sample is the first by `order`, or else the smallest by hash, so that it is the same in each run."""
    if sample is not None:
        barcodes = smallest(barcodes, sample, F.col(order) if order else None)
    seen = barcodes.select(F.col(barcode).alias("barcode"))
    counts = seen.groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
    return whitelist.select("barcode").distinct().join(counts, "barcode", "left").select("barcode", (F.coalesce("n", F.lit(0)) + 1).alias("freq"))


def correct(barcodes: DataFrame, frequencies: DataFrame, barcode: str = "barcode", qual: str | None = "qual") -> DataFrame:
    """Adds corrected: the barcode if whitelisted, else its best neighbour at one substitution, else null.

    The most frequent neighbour wins, then the one whose changed base has the lowest quality, then the
    first by position and base. Distinct (barcode, quality) pairs are looked up once.
    """
    keys = [barcode] + ([qual] if qual else [])
    distinct = barcodes.select(*keys).distinct()
    exact = distinct.join(frequencies.select(F.col("barcode").alias(barcode)), barcode, "left_semi").withColumn("corrected", F.col(barcode))
    other = distinct.join(frequencies.select(F.col("barcode").alias(barcode)), barcode, "left_anti")
    b = F.col(barcode)
    spots = other.select(*keys, F.explode(F.sequence(F.lit(1), F.length(b))).alias("_at"))
    spots = spots.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("base")) for i, x in enumerate("ACGT")])).alias("_x"))
    spots = spots.where(F.substr(b, F.col("_at"), F.lit(1)) != F.col("_x.base"))
    near = spots.withColumn("_to", F.concat(F.substr(b, F.lit(1), F.col("_at") - 1), F.col("_x.base"), F.substr(b, F.col("_at") + 1, F.length(b))))
    near = near.join(frequencies.select(F.col("barcode").alias("_to"), "freq"), "_to")
    q = F.ascii(F.substr(F.col(qual), F.col("_at"), F.lit(1))) if qual else F.lit(0)
    best = near.groupBy(*keys).agg(F.min_by("_to", F.struct(-F.col("freq"), q, "_at", "_x.rank")).alias("corrected"))
    return barcodes.join(exact.unionByName(best), keys, "left")


def translate(barcode: Column, table: dict[str, str], length: int) -> Column:
    """Each piece of `length` letters looked up, joined by -; null if a piece is unknown. For tables small enough to be a literal."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(barcode) / length).cast("int") - 1), lambda i: F.try_element_at(lookup, F.substr(barcode, i * length + 1, F.lit(length))))
    return F.when((F.length(barcode) >= length) & ~F.exists(pieces, lambda x: x.isNull()), F.array_join(pieces, "-"))


def translated(barcodes: DataFrame, table: DataFrame, length: int, barcode: str = "barcode") -> DataFrame:
    """As translate(), with a table (from, to) of any size: distinct barcodes are cut into pieces and joined."""
    distinct = barcodes.select(barcode).distinct()
    pieces = distinct.where(F.length(barcode) >= length).select(
        barcode, F.explode(F.sequence(F.lit(0), F.floor(F.length(barcode) / length).cast("int") - 1)).alias("_i")
    ).withColumn("from", F.substr(F.col(barcode), F.col("_i") * length + 1, F.lit(length)))
    found = pieces.join(table.select("from", "to"), "from", "left").groupBy(barcode).agg(
        F.array_sort(F.collect_list(F.struct("_i", "to"))).alias("_parts"), F.count("to").alias("_known")
    )
    found = found.select(barcode, F.when(F.size("_parts") == F.col("_known"), F.array_join(F.transform("_parts", lambda x: x["to"]), "-")).alias("translated"))
    return barcodes.join(found, barcode, "left")


def read_counts(reads: DataFrame, barcode: str = "barcode") -> DataFrame:
    return reads.where(F.col(barcode).isNotNull()).groupBy(barcode).agg(F.count(F.lit(1)).alias("n"))


def drop_thin_barcodes(reads: DataFrame, least: int, barcode: str = "barcode") -> DataFrame:
    """Reads of barcodes with at least that many; the counts are joined, so a barcode may have any number of reads."""
    enough = read_counts(reads, barcode).where(F.col("n") >= least).select(barcode)
    return reads.join(enough, barcode, "left_semi")


def umi_count(reads: DataFrame, by: list[str], umi: str = "umi", fragment: str = "fragment") -> DataFrame:
    """Distinct UMIs per group; without a UMI each fragment counts, mates of a pair once."""
    counts = reads.groupBy(*by).agg(F.countDistinct(umi).alias("umis"), F.countDistinct(F.when(F.col(umi).isNull(), F.col(fragment))).alias("bare"))
    return counts.select(*by, (F.col("umis") + F.col("bare")).alias("n"))


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
