"""Alignments that overlap gene intervals, and alignment records themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import smallest

BIN = 16_384


def _bins(start: Column, end: Column, size: int) -> Column:
    return F.sequence(F.floor(start / size), F.floor(F.greatest(end, start) / size))


def overlapping(rows: DataFrame, genes: DataFrame, key: list[str], size: int = BIN) -> DataFrame:
    """Rows (chrom, start, end) of which an interval of genes (chrom, start, end) has more than a touching end: start <= gene end and end > gene start.

    Both sides are cut into bins of the chromosome, so that the range condition rides on an equi-join.
    """
    cut = rows.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), size)))
    bins = genes.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(_bins(F.col("start"), F.col("end"), size)).alias("_b"))
    hit = (cut["chrom"] == bins["_c"]) & (cut["_bin"] == bins["_b"]) & (cut["start"] <= bins["_e"]) & (cut["end"] > bins["_s"])
    return cut.join(bins, hit, "left_semi").drop("_bin").dropDuplicates(key)


def segments(pos: Column, cigar: Column) -> Column:
    """The exons of an alignment as an array of (start, end), 0-based and inclusive: N splits them; clips, insertions and padding take no room."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))
    start = F.struct(pos.cast("int").alias("at"), pos.cast("int").alias("from"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda a, x: F.when(
        x["op"].isin("M", "D", "=", "X"), F.struct((a["at"] + x["n"]).alias("at"), a["from"].alias("from"), a["out"].alias("out"))
    ).when(
        x["op"] == "N",
        F.struct((a["at"] + x["n"]).alias("at"), (a["at"] + x["n"]).alias("from"), F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), (a["at"] - 1).alias("end")))).alias("out")),
    ).otherwise(a)
    return F.aggregate(ops, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), (a["at"] - 1).alias("end")))))


def flags(flag: Column) -> dict[str, Column]:
    bit = lambda n: flag.bitwiseAND(F.lit(n)) != 0
    return {"paired": bit(1), "unmapped": bit(4), "reverse": bit(0x10), "mate_reverse": bit(0x20), "first": bit(0x40), "secondary": bit(0x100), "supplementary": bit(0x800), "primary": ~bit(0x900)}


def original_sequence(flag: Column, seq: Column, qual: Column) -> tuple[Column, Column]:
    """The read as it was sequenced: reverse-strand alignments are turned back."""
    from ..functions.dna import reverse_complement

    back = flag.bitwiseAND(F.lit(0x10)) != 0
    return F.when(back, reverse_complement(seq)).otherwise(seq), F.when(back, F.reverse(qual)).otherwise(qual)


def alternative_contig(name: Column) -> Column:
    return name.rlike("[_.]")


def library_profile(rows: DataFrame, sample: int | None = 100_000) -> DataFrame:
    """One row: max_len, paired, frag_len and frag_std, from primary reads (flag, seq, pos, mate_pos, same_chrom); fragments from the smallest 70% of mate distances."""
    primary = rows.where(flags(F.col("flag"))["primary"])
    if sample is not None:
        primary = smallest(primary, sample)
    facts = primary.agg(F.max(F.length("seq")).alias("max_len"), (F.avg((F.col("flag").bitwiseAND(F.lit(1)) != 0).cast("int")) > 0.5).alias("paired"))
    ends = primary.where(F.col("same_chrom") & (F.col("mate_pos") > F.col("pos"))).select((F.col("mate_pos") - F.col("pos") + F.length("seq")).alias("d"))
    cut = ends.agg(F.percentile_approx("d", 0.7, 10_000).alias("q"))
    near = ends.join(F.broadcast(cut), F.col("d") <= F.col("q")).agg(F.avg("d").alias("frag_len"), F.stddev_pop("d").alias("frag_std"))
    return facts.withColumn("_k", F.lit(1)).join(F.broadcast(near.withColumn("_k", F.lit(1))), "_k").drop("_k")


def pairs_of_candidates(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Both mates of the named reads, from their primary records: name, seq1, qual1, seq2, qual2."""
    kept = rows.where(flags(F.col("flag"))["primary"]).join(names.select("name").distinct(), "name", "left_semi")
    seq, qual = original_sequence(F.col("flag"), F.col("seq"), F.col("qual"))
    kept = kept.select("name", flags(F.col("flag"))["first"].alias("first"), seq.alias("seq"), qual.alias("qual"))
    of = lambda c, one: F.first(F.when(F.col("first") == one, F.col(c)), ignorenulls=True)
    return kept.groupBy("name").agg(of("seq", True).alias("seq1"), of("qual", True).alias("qual1"), of("seq", False).alias("seq2"), of("qual", False).alias("qual2"))
