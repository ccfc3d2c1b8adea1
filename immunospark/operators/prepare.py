"""Reads made ready for assembly by their gene hits: dropped, trimmed, and their hits moved with them.

What lies before a trusted V gene and behind a trusted constant gene isn't receptor and would join unlike contigs, so it
is cut off, and all coordinates of the read's hits move by what is cut. Reads whose genes lie in the wrong order, reads
deep in a constant gene alone and reads that are too short go. Everything here is expressions over a
read's own columns; only finding the hits needs joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from . import chains, filters
from .reference import K, RADIUS

#: Letters that a read must keep; letters of a gene that may be missing before a trusted hit, and the similarities for that.
LEAST, V_MISSING, V_SIMILAR, V_SURE, C_MISSING, C_SIMILAR = 31, 31, 90.0, 95.0, 9, 95.0

HIT = "struct<gene:string,ref_len:int,read_start:int,read_end:int,ref_start:int,ref_end:int,similarity:double>"


def gene_hits(reads: DataFrame, ref: DataFrame, need: int = 27, k: int = K, radius: int = RADIUS) -> DataFrame:
    """id, v, j, c (HIT or null) of reads (id, seq) on the genes' strand: of each type the chain that covers most, ties to the smallest gene.

    The similarity is that of all letters where a hit has no indel, else the share that its k-mers cover.
    """
    found = chains.read_chains(reads.select("id", "seq"), ref, need, k, radius).where("strand = 1")
    kinds = ref.select(F.col("gene_idx").alias("gene"), "name", F.col("gene_type").alias("type"), F.col("seq").alias("gene_seq"))
    cover = F.least("read_cover", "gene_cover")
    best = found.join(kinds, "gene").where(F.col("type").isin("V", "J", "C")).groupBy("id", "type").agg(
        F.max_by(F.struct("name", "gene_seq", "read_start", "read_end", "gene_start", "gene_end", cover.alias("cover")), F.struct(cover, -F.col("gene"))).alias("h")
    )
    best = best.select("id", "type", "h.*").join(reads.select(F.col("id").cast("string").alias("id"), F.col("seq").alias("read")), "id")
    a, b = F.col("read_end") - F.col("read_start") + 1, F.col("gene_end") - F.col("gene_start") + 1
    letters = 1 - dna.hamming(F.substr("read", F.col("read_start") + 1, a), F.substr("gene_seq", F.col("gene_start") + 1, b)) / a
    similar = F.when(a == b, letters).otherwise(2 * F.col("cover") / (a + b))
    hit = F.struct(
        F.split("name", r"\|")[0].alias("gene"), F.length("gene_seq").alias("ref_len"), "read_start", "read_end", F.col("gene_start").alias("ref_start"), F.col("gene_end").alias("ref_end"), (100 * similar).cast("double").alias("similarity")
    )
    return best.groupBy("id").agg(*[F.max_by(hit, F.when(F.col("type") == t, 1)).alias(t.lower()) for t in "VJC"])


def front(v: Column) -> Column:
    """Letters before a V gene that is trusted to begin there."""
    near = (v.ref_start < V_MISSING) & (v.similarity > V_SIMILAR)
    sure = (v.similarity > V_SURE) & (v.ref_start <= v.ref_len / 3)
    return F.coalesce(F.when(near | sure, F.greatest(v.read_start, F.lit(0))), F.lit(0))


def behind(length: Column, v: Column, j: Column, c: Column) -> Column:
    """Letters behind a trusted constant gene, unless that would cut into V or J."""
    n = length - c.read_end - 1
    cuts = F.coalesce(j.read_start + n >= length, F.lit(False)) | F.coalesce(v.read_start + n >= length, F.lit(False))
    return F.coalesce(F.when((c.ref_start < C_MISSING) & (c.similarity > C_SIMILAR) & (n > 0) & ~cuts, n), F.lit(0))


def moved(hit: Column, cut: Column, length: Column) -> Column:
    """A hit in a read that lost its first `cut` letters and has `length` left; null where nothing of it is left."""
    start, end = hit.read_start - cut, hit.read_end - cut
    part = F.struct(
        hit.gene.alias("gene"), hit.ref_len.alias("ref_len"), F.greatest(start, F.lit(0)).alias("read_start"), F.least(end, length - 1).alias("read_end"),
        hit.ref_start.alias("ref_start"), hit.ref_end.alias("ref_end"), hit.similarity.alias("similarity"),
    )
    return F.when((end >= 0) & (start < length), part)


def prepared(rows: DataFrame, first_length: int = 0, far: int = 200) -> DataFrame:
    """Rows (id, seq, strand, v, j, c, others) that are fit for assembly, with seq trimmed and hits moved; adds cut_front and cut_back.

    A constant gene that ends a trimmed read is no hit any more. first_length: letters of the library's reads, from which the least
    length follows for long reads. Rows without any hit stay as they are if they are long enough; a null sequence goes.
    """
    v, j, c = F.col("v"), F.col("j"), F.col("c")
    n = F.length("seq")
    good = rows.where(~filters.wrong_order([v, j, c]) & ~filters.constant_only(v, j, c, n, F.col("strand"), far))
    good = good.withColumn("cut_front", front(v))
    left = F.length("seq") - F.col("cut_front")
    good = good.withColumns({k: moved(F.col(k), F.col("cut_front"), left) for k in "vjc"})
    good = good.withColumn("cut_back", behind(left, v, j, c))
    size = F.length("seq") - F.col("cut_front") - F.col("cut_back")
    cut = good.withColumns({k: moved(F.col(k), F.lit(0), size) for k in "vj"} | {"c": F.when(F.col("cut_back") == 0, moved(F.col("c"), F.lit(0), size))})
    cut = cut.withColumn("seq", F.substr("seq", F.col("cut_front") + 1, F.greatest(size, F.lit(0))))
    return cut.where(~filters.too_short(F.length("seq"), first_length, LEAST))


def for_assembly(reads: DataFrame, ref: DataFrame, need: int = 27, first_length: int = 0) -> DataFrame:
    """Reads (id, seq, strand, others) that are fit for assembly, trimmed; the columns stay."""
    hits = gene_hits(reads, ref, need)
    # v, j and c, cut_front and cut_back are this operator's own names
    rows = reads.join(hits.withColumnRenamed("id", "_id"), F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    return prepared(rows, first_length).select(*reads.columns)
