"""Writers of the text formats: each gives a frame of lines for `write.text`, so any file system will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cdr3 as fcdr3
from ..functions import genes
from ..operators.airr import COLUMNS as AIRR
from .tables import MISSING_BARCODE, annotation_line


#: The columns of the 10x contig table. Fixed values.
TENX = [
    "barcode", "is_cell", "contig_id", "high_confidence", "length", "chain", "v_gene", "d_gene", "j_gene", "c_gene", "full_length", "productive", "cdr3", "cdr3_nt", "reads", "umis",
    "raw_clonotype_id", "raw_consensus_id",
]
#: Results that each cleanup level deletes.
CLEANED = [["reads", "contigs", "placed"], ["annotations", "cdr3", "report", "cells"]]


def fastx_lines(reads: DataFrame, seq: Column | None = None, qual: Column | None = None) -> DataFrame:
    """FASTQ records, FASTA ones where there is no quality."""
    seq, qual = seq if seq is not None else F.col("seq"), qual if qual is not None else F.col("qual")
    fastq = F.concat_ws("\n", F.concat(F.lit("@"), "id"), seq, F.lit("+"), qual)
    return reads.select(F.when(qual.isNotNull(), fastq).otherwise(F.concat_ws("\n", F.concat(F.lit(">"), "id"), seq)).alias("value"))


def barcode_lines(reads: DataFrame, value: str = "barcode", skip_errors: bool = False) -> DataFrame:
    """FASTA of barcodes or UMIs; those that couldn't be corrected are dropped or written as missing."""
    rows = reads.where(F.col(value).isNotNull()) if skip_errors else reads
    return rows.select(F.concat_ws("\n", F.concat(F.lit(">"), "id"), F.coalesce(F.col(value), F.lit(MISSING_BARCODE))).alias("value"))


def contig_lines(contigs: DataFrame) -> DataFrame:
    row = lambda b: F.concat_ws(" ", F.transform("pos_weight", lambda w: w[b].cast("string")))
    return contigs.select(F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit(">"), "cid"), "name"), "consensus", *[row(b) for b in "acgt"]).alias("value"))


def assembled_read_lines(reads: DataFrame) -> DataFrame:
    tag = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
    head = F.concat_ws(" ", F.concat(F.lit(">"), "id"), *[F.col(c).cast("string") for c in ("strand", "min_cnt", "median_cnt")], tag("barcode", "barcode"), tag("umi", "umi"))
    return reads.select(F.concat_ws("\n", head, "seq").alias("value"))


def annotation_lines(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit(">"), "cid"), annotation_line()), "seq").alias("value"))


def cdr3_lines(rows: DataFrame) -> DataFrame:
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    two = lambda c: F.format_string("%.2f", F.col(c))
    return rows.select(F.concat_ws("\t", "cid", F.col("idx").cast("string"), *[star(c) for c in ("v", "d", "j", "c", "cdr1", "cdr2")], "cdr3", two("score"), two("count"), two("germline_similarity"), F.col("complete_vdj").cast("string")).alias("value"))


def assignment_lines(assigned: DataFrame) -> DataFrame:
    return assigned.select(F.concat_ws("\t", "id", "cid").alias("value"))


def airr_lines(rows: DataFrame) -> DataFrame:
    """Lines of the AIRR table; its header is the tab-separated names of the columns."""
    two = {"consensus_count": lambda c: F.format_string("%.2f", c.cast("double"))}
    return rows.select(F.concat_ws("\t", *[F.coalesce(two.get(c, lambda x: x.cast("string"))(F.col(c)), F.lit("")) for c in AIRR]).alias("value"))


def write_airr(rows: DataFrame, path: str) -> None:
    write_lines(airr_lines(rows), path, "\t".join(AIRR))


def tenx_lines(report: DataFrame, t_cells: bool) -> DataFrame:
    """Lines of the 10x contig table: both chains of T cells, or of all others."""
    parts = [report.select("barcode", "cell_type", F.lit(s).alias("side"), F.col(f"chain{s}").alias("x")).where(F.col("x").isNotNull()) for s in (1, 2)]
    rows = parts[0].unionByName(parts[1]).where(F.col("cell_type").endswith("T") == F.lit(t_cells))
    x, none, truth = F.col("x"), F.lit("None"), lambda c: F.when(c, "True").otherwise("False")
    count = F.format_string("%.2f", x["count"])
    fields = [
        F.col("barcode"), F.lit("True"), x.cid, F.lit("True"), none, F.coalesce(genes.locus_by_first_called(x.v, x.j, x.c), none), *[F.coalesce(x[g], none) for g in "vdjc"],
        truth(x.complete_vdj == 1), truth(fcdr3.productive(x.cdr3aa)), x.cdr3aa, x.cdr3nt, count, count, none, none,
    ]
    return rows.select(F.concat_ws(",", *fields).alias("value"))


def write_tenx(report: DataFrame, prefix: str) -> None:
    """prefix_t.csv and prefix_b.csv."""
    for kind in "tb":
        write_lines(tenx_lines(report, kind == "t"), f"{prefix}_{kind}.csv", ",".join(TENX))


def clean(spark: SparkSession, folder: str, level: int) -> list[str]:
    """Delete a run's results (see plans.pipeline.resume) that are in between, at level 1, and those that reports are made of too, at level 2; the names deleted."""
    names = [name for at, group in enumerate(CLEANED, 1) if at <= level for name in group]
    jvm, gone = spark.sparkContext._jvm, []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(name)
    return gone


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write lines; a header goes into a part of its own, before all others."""
    if header is None:
        lines.select("value").write.mode("overwrite").text(path)
        return
    spark = lines.sparkSession
    head = spark.createDataFrame([(header,)], "value STRING").coalesce(1)
    head.unionByName(lines.select("value")).write.mode("overwrite").text(path)
