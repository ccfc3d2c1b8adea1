"""Reports of cells that come as a file each: the chosen clonotypes with their annotations and AIRR rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _chosen(top: DataFrame) -> DataFrame:
    """cell, cid, cdr3nt: a contig chosen twice stands for its first row."""
    w = Window.partitionBy("cell", "cid").orderBy("side", "rank")
    return top.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cell", "cid", "cdr3nt")


def report(top: DataFrame) -> DataFrame:
    """The chosen clonotypes of all cells (cell, cid, cdr3nt, side, rank, ...), with cells in the ids of their contigs."""
    return top.withColumn("cid", F.concat_ws("_", "cell", "cid"))


def annotations(top: DataFrame, annotated: DataFrame) -> DataFrame:
    """The chosen contigs' annotations (cell, cid, ...)."""
    return annotated.join(_chosen(top), ["cell", "cid"], "left_semi").withColumn("cid", F.concat_ws("_", "cell", "cid"))


def airr(top: DataFrame, rows: DataFrame) -> DataFrame:
    """The AIRR rows (cell, sequence_id, junction, ...) of the chosen contigs' chosen CDR3s, with cell_id."""
    keyed = rows.withColumn("cid", F.split("sequence_id", "_")[0])
    found = keyed.join(_chosen(top).withColumnRenamed("cdr3nt", "_cdr3"), ["cell", "cid"]).where(F.col("junction") == F.col("_cdr3"))
    return found.drop("cid", "_cdr3", "cell_id").withColumn("sequence_id", F.concat_ws("_", "cell", "sequence_id")).withColumn("cell_id", F.col("cell"))
