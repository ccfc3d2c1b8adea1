"""The corpus pipeline: language ID, line dedup, near-duplicate join, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents; run() then deletes the predecessor's and what the stage itself stored.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from immunospark.llm import language_id as lang
from immunospark.llm import line_dedup as lines
from immunospark.llm import mixing, ngram_join, packing
from immunospark.llm.shared import drop_path, named, scratch, stored, table

#: Share of the tokens that mixing takes; documents are taken once at most.
MIX_SHARE = 0.9


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier rejects go. It learns from the labelled rows of its own input."""
    model = lang.learned(docs.select("text", "lang"))
    return lang.kept(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and with them documents that nothing is left of; n_chars follows the text."""
    out = lines.line_dedup(docs.drop("n_lines", "n_dropped"))
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied | F.col("text").isNull())
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*named(docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest id, null ones last; rows are judged by their own text."""
    return ngram_join.kept(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's documents up to its budget."""
    levels = [("domain", mixing.domain_of(F.col("source"))), ("lang", F.col("lang")), ("source", F.col("source"))]
    return mixing.mix(docs, levels, share=MIX_SHARE, epochs=1).select(*named(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Compression, MinHash and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch() as paths:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        *inner, result = paths
        for path in [*before, *inner]:
            drop_path(spark, path)
        before = [result]
    return docs
