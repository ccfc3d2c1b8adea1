"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct normalised text. A batch is
reduced to one row per digest (map-side combined, so a text with a third of all rows is a few rows
before the shuffle), anti-joined with the index by sort-merge, and the survivors are appended. The
verdict on every row is then read out of the index: the row that the index keeps for its digest stays.
The index side of these joins is neither shuffled nor sorted again, so the cost of a batch is that of
the batch. Only digests, lengths and ids are ever shuffled, never texts.

What the index holds is never displaced, so that a whole table goes in by batches of falling length
(code points): the longest of equal texts is in the first batch that has any.

Defined results: a null text counts as empty; empty texts are equal to one another; of equal texts
of a batch the one with the most code points stays, then the smallest doc_id, and a text that the index already
holds never displaces the document kept earlier. Rows that repeat a doc_id are rows of their own:
all but one of them (equal text) are dropped only as far as the id tells them apart, so `kept` holds
for every row with the kept id. A null doc_id sorts after all others. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK, drop_path, new_path, shuffle_partitions, stored, table, text_of

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT, keep_len INT"
#: Batches in which the query adds its table to the index.
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text without the six blank characters."""
    return F.unhex(F.sha2(F.regexp_replace(text, f"{BLANK}+", "").cast("binary"), 256))


class DigestIndex:
    """A digest index at a path that outlives the session; a session that opens the path again, by the same number of buckets, goes on with it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        return cls(spark, path or new_path(spark, "digest-index"), buckets or shuffle_partitions(spark))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add digests that the index lacks. Running it again after a failure adds nothing twice, as the anti-join runs again."""
        (
            fresh.select("digest", F.col("keep_id").cast("bigint"), F.col("keep_len").cast("int"))
            .repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.length(text).alias("len"), digest(text).alias("digest"))


def added(rows: DataFrame, index: DigestIndex) -> None:
    """Anti-join a batch of keyed rows with the index, and append the best row of each digest that the index lacks."""
    order = F.struct((-F.col("len")).alias("shorter"), F.col("doc_id").isNull().alias("none"), "doc_id")
    best = rows.groupBy("digest").agg(F.min_by(F.struct("doc_id", "len"), order).alias("best"))
    best = best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.len").alias("keep_len"))
    # stored first: what is appended to mustn't be what is still being read
    index.append(stored(best.join(index.read().hint("merge"), "digest", "left_anti"), "fresh"))


def verdicts(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size (rows with that digest), kept, text_sha256 of keyed rows whose digests the index holds."""
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    found = stored(sizes.join(index.read().hint("merge").select("digest", "keep_id"), "digest"), "verdicts")
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """Deduplicate docs among themselves and against the index, and add them to the index, the longest texts first.

    Returns doc_id, keep_id, group_size (rows of docs with that text), kept, text_sha256.
    """
    rows = stored(keyed(docs, id_col, text_col), "digests")
    cuts = (rows.agg(F.percentile_approx("len", [k / batches for k in range(batches - 1, 0, -1)])).first()[0] or []) if batches > 1 else []
    above = None
    for cut in [*cuts, None]:
        batch = rows if cut is None else rows.where(F.col("len") >= cut)
        added(batch if above is None else batch.where(F.col("len") < above), index)
        above = cut
    return verdicts(rows, index)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex.create(spark)
    out = dedup(table(spark, sf_dir, "documents"), index, batches=BATCHES)
    index.drop()  # the verdicts are stored, and nobody else knows this index
    return out


ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
