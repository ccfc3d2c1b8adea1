"""Bounded samples that no single task has to gather whole: a share is cut first, then the exact number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By how much the share is cut too large, so that it surely holds the sample.
SPARE = 1.2
_HASHES = 1 << 40


def smallest(rows: DataFrame, sample: int, order: Column | None = None) -> DataFrame:
    """The first `sample` rows by a numeric order, or by the hash of all columns, ties by all columns; the same in each run.

    The rows are counted, and only those that can be among the first go on to the sort: by order up to an
    approximate percentile of it, by hash up to the share wanted. So a task sends what it has of the sample and no more.
    """
    total = rows.count()
    keyed = rows.withColumn("_place", order if order is not None else F.pmod(F.xxhash64(*rows.columns), F.lit(_HASHES)))
    if total > SPARE * sample:
        share = SPARE * sample / total
        top = int(share * _HASHES) if order is None else keyed.agg(F.percentile_approx("_place", min(1.0, share), 10_000)).first()[0]
        keyed = keyed.where(F.col("_place") <= top)
    return keyed.orderBy("_place", *rows.columns).limit(sample).drop("_place")
