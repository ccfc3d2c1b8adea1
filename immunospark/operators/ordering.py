"""Places in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_place(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, in a total order.

    The rows are range-partitioned by the order, numbered within their partition, and raised by the
    number of rows in the partitions before; those counts are one row per partition.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint"))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy("_one").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
