"""Ranks over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.storage import materialize


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add each row's place from 1 in ``order``.

    Rows are dealt out by ranges of ``order``; a row's rank is its place in its range plus
    the sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_in", within).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
