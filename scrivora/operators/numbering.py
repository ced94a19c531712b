"""Dense numbers over a total order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivora.session import materialize


def number_rows(df: DataFrame, order: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, … in the order of columns ``order``.

    Rows are split by range; each range is numbered on its own and shifted by the sizes of the ranges before it (one row per
    range, at most ``partitions``).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_within", within).join(F.broadcast(shift), "_part").withColumn(name, F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")
