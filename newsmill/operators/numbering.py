"""Row numbers over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows and their place (long, from 0) in an order without ties.

    Ranges of the order are sorted side by side; a range's numbers begin after the rows of the ranges before it. The
    ranges are written, so that both passes see the same ones. The one window without a key is over a row a range.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, place.cast("long")).drop("_range", "_start")
