"""Numbers and running sums over all rows of a table that may be large: no window holds more than one range of rows.

Rows are dealt to ranges of their whole order, whose bounds Spark samples, so that neither a common
prefix nor one very frequent value makes a range larger than others (rows that are equal in the
whole order are the only ones that stay together). Ranges are counted, the counts summed up, and
only a range's rows are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.sources.staging import staged


def with_numbers(rows: DataFrame, *order: str, into: str = "number", value: str | None = None) -> DataFrame:
    """The rows with their place in order, from 1; with `value`, with the sum of that column over all rows before them instead."""
    # The ranges are drawn from a sample, so they are written down before anything is counted by them.
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range_no", F.spark_partition_id()), "ranges")
    one = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    within = Window.partitionBy("_range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_range_upto", F.sum(one).over(within))
    sums = dealt.groupBy(F.col("_range_no").alias("_range_of")).agg(F.sum(one).alias("_range_n"))
    # One row for each range, of which there are as many as shuffle partitions.
    before = sums.select("_range_of", (F.sum("_range_n").over(Window.orderBy("_range_of")) - F.col("_range_n")).alias("_range_before"))
    number = F.col("_range_before") + F.col("_range_upto") - (0 if value is None else one)
    return placed.join(before, F.col("_range_no") == F.col("_range_of")).withColumn(into, number).drop("_range_no", "_range_upto", "_range_of", "_range_n", "_range_before")
