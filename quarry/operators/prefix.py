"""Row numbers and running sums over a whole table without bringing it into one task.

The table is dealt into ranges of its order and written, sorted, with the number of the range. Each range counts and sums by itself; what stands before a
range is the sum of the ranges before it, of which there are as many as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import written


def numbered(rows: DataFrame, order: list[Column | str], sums: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``_n`` (from 1) in the given order, and for each of ``sums`` the running sum up to the row. Rows that the order doesn't tell apart stand in any order."""
    sums = sums or {}
    values = {f"_v_{name}": c for name, c in sums.items()}
    dealt = rows.withColumns(values) if values else rows
    dealt = dealt.repartitionByRange(ranges, *order) if ranges else dealt.repartitionByRange(*order)
    at = F.monotonically_increasing_id()
    held = written(dealt.sortWithinPartitions(*order).withColumn("_at", at), "ranges").withColumn("_range", F.shiftright("_at", 33))
    totals = held.groupBy("_range").agg(F.count("*").alias("_count"), *[F.coalesce(F.sum(v), F.lit(0)).alias(f"_sum{v}") for v in values])
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_range", F.coalesce(F.sum("_count").over(upto), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_sum{v}").over(upto), F.lit(0)).alias(f"_before{v}") for v in values])
    own = Window.partitionBy("_range").orderBy("_at")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(before), "_range").withColumns({"_n": F.row_number().over(own) + F.col("_before")} | {name: F.coalesce(F.sum(f"_v_{name}").over(run), F.lit(0)) + F.col(f"_before_v_{name}") for name in sums})
    return out.select(*rows.columns, "_n", *sums)
