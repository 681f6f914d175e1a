"""Numbers in order without a global sort: groups of leading bits first, then within each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, keys: list[str], order: str, shift: int, name: str = "rank") -> DataFrame:
    """``rows`` with a number from 0 in each of ``keys``, by the whole number ``order``, which tells the rows of a key apart."""
    held = rows.withColumn("part", F.shiftright(order, shift))
    # A row for each key and part of its range.
    newer = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(*keys, "part").agg(F.count("*").alias("c")).select(*keys, "part", F.coalesce(F.sum("c").over(newer), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(order)) - 1
    return held.withColumn("own", own).join(before, [*keys, "part"]).withColumn(name, (F.col("before") + F.col("own")).cast("long")).drop("part", "own", "before")
