"""Systematic samples, rankings and bounded reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled


def stride_sample(points: DataFrame, step: int, index: str = "point_index") -> DataFrame:
    """Every step-th point from index 0; a filter, since sources number their points."""
    if step < 1:
        raise ValueError("the step must be at least 1")
    return points.where(F.col(index) % step == 0)


def budget_sample(points: DataFrame, n_points: int, budget: int | None, index: str = "point_index") -> DataFrame:
    """At most `budget` points; None keeps all."""
    if budget is not None and budget < 1:
        raise ValueError("the budget must be at least 1")
    return points if budget is None else stride_sample(points, max(1, -(-n_points // budget)), index)


def stride_in_groups(rows: DataFrame, keys: list[str], most: int, order: str) -> DataFrame:
    """At most `most` rows of each group, at an even stride in the given order."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumns({"_rn": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return numbered.where(F.col("_rn") % F.ceil(F.col("_n") / most) == 0).drop("_rn", "_n")


def numbered(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based place in a total order, without a task that sees all rows: ranges of the order, places within them, and the rows before each.

    Only one count a range reaches the driver. The ranges are written once, so that counts and places see the same rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = settled(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(ranges.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):  # a row a range
        before[r["_range"]], total = total, total + r["n"]
    if not before:
        return ranges.withColumn(name, F.lit(0).cast("long")).drop("_range")
    start = F.create_map(*(F.lit(x) for item in before.items() for x in item))[F.col("_range")]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn(name, (place + start).cast("long")).drop("_range")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """numbered, with places as int, for results such as stems."""
    placed = numbered(rows, order, name)
    return placed.withColumn(name, F.col(name).cast("int"))
