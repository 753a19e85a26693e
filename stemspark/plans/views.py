"""Point views derived from the driver's tables; integer arithmetic first, so that any engine gets the same doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCATTER = {
    "point_index": "event_id",
    "x": "5 + ((event_id * 7919) % 40000) / 1000",
    "y": "-25 + ((event_id * 104729) % 30000) / 1000",
    "hag": "((event_id * 31337) % 2400) / 1000",
}
SCATTER_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCATTER.items()) + ", user_id FROM events"

STEM = {
    "point_index": "event_id",
    "stem_id": "user_id",
    "cx": "5 + ((user_id * 7919) % 400) / 10",
    "cy": "-25 + ((user_id * 104729) % 300) / 10",
    "r": "(3 + user_id % 20) / 100",
    "angle": "((event_id * 31337) % 3600) / 3600 * 2 * pi()",
    "hag": "((event_id * 31337) % 2400) / 1000",
}
STEM_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in STEM.items()) + " FROM events"


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in SCATTER.items()), "user_id")


def stem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in STEM.items()))
