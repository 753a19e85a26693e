"""The notes table: the newest twenty, and an append that returns what it stored."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settled
from ..operators.sampling import numbered

SCHEMA = "id long, title string, content string, created_at string"


def newest(notes: DataFrame, n: int = 20) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


@contextlib.contextmanager
def locked(spark: SparkSession, path: str):
    """One writer at a time: a file that only one can create. What a crashed writer leaves must be removed by hand."""
    lock = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lock")
    system = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        system.create(lock, False).close()
    except Exception as e:
        raise RuntimeError(f"{path} is being written to") from e
    try:
        yield
    finally:
        system.delete(lock, False)


def append(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Stores rows (title, content): both trimmed, missing content as empty. A missing or blank title fails the whole call.

    Ids follow the largest stored one; a second writer fails while one is at work, so no id is given twice.
    """
    clean = new.select(F.trim("title").alias("title"), F.coalesce(F.trim("content"), F.lit("")).alias("content"))
    if not clean.where("coalesce(title, '') = ''").isEmpty():
        raise ValueError("title is required")
    with locked(spark, path):
        try:
            last = spark.read.schema(SCHEMA).parquet(path).agg(F.max("id")).first()[0] or 0
        except Exception as e:  # a table that does not exist yet is empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = 0
        placed = numbered(clean, ["title", "content"], "n")
        rows = settled(placed.select((F.col("n") + last).cast("long").alias("id"), "title", "content", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created_at")))
        rows.write.mode("append").parquet(path)
    return rows
