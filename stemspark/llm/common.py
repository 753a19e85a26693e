"""What the corpus operators share: reading, batch size, and tables that survive the loss of an executor."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settled as cut  # noqa: F401  written to the shared folder and read from there
from ..lineage import shared_folder as shared_dir  # noqa: F401

#: Rows and bytes of an Arrow batch handed to Python; whole texts are long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Bounds an Arrow batch for the session's later queries, so that a batch of long texts fits a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def give_back() -> None:
    """Freed memory of a Python worker goes back to the system, since the worker lives on beside later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """A function for mapInArrow whose worker gives back what it freed when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: A group of so many bytes or more gives back its memory.
LARGE_GROUP = 1 << 20


def lean_group(run):
    """The same for applyInArrow, after each large group."""

    @functools.wraps(run)
    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            if table.nbytes >= LARGE_GROUP:
                give_back()

    return wrapped


def lean_cogroup(run):
    @functools.wraps(run)
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            if left.nbytes + right.nbytes >= LARGE_GROUP:
                give_back()

    return wrapped


def byte_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values, cut at the ends, as a row of bytes each, without a copy a row."""
    offsets = np.concatenate([[0], ends * values.itemsize])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values)])
    return pa.array([values[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: The columns that stages know by name.
KNOWN = ("doc_id", "text", "lang", "n_chars")


def guarded(stage):
    """A stage of the pipeline whose further columns pass under other names, so that none clashes with a stage's own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [c if c in KNOWN else f"_x{k}" for k, c in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*(F.col(i).alias(c) for i, c in zip(inner, names, strict=True)))

    return run


#: The most keys that spread_join broadcasts: each has this part of all rows.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with the one row that table has for each key, without a task that gets all rows of a frequent key.

    weight: the column of table that counts a key's rows. Of keys with a 10,000th of these rows or more there are at most 10,000; those
    are broadcast, and no other key has more rows than that. Both frames are read more than once and should be cut.
    """
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    if not total or most * HOT_KEYS < total:
        return rows.join(table, on)
    hot = F.col(weight) * HOT_KEYS >= total
    often = F.broadcast(table.where(hot))
    seldom = rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti").join(table.where(~hot), on)
    return rows.join(often, on).unionByName(seldom)


def ascii_lower(column):
    """Lower-cases A-Z only; translate() is slow, and for pure ASCII the two agree."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def whole_text(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_sum(column="text"):
    """A 64-bit hash of a whole text; with the doc_id it tells apart rows that share the doc_id."""
    return F.xxhash64(whole_text(column))
