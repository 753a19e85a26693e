"""Sinks: published once, whole, and only if wanted."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .files import sha256_of


def is_published(spark, path: str) -> bool:
    """Whether a job finished writing this folder; what a failed one left does not count."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def publish(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False, **options) -> bool:
    """What is published stays unless forced; the mark of success comes last, and a folder without it is written anew. False if it stayed."""
    if not force and is_published(df.sparkSession, path):
        return False
    df.write.mode("overwrite").options(**options).format(fmt).save(path)
    return True


def publish_csv(df: DataFrame, path: str, force: bool = False) -> bool:
    return publish(df, path, "csv", force, header=True)


def publish_text(text: str, path: str, force: bool = True) -> bool:
    """One small document: a temporary file is renamed. False if it was there and not forced."""
    if not force and files.size_of(path) is not None:
        return False
    files.write_whole(path, [text.encode()])
    return True


def publish_json(row: DataFrame, path: str, force: bool = True, mark: bool = False) -> bool:
    """A one-row frame as an indented document; nulls are written, other alphabets kept. mark: it begins with a byte-order mark."""
    value = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    return publish_text(("\ufeff" if mark else "") + json.dumps(json.loads(value), ensure_ascii=False, indent=2) + "\n", path, force)


def publish_documents(rows: DataFrame, folder: str) -> None:
    """Rows (name, json) as a file each, written whole by executors."""

    def run(batches):
        attempt = f".{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("json").to_pylist(), strict=True):
                files.write_whole(f"{folder}/{name}", [text.encode()], attempt)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], ["done"])

    rows.select("name", "json").mapInArrow(run, "done int").agg(F.count("*")).collect()


def publish_checksum(path: str, to: str | None = None) -> str:
    """The digest of a file, written beside it unless another place is named."""
    digest = sha256_of(path)
    publish_text(f"{digest}  {path.rsplit('/', 1)[-1]}\n", to or path + ".sha256")
    return digest


def chunk_of(index: str, n_rows, chunks: int = 3):
    """The contiguous chunk of a 0-based index."""
    return F.floor(F.col(index) / F.greatest(F.lit(1), F.ceil(F.lit(n_rows) / chunks))).cast("int")


def morton(ix, iy, bits: int = 16):
    """Interleaved bits of two cell numbers: near codes are near cells."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(ix.cast("bigint"), b).bitwiseAND(F.lit(1)), 2 * b)).bitwiseOR(F.shiftleft(F.shiftright(iy.cast("bigint"), b).bitwiseAND(F.lit(1)), 2 * b + 1))
    return out


def publish_spatial(points: DataFrame, path: str, cell: float, low_x: float, low_y: float, partitions: int, force: bool = False) -> None:
    """Parquet in spatial order, so that row groups cover small areas and a window prunes them."""
    code = morton(F.floor((F.col("x") - low_x) / cell), F.floor((F.col("y") - low_y) / cell))
    ordered = points.withColumn("cell_code", code).repartitionByRange(partitions, "cell_code").sortWithinPartitions("cell_code", "point_index")
    publish(ordered, path, "parquet", force)
