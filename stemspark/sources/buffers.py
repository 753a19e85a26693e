"""Headerless position and colour buffers: little-endian float triples, and RGBA bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from . import files

POINT_BYTES, COLOUR_BYTES = 12, 4
#: Points that are read into one batch.
RANGE = 500_000


def _ranges(spark: SparkSession, pattern: str, size: int) -> DataFrame:
    """path, first, n, base: ranges of records over the files in name order; base: the index of the first. Only file sizes are read here."""
    rows, base = [], 0
    for path in files.listed(pattern):
        length = files.size_of(path)
        if length % size:
            raise ValueError(f"{path} must hold whole points")
        rows += [(path, a, min(RANGE, length // size - a), base + a) for a in range(0, length // size, RANGE)]
        base += length // size
    ranges = spark.createDataFrame(rows, "path string, first long, n long, base long")
    return ranges.repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _read(spark: SparkSession, pattern: str, size: int, columns: dict[str, str], decode) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                values = decode(files.read_range(r["path"], r["first"] * size, r["n"] * size))
                yield pa.RecordBatch.from_arrays([pa.array(r["base"] + np.arange(r["n"])), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(3))], ["point_index", *columns])

    return _ranges(spark, pattern, size).mapInArrow(run, "point_index long, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def read_positions(spark: SparkSession, pattern: str) -> DataFrame:
    """point_index, x, y, z over all buffers in name order, widened to doubles. A buffer's bytes must make whole points."""
    return _read(spark, pattern, POINT_BYTES, dict.fromkeys("xyz", "double"), lambda data: np.frombuffer(data, "<f4").reshape(-1, 3).astype(np.float64))


def read_colours(spark: SparkSession, pattern: str) -> DataFrame:
    """point_index, r, g, b; alpha goes."""
    return _read(spark, pattern, COLOUR_BYTES, dict.fromkeys("rgb", "int"), lambda data: np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int32))


def read_cloud(spark: SparkSession, positions: str, colours: str | None = None) -> DataFrame:
    points = read_positions(spark, positions)
    return points.join(read_colours(spark, colours), "point_index") if colours else points


def write_buffers(points: DataFrame, folder: str, chunks: int = 3) -> list[str]:
    """The viewer's files, written by executors: a task a position chunk, and one for the colours.

    Chunks are ceil(n / chunks) points each; the last may be shorter or missing points altogether. Points come in index order.
    """
    spark = points.sparkSession
    placed = numbered(points.select("point_index", "x", "y", "z", "r", "g", "b"), ["point_index"], "_place")
    n = placed.count()
    each = max(1, -(-n // chunks))
    names = [f"{folder}/positions-{k:02d}.glbin" for k in range(chunks)] + [f"{folder}/colors.glbin"]
    for name in names:  # a chunk without points is an empty file
        files.write_whole(name, [b""])

    def run(batches):
        mark = f".{TaskContext.get().taskAttemptId()}"
        current, parts, waiting = None, None, iter(batches)

        def of_file():
            """The bytes of the current file, until rows of another one come."""
            nonlocal current, rest
            while rest is not None:
                same = rest.column("file").to_numpy() == current
                own = rest.filter(pa.array(same))
                if own.num_rows:
                    if current < chunks:
                        yield np.stack([own.column(c).to_numpy() for c in "xyz"], 1).astype("<f4").tobytes()
                    else:
                        yield np.stack([*(own.column(c).to_numpy() for c in "rgb"), np.full(own.num_rows, 255)], 1).astype(np.uint8).tobytes()
                if not same.all():
                    rest = rest.filter(pa.array(~same))
                    return
                rest = next(waiting, None)

        rest = next(waiting, None)
        while rest is not None:
            if not rest.num_rows:
                rest = next(waiting, None)
                continue
            current = int(rest.column("file")[0].as_py())
            files.write_whole(names[current], of_file(), mark)
            yield pa.RecordBatch.from_arrays([pa.array([names[current]])], ["name"])

    both = placed.withColumn("file", F.explode(F.array(F.floor((F.col("_place") - 1) / each).cast("int"), F.lit(chunks))))
    dealt = both.repartitionByRange(chunks + 1, "file").sortWithinPartitions("file", "_place").select("file", "x", "y", "z", "r", "g", "b")
    dealt.mapInArrow(run, "name string").collect()  # a row a file
    return names
