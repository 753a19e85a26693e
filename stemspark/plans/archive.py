"""The archive run: what the raw file holds, a full and a preview copy in spatial order, and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import step_for
from ..operators.clouds import extent
from ..operators.sampling import stride_sample
from ..sources import files, sinks
from ..sources.las import checked_header, las_header, read_las

LEAST_FREE = 12 << 30


def require_space(spark: SparkSession, folder: str, least: int = LEAST_FREE) -> None:
    """Room left in the file system that holds the folder, which need not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    free = path.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining()
    if free < least:
        raise OSError(f"{folder} has less than {least >> 30} GiB free")


def discover(pattern: str, override: str | None = None) -> str:
    """The raw file: the one that is named, else the first that matches, in name order."""
    if override:
        if files.size_of(override) is None:
            raise FileNotFoundError(override)
        return override
    found = files.listed(pattern, ".las")
    if not found:
        raise FileNotFoundError(pattern)
    return found[0]


def describe(spark: SparkSession, path: str) -> DataFrame:
    """One row: format facts and the extent of all points."""
    h = las_header(path)
    facts = {"point_format": h["point_format"], "record_length": h["record_length"], "version": ".".join(map(str, h["version"]))}
    return extent(read_las(spark, path, ["x", "y", "z"])).select(F.col("n_points").alias("num_points"), "*", *(F.lit(v).alias(k) for k, v in facts.items()))


def archive(spark: SparkSession, path: str, out: str, preview_points: int = 2_000_000, cell: float = 1.0, force: bool = False, least_free: int = LEAST_FREE) -> DataFrame:
    """Publishes full/, preview/, a checksum and source-info.json; what exists stays unless forced. Returns the manifest row."""
    require_space(spark, out, least_free)
    n = checked_header(path)["point_count"]
    if n < 1:
        raise ValueError("the archive holds no points")
    row = describe(spark, path)
    step = spark.range(1).select(step_for(F.lit(n), F.lit(preview_points))).first()[0]
    low = row.first()
    points = read_las(spark, path)
    parts = max(1, -(-n // 2_000_000))
    sinks.publish_spatial(points, f"{out}/full", cell, low["min_x"], low["min_y"], parts, force)
    sinks.publish_spatial(stride_sample(points, step), f"{out}/preview", cell, low["min_x"], low["min_y"], max(1, parts // step), force)
    manifest = row.select(
        F.lit(path.rsplit("/", 1)[-1]).alias("originalFilename"), F.lit(files.size_of(path)).alias("sourceFileSizeBytes"), F.lit(sinks.publish_checksum(path, f"{out}/source.sha256")).alias("sourceSha256"), F.col("num_points").alias("pointCount"),
        F.struct(*row.columns).alias("summary"), F.lit(True).alias("rawFileMustNotBeModified"), F.lit("full").alias("fullCopy"), F.lit("preview").alias("previewCopy"), F.lit(step).cast("int").alias("previewDecimationStep"),
    )
    sinks.publish_json(manifest, f"{out}/source-info.json", force)
    return manifest
