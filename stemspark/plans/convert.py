"""From a LAS file to a viewer's sample: stride, decode, recentre, colours, chunks, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clouds import sampled_cloud
from ..sources import sinks
from ..sources.las import read_las, total_points


def sample_las(spark: SparkSession, path: str, max_points: int = 1_000_000) -> tuple[DataFrame, dict]:
    """The recentred sample and what its metadata says of the source."""
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    n = total_points(path)
    step = max(1, -(-n // max_points))
    points = sampled_cloud(read_las(spark, path, step=step))
    return points.withColumn("sample_index", F.floor(F.col("point_index") / step)), {"source": path.rsplit("/", 1)[-1], "sourcePointCount": n, "samplingStride": step, "points": -(-n // step)}


def metadata(points: DataFrame, facts: dict, name: str, description: str, projection: str) -> DataFrame:
    """The one-row description of the sample's buffers."""
    box = points.agg(*(f(c).cast("double").alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"))
    low, high = (F.array(*(F.col(f"{n}_{c}") for c in "xyz")) for n in ("lo", "hi"))
    n = facts["points"]
    view = lambda uri, size: F.struct(F.lit(uri).alias("uri"), F.lit(n * size).cast("long").alias("byteLength"), F.lit(0).cast("long").alias("byteOffset"))
    kind = lambda name, t, k, each: (F.lit(name).alias("name"), F.lit(t).alias("type"), F.lit(k).alias("numElements"), F.lit(each).alias("elementSize"), F.lit(k * each).alias("size"))
    none = F.lit(None).cast("array<double>")
    colour = F.struct(*kind("rgba", "uint8", 4, 1), view("colors.glbin", 4).alias("bufferView"), none.alias("min"), none.alias("max"))
    position = F.struct(*kind("position", "float", 3, 4), view("positions-00.glbin", 12).alias("bufferView"), low.alias("min"), high.alias("max"))
    constants = {"name": name, "description": description, "source": facts["source"], "sourcePointCount": facts["sourcePointCount"], "samplingStride": facts["samplingStride"], "points": n, "projection": projection}
    return box.select(*(F.lit(v).alias(k) for k, v in constants.items()), F.array(*[F.lit(0)] * 3).alias("offset"), F.array(*[F.lit(1)] * 3).alias("scale"), F.struct(low.alias("min"), high.alias("max")).alias("boundingBox"), F.array(colour, position).alias("attributes"))


def convert(spark: SparkSession, path: str, out: str, max_points: int = 1_000_000, name: str = "Point cloud", buffers: bool = False) -> DataFrame:
    """Writes the sample as Parquet by chunk and metadata.json; buffers: the headerless files a browser reads, too. Returns the sample."""
    points, facts = sample_las(spark, path, max_points)
    chunked = points.withColumn("chunk", sinks.chunk_of("sample_index", facts["points"]))
    chunked.write.mode("overwrite").partitionBy("chunk").parquet(f"{out}/points")
    done = spark.read.parquet(f"{out}/points")
    sinks.publish_json(metadata(done, facts, name, "Sampled coloured points.", "LAS source coordinates, recentred for viewing"), f"{out}/metadata.json")
    if buffers:
        from ..sources.buffers import write_buffers

        write_buffers(done, out)
    return done
