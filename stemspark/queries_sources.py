"""Queries that write files to the shared folder and read them back: point records, buffers, metadata, tables, notes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .lineage import shared_folder
from .operators import clouds, joins, sampling
from .plans import archive, convert, notes
from .plans.views import scatter_points, table
from .queries import _OWNERS, _owners, grid
from .registry import query, rounded, rounded_sql
from .sources import buffers, documents, files, las, sinks

SCALE, OFFSET = (0.001, 0.001, 0.001), (5.0, -25.0, 0.0)
_RAW = {"raw_x": "event_id * 7919 % 40000", "raw_y": "event_id * 104729 % 30000", "raw_z": "event_id * 31337 % 2400", "r": "event_id * 7 % 900", "g": "event_id * 11 % 256", "b": "user_id % 256"}
_POINTS = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS point_index, raw_x * 0.001e0 + 5e0 AS x, raw_y * 0.001e0 + -25e0 AS y, raw_z * 0.001e0 + 0e0 AS z, r, g, b FROM (SELECT event_id, " + ", ".join(f"CAST({e} AS INT) AS {c}" for c, e in _RAW.items()) + " FROM events)"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _las(spark, d) -> str:
    """Events as LAS files in event order."""
    folder = _folder(spark, "las")
    raw = table(spark, d, "events").selectExpr("event_id", *(f"cast({e} as int) AS {c}" for c, e in _RAW.items()))
    las.write_las_folder(raw, folder, "event_id", SCALE, OFFSET)
    return folder


@query("las_round_trip", f"SELECT point_index, x, y, z, r, g, b FROM ({_POINTS})")
def las_round_trip(spark, d):
    """Records of several files in name order: header, validation, scan and decoding."""
    return las.read_las(spark, _las(spark, d), partition_rows=10_000).select("point_index", "x", "y", "z", "r", "g", "b")


@query("las_window", f"SELECT point_index, z FROM ({_POINTS}) WHERE x >= 10 AND x < 30 AND y < -5 AND point_index >= 100 AND point_index % 3 = 0")
def las_window(spark, d):
    """Filters of the query reach the reader; the stride is its option, and only two fields are decoded."""
    return las.read_las(spark, _las(spark, d), ["point_index", "x", "y", "z"], step=3, partition_rows=5_000).where("x >= 10 AND x < 30 AND y < -5 AND point_index >= 100").select("point_index", "z")


@query("las_alignment", f"SELECT point_index, {rounded_sql('x', 3)} AS x, {rounded_sql('y', 3)} AS y, {rounded_sql('z', 3)} AS z FROM ({_POINTS})")
def las_alignment(spark, d):
    """A recentred preview put back where the full cloud is, by the first point of both."""
    full = las.read_las(spark, _las(spark, d), ["point_index", "x", "y", "z"])
    return clouds.aligned(clouds.recentred(full), full).select("point_index", *(rounded(c, 3).alias(c) for c in "xyz"))


_SAMPLE = f"s AS (SELECT * FROM ({_POINTS}) WHERE point_index % CAST(ceil((SELECT count(*) FROM events) / 500e0) AS BIGINT) = 0), m AS (SELECT (min(x) + max(x)) / 2 AS x0, (min(y) + max(y)) / 2 AS y0, (min(z) + max(z)) / 2 AS z0, max(greatest(r, g, b)) > 255 AS wide FROM s), c AS (SELECT row_number() OVER (ORDER BY point_index) - 1 AS place, CAST(x - x0 AS FLOAT) AS x, CAST(y - y0 AS FLOAT) AS y, CAST(z - z0 AS FLOAT) AS z, CASE WHEN wide THEN r >> 8 ELSE r END AS r, CASE WHEN wide THEN g >> 8 ELSE g END AS g, CASE WHEN wide THEN b >> 8 ELSE b END AS b FROM s, m)"


@query("buffer_round_trip", f"WITH {_SAMPLE} SELECT place AS point_index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, r, g, b FROM c")
def buffer_round_trip(spark, d):
    """A conversion's position chunks and colours, read again in name order."""
    out = _folder(spark, "buffers")
    convert.convert(spark, _las(spark, d), out, 500, buffers=True)
    return buffers.read_cloud(spark, f"{out}/positions-*.glbin", f"{out}/colors.glbin").select("point_index", "x", "y", "z", "r", "g", "b")


@query("conversion_metadata", f"WITH {_SAMPLE} SELECT (SELECT count(*) FROM events) AS source_points, count(*) AS points, CAST(ceil((SELECT count(*) FROM events) / 500e0) AS INT) AS stride, count(*) * 16 AS n_bytes, count(*) * 12 AS position_bytes, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(z) AS DOUBLE) AS max_z FROM c")
def conversion_metadata(spark, d):
    """metadata.json of a conversion: what it says of the source, the position attribute by name, and the bytes of all buffers."""
    out = _folder(spark, "converted")
    convert.convert(spark, _las(spark, d), out, 500)
    found = documents.read_document(spark, f"{out}/metadata.json", documents.METADATA)
    position = documents.attribute(found, "position").select(F.col("bufferView.byteLength").alias("position_bytes"), F.get("min", F.lit(0)).alias("min_x"), F.get("max", F.lit(2)).alias("max_z"))
    facts = found.select(F.col("sourcePointCount").alias("source_points"), "points", F.col("samplingStride").alias("stride"), "source").join(documents.total_bytes(found), "source").drop("source")
    return facts.crossJoin(F.broadcast(position))  # one row each


@query("chunked_points", f"WITH {_SAMPLE} SELECT CAST(place // greatest(1, CAST(ceil((SELECT count(*) FROM c) / 3e0) AS BIGINT)) AS INT) AS chunk, count(*) AS n, min(place) AS first FROM c GROUP BY 1")
def chunked_points(spark, d):
    done = convert.convert(spark, _las(spark, d), _folder(spark, "chunks"), 500)
    return done.groupBy(F.col("chunk").cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.min("sample_index").alias("first"))


@query("archive_manifest", "SELECT count(*) AS points, CAST(ceil(count(*) / 40e0) AS INT) AS step, count(*) AS full_points, CAST(ceil(count(*) / ceil(count(*) / 40e0)) AS BIGINT) AS preview_points, true AS same_digest, 2 AS point_format, 1.0e0 AS n_min_z FROM supplier")
def archive_manifest(spark, d):
    """The archive run over one file: discovery, summary, copies in spatial order, checksum and manifest."""
    folder, out = _folder(spark, "raw"), _folder(spark, "archive")
    k = "s_suppkey"
    raw = table(spark, d, "supplier").selectExpr(k, f"cast({k} * 37 % 4000 as int) AS raw_x", f"cast({k} * 101 % 3000 as int) AS raw_y", "1000 AS raw_z", "1 AS r", "2 AS g", "3 AS b")
    las.write_las_folder(raw, folder, k, SCALE, (0.0, 0.0, 0.0), parts=1)
    path = archive.discover(folder)
    archive.archive(spark, path, out, preview_points=40, least_free=0)
    info = documents.read_document(spark, f"{out}/source-info.json", "pointCount BIGINT, previewDecimationStep INT, sourceSha256 STRING, summary STRUCT<point_format: INT, min_z: DOUBLE>")
    sizes = [spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias(f"{name}_points")) for name in ("full", "preview")]
    written = spark.read.text(f"{out}/source.sha256").select(F.substring_index("value", " ", 1).alias("digest"))
    rows = info.crossJoin(F.broadcast(sizes[0])).crossJoin(F.broadcast(sizes[1])).crossJoin(F.broadcast(written))  # one row each
    return rows.select(F.col("pointCount").alias("points"), F.col("previewDecimationStep").alias("step"), "full_points", "preview_points", (F.col("digest") == F.col("sourceSha256")).alias("same_digest"), F.col("summary.point_format").alias("point_format"), F.col("summary.min_z").alias("n_min_z"))


_CODE = "list_sum(list_transform(range(16), lambda i: (((CAST(floor((x - 5) / 0.5e0) AS BIGINT) >> i) & 1) << (2 * i)) + (((CAST(floor((y + 25) / 0.5e0) AS BIGINT) >> i) & 1) << (2 * i + 1))))"


@query("spatial_order", f"SELECT point_index, CAST({_CODE} AS BIGINT) AS cell_code FROM (SELECT event_id AS point_index, 5 + ((event_id * 7919) % 40000) / 1000 AS x, -25 + ((event_id * 104729) % 30000) / 1000 AS y FROM events)")
def spatial_order(spark, d):
    """Points published by the interleaved bits of their cells."""
    out = _folder(spark, "spatial")
    sinks.publish_spatial(scatter_points(spark, d), out, 0.5, 5.0, -25.0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.parquet(out).select("point_index", "cell_code")


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def csv_round_trip(spark, d):
    out = _folder(spark, "csv")
    sinks.publish_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment")), out)
    return spark.read.option("header", True).schema("c_custkey long, c_name string, c_acctbal double, segment string").csv(out)


@query("checksums", "SELECT n_name, sha256(n_name || chr(10)) AS digest FROM nation")
def checksums(spark, d):
    """Digests of files, read block by block, and beside each file its published one."""
    folder, rows = _folder(spark, "sums"), []
    for r in table(spark, d, "nation").select("n_name").collect():  # the nations are a fixed table
        path = f"{folder}/{r['n_name'].replace(' ', '_')}.txt"
        sinks.publish_text(r["n_name"] + "\n", path)
        digest = sinks.publish_checksum(path)
        kept = files.read_range(path + ".sha256", 0, 64).decode()
        rows.append((r["n_name"], digest if digest == kept else None))
    return spark.createDataFrame(rows, "n_name string, digest string")


@query("publish_once", "SELECT 'kept' AS what, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'forced', count(*) FROM orders")
def publish_once(spark, d):
    """What is published stays; force replaces it."""
    out, orders = _folder(spark, "once"), table(spark, d, "orders").select("o_orderkey")
    sinks.publish(orders.where("o_orderkey % 2 = 0"), f"{out}/kept")
    sinks.publish(orders, f"{out}/kept")
    sinks.publish(orders.where("o_orderkey % 2 = 0"), f"{out}/forced")
    sinks.publish(orders, f"{out}/forced", force=True)
    return spark.read.parquet(f"{out}/kept").agg(F.lit("kept").alias("what"), F.count("*").alias("n")).unionByName(spark.read.parquet(f"{out}/forced").agg(F.lit("forced").alias("what"), F.count("*").alias("n")))


@query("notes_append", "WITH n AS (SELECT row_number() OVER (ORDER BY r_name) AS id, r_name AS title, '' AS content FROM region UNION ALL SELECT (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_name), n_name, 'in region ' || n_regionkey FROM nation) SELECT * FROM n ORDER BY id DESC LIMIT 20")
def notes_append(spark, d):
    """Two appends, trimmed and numbered on, and the newest twenty."""
    path = _folder(spark, "notes")
    notes.append(spark, path, table(spark, d, "region").select(F.concat(F.lit(" "), "r_name", F.lit("  ")).alias("title"), F.lit(None).cast("string").alias("content")))
    notes.append(spark, path, table(spark, d, "nation").select(F.col("n_name").alias("title"), F.concat(F.lit(" in region "), F.col("n_regionkey").cast("string")).alias("content")))
    return notes.newest(spark.read.schema(notes.SCHEMA).parquet(path)).select("id", "title", "content")


@query("unique_owners", f"WITH o AS ({_OWNERS}), p AS (SELECT CAST(trunc(((event_id * 7919) % 40000) / 1000) AS INT) AS jx, CAST(trunc(((event_id * 104729) % 30000) / 1000) AS INT) AS jy FROM events) SELECT DISTINCT owner FROM p JOIN o ON o.ix = jx AND o.iy = jy")
def unique_owners(spark, d):
    points = grid.in_window(scatter_points(spark, d)).select(F.floor(F.col("x") - 5).cast("int").alias("ix"), F.floor(F.col("y") + 25).cast("int").alias("iy"))
    return joins.unique_owners(joins.owned_points(points, _owners(spark, d)))


@query("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def row_numbers(spark, d):
    """Places in a total order without a task that sees all rows."""
    return sampling.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "place").select("o_orderkey", "place")
