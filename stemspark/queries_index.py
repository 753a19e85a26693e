"""Queries of the index build, of labels and of text formats, over orders, suppliers and customers as records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import labels
from .lineage import shared_folder
from .operators import sampling
from .plans import browse, index
from .plans.views import SCATTER_SQL, scatter_points, table
from .queries import _LIVE, _RECORDS, _picked, _records
from .registry import query, rounded, rounded_sql
from .sources import documents, sinks

_STATUSES = ("READY_FOR_FIELD_USE", "CHECK_ON_SITE", "NO_ESTIMATE", None)
#: Orders as whole records: columns that both engines compute alike; the others are null.
_FIELDS = {
    "record_index": "o_orderkey", "tree_id": "concat('TREE_', CAST(o_orderkey AS STRING))", "marking_url": "concat('/markings/', CAST(o_orderkey AS STRING), '.json')", "field_aid_status": _picked(_STATUSES, "o_orderkey"),
    "protocol_resolved": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 > 2 END", "operationally_excluded": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 4 END", "field_aid_circumference_cm": "CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice / 700 END",
    "fit_model": "CASE WHEN o_orderkey % 2 = 0 THEN 'CIRCLE' END", "field_aid_fit_model": "CASE WHEN o_orderkey % 3 = 0 THEN 'ELLIPSE' END", "point_count": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 END",
    "measurement_height_agl_m": "CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 1300) / 1000e0 END",
}
_K = "o_orderkey"
_CENTRE = f"({_K} % 17) / 7e0"
_RADIUS = f"({_K} % 23) / 130e0"


def _whole_records(spark, d):
    known = table(spark, d, "orders").selectExpr(*(f"{e.replace('//', 'div')} AS {c}" for c, e in _FIELDS.items()), "CASE WHEN o_orderkey % 8 = 0 THEN array('A', 'B') END AS qa_reason_codes")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], documents.RECORD).schema}
    return known.select(*known.columns, *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in known.columns))


def _markings(spark, d):
    """A marking of each order: planes, circles and ellipses, of which parts lack."""
    fit = f"named_struct('center', CASE WHEN {_K} % 4 > 0 THEN array({_CENTRE}, 1e0 / 3) END, 'radius_m', CASE WHEN {_K} % 4 > 1 THEN {_RADIUS} END, 'ellipse', named_struct('valid', {_K} % 4 = 3, 'center', array(2e0 / 3, 0e0), 'semi_major_axis_m', {_RADIUS} * 2, 'semi_minor_axis_m', {_RADIUS}, 'rotation_rad', 0.25e0))"
    plane = f"named_struct('center_xyz', array({_CENTRE}, 0e0, 1e0), 'basis_u', CASE WHEN {_K} % 10 > 0 THEN array(1e0, 0e0, 0e0) END, 'basis_v', array(0e0, 1e0, 0e0), 'axis_direction', CASE WHEN {_K} % 5 > 0 THEN array(0e0, 0e0, 2e0 / 3) END)"
    return table(spark, d, "orders").selectExpr(f"concat('markings/', CAST({_K} AS STRING), '.json') AS marking_path", f"CASE WHEN {_K} % 6 > 0 THEN {plane} END AS measurement_plane", f"CASE WHEN {_K} % 11 > 0 THEN {fit} END AS fit", f"CASE WHEN {_K} % 12 = 0 THEN {fit} END AS field_aid_fit", f"CASE WHEN {_K} % 13 = 0 THEN 'CIRCLE' END AS field_aid_fit_model")


_HAS_PLANE = f"({_K} % 6 > 0 AND {_K} % 10 > 0)"
_HAS_FIT = f"(({_K} % 11 > 0 OR {_K} % 12 = 0) AND {_K} % 4 > 0)"
_SHOWN = f"({_HAS_PLANE} AND {_HAS_FIT} AND {_K} % 9 > 0 AND NOT coalesce({_FIELDS['operationally_excluded']}, false) AND coalesce({_FIELDS['field_aid_status']} IN ('READY_FOR_FIELD_USE', 'CHECK_ON_SITE'), false))"


@query(
    "index_build",
    f"SELECT {_K} AS record_index, {_SHOWN} AS renderable, {rounded_sql(_FIELDS['field_aid_circumference_cm'], 2)} AS circumference, coalesce({_FIELDS['protocol_resolved']}, false) AS resolved, coalesce({_FIELDS['point_count']}, 0) AS point_count, coalesce(CASE WHEN {_K} % 13 = 0 THEN 'CIRCLE' END, {_FIELDS['field_aid_fit_model']}, {_FIELDS['fit_model']}) AS fit_model, CASE WHEN {_K} % 8 = 0 THEN 2 ELSE 0 END AS n_codes, {rounded_sql(_FIELDS['measurement_height_agl_m'], 3)} AS height, CASE WHEN {_HAS_PLANE} THEN {rounded_sql(_CENTRE)} END AS plane_x, CASE WHEN {_HAS_PLANE} THEN CASE WHEN {_K} % 5 > 0 THEN {rounded_sql('2e0 / 3')} ELSE 1 END END AS axis_z, CASE WHEN {_HAS_FIT} THEN {rounded_sql('1e0 / 3')} END AS fit_v, CASE WHEN {_HAS_FIT} AND {_K} % 4 > 1 THEN {rounded_sql(_RADIUS)} END AS radius, CASE WHEN {_HAS_FIT} AND {_K} % 4 = 3 THEN {rounded_sql(_RADIUS + ' * 2')} END AS major FROM orders",
)
def index_build(spark, d):
    """Records joined with their markings and compacted: rounding, missing parts, defaults, and what can be shown."""
    found = index.build(_whole_records(spark, d), _markings(spark, d))
    return found.select("record_index", "renderable", F.col("field_aid_circumference_cm").alias("circumference"), F.col("protocol_resolved").alias("resolved"), "point_count", "fit_model", F.size("qa_reason_codes").alias("n_codes"), F.col("measurement_height_agl_m").alias("height"), F.get("plane.center_xyz", F.lit(0)).alias("plane_x"), F.get("plane.axis_direction", F.lit(2)).alias("axis_z"), F.get("fit.center", F.lit(1)).alias("fit_v"), F.col("fit.radius_m").alias("radius"), F.col("fit.ellipse.semi_major_axis_m").alias("major"))


@query("index_summary", f"SELECT CAST(count(*) AS INT) AS record_count, CAST(count(*) FILTER (WHERE {_SHOWN}) AS INT) AS renderable_ring_count, CAST(count(*) FILTER (WHERE NOT {_SHOWN}) AS INT) AS marker_only_count FROM orders")
def index_summary(spark, d):
    return index.summary(index.build(_whole_records(spark, d), _markings(spark, d)))


_URL = f"CASE {_K} % 20 WHEN 0 THEN '' WHEN 1 THEN '/../x.json' WHEN 2 THEN '/markings/none.json' WHEN 3 THEN concat('/markings/more/../', CAST({_K} AS STRING), '.json') ELSE concat('//markings/./', CAST({_K} AS STRING), '.json') END"


@query("index_failures", f"SELECT {_K} AS record_index, {_FIELDS['tree_id']} AS tree_id, CASE {_K} % 20 WHEN 0 THEN 'no marking_url' WHEN 1 THEN 'unsafe marking path' WHEN 2 THEN 'no marking' ELSE 'several markings' END AS why FROM orders WHERE {_K} % 20 < 4")
def index_failures(spark, d):
    """All records without exactly one marking, by reason; paths with dots are resolved first."""
    records = _whole_records(spark, d).join(table(spark, d, "orders").selectExpr(f"{_K} AS record_index", f"{_URL} AS url"), "record_index").withColumn("marking_url", F.col("url")).drop("url")
    markings = _markings(spark, d)
    return index.failures(records, markings.unionByName(markings.where(F.regexp_extract("marking_path", "([0-9]+)", 1).cast("long") % 20 == 3)))


@query("json_documents", "SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, 'TREE_' || s_suppkey AS tree_id, s_suppkey % 3 > 0 AS renderable, s_suppkey % 7 / 2e0 AS plane_x FROM supplier")
def json_documents(spark, d):
    """Records with a byte-order mark and a file a marking, built into the published document, which is read again in file order."""
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    suppliers = table(spark, d, "supplier")
    sinks.publish_documents(suppliers.selectExpr("concat('markings/', s_suppkey, '.json') AS name", """to_json(named_struct('measurement_plane', named_struct('center_xyz', array(s_suppkey % 7 / 2D, 0D, 0D), 'basis_u', array(1D, 0D, 0D), 'basis_v', array(0D, 1D, 0D)), 'fit', named_struct('center', array(0D, 0D), 'radius_m', 0.1D), 'display_points_xyz', array(array(1D, 2D, 3D)))) AS json"""), folder)
    made = suppliers.selectExpr("s_suppkey", "named_struct('tree_id', concat('TREE_', s_suppkey), 'marking_url', concat('/markings/', s_suppkey, '.json'), 'field_aid_status', 'CHECK_ON_SITE', 'field_aid_circumference_cm', 10D, 'operationally_excluded', s_suppkey % 3 = 0) AS r")
    sinks.publish_json(made.agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "r"))), lambda x: x["r"]).alias("records")), f"{folder}/measurements.json", mark=True)
    index.publish(spark, f"{folder}/measurements.json", folder, f"{folder}/out")
    again = documents.read_document(spark, f"{folder}/out/viewer-index.json", "records ARRAY<STRUCT<tree_id: STRING, renderable: BOOLEAN, plane: STRUCT<center_xyz: ARRAY<DOUBLE>>>>")
    rows = again.select(F.posexplode("records").alias("place", "r"))
    return rows.select(F.substring_index("r.tree_id", "_", -1).cast("long").alias("key"), F.col("place").cast("long").alias("place"), "r.tree_id", "r.renderable", F.get("r.plane.center_xyz", F.lit(0)).alias("plane_x"))


@query("kpi_sums", f"WITH c AS (SELECT count(*) FILTER (WHERE acceptance_status = 'FINAL_LIDAR_ESTIMATE') AS a, count(*) FILTER (WHERE legacy_full_resolution_status = 'ACCEPTED') AS b, count(*) FILTER (WHERE legacy_full_resolution_status = 'ACCEPTED' AND {_LIVE}) AS c FROM ({_RECORDS})) SELECT b AS total, a + c AS listed, b - a - c AS rest FROM c")
def kpi_sums(spark, d):
    """Counts as sums and differences; one that is missing counts as zero."""
    accepted = labels.equals("legacy_full_resolution_status", "ACCEPTED")
    counts = _records(spark, d).agg(F.count_if(accepted).alias("accepted"), F.count_if(labels.equals("acceptance_status", "FINAL_LIDAR_ESTIMATE")).alias("final"), F.count_if(accepted & ~labels.yes("operationally_excluded")).alias("live"), F.lit(None).cast("long").alias("missing"))
    return browse.kpis(counts, "accepted", "final", "live", "missing")


@query("nested_extreme", "SELECT p_partkey AS k, greatest(p_size, abs(p_partkey % 31 - 40), p_partkey % 7 * 9) AS largest FROM part")
def nested_extreme(spark, d):
    k = F.col("p_partkey")
    points = F.array(F.array(F.col("p_size").cast("long"), k % 31 - 40), F.array(k % 7 * 9, F.lit(0).cast("long")))
    return table(spark, d, "part").select(k.alias("k"), browse.largest_coordinate(points).alias("largest"))


@query("display_values", "SELECT p_partkey AS k, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size END, p_partkey) AS points, CASE WHEN p_partkey % 5 > 0 THEN coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, p_size / 2e0) END AS diameter FROM part")
def display_values(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("k"), F.when(k % 3 == 0, F.col("p_size").cast("long")).alias("sourcePointCount"), k.alias("points"), F.when((k % 5 > 0) & (k % 2 == 0), F.col("p_retailprice")).alias("dbh"), F.when(k % 5 > 0, F.col("p_size") / 2).alias("diameter"))
    return rows.select("k", labels.shown("sourcePointCount", "points").alias("points"), labels.shown("dbh", "diameter").alias("diameter"))


@query("ground_points", f"WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END AS s, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size / 10e0 END, CASE WHEN p_partkey % 3 = 1 THEN p_size / 20e0 END, 1.3e0) AS h FROM part) SELECT k, {rounded_sql('k % 7 - s * 0.6e0 * s * h')} AS x, {rounded_sql('5 - s * 0.8e0 * s * h')} AS z FROM p")
def ground_points(spark, d):
    """From a centre down its axis, which may point down; the height is the first that is known."""
    k, s = F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, -1.0).otherwise(1.0)
    height = F.coalesce(F.when(k % 3 == 0, F.col("p_size") / 10), F.when(k % 3 == 1, F.col("p_size") / 20), F.lit(1.3))
    rows = table(spark, d, "part").select(k.alias("k"), F.array((k % 7).cast("double"), F.lit(2.0), F.lit(5.0)).alias("c"), F.array(s * 0.6, F.lit(0.0), s * 0.8).alias("a"), height.alias("h"))
    at = geo.ground_point(F.col("c"), F.col("a"), F.col("h"))
    return rows.select("k", rounded(at[0]).alias("x"), rounded(at[2]).alias("z"))


@query("number_formats", r"SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '(\.\d*?)0+$', '\1'), '\.$', '') AS grouped, format('{:,.0f}', floor(o_totalprice)) AS whole, CASE WHEN o_orderkey % 3 > 0 THEN format('{:.2f}', o_totalprice) ELSE '—' END AS fixed FROM orders")
def number_formats(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", labels.grouped_number(price, 2).alias("grouped"), labels.grouped_number(F.floor(price).cast("double"), 0).alias("whole"), labels.fixed(F.when(F.col("o_orderkey") % 3 > 0, price), 2).alias("fixed"))


_PATHS = ("/a/../b/./c.json", "/../x", "//m/n.json", "/a/b/../../..", "/m%20n/%2e%2e/o", "/bad%zz", "", "/..%2fx")


@query("links", "SELECT c_custkey, 'index.html?tree=' || replace(c_name, '#', '%23') AS link, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS tree, CASE c_custkey % 8 WHEN 0 THEN 'b/c.json' WHEN 2 THEN 'm/n.json' WHEN 4 THEN 'o' END AS path FROM customer")
def links(spark, d):
    """Keys in links and back, broken escapes as null, and paths of which none may climb out."""
    k = F.col("c_custkey")
    path = F.element_at(F.array(*(F.lit(p) for p in _PATHS)), (k % 8).cast("int") + 1)
    rows = table(spark, d, "customer").select(k, labels.query_link("index.html", "c_name").alias("link"), path.alias("p"))
    tree = labels.link_tree(F.when(k % 4 > 0, F.concat(F.lit("https://host/"), "link")).otherwise("https://host/?tree=%"))
    return rows.select("c_custkey", "link", tree.alias("tree"), labels.decoded_path("p").alias("path"))


@query("utc_stamps", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def utc_stamps(spark, d):
    """The events' times are UTC without a zone: as instants of the session, whatever its zone, and back."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    return table(spark, d, "events").select("event_id", labels.utc_stamp(instant).alias("stamp"))


_ADAPTIVE = "(coalesce(measurement_kind = 'PROP_ROOT_PLUS_030', false) OR coalesce(legacy_measurement_rule = 'ADAPTIVE_IRREGULAR_ZONE_PLUS_030', false))"


@query(
    "list_classes",
    f"SELECT record_index, CASE WHEN field_aid_status = 'EXCLUDED_CONFIRMED_WRONG' THEN 'fail' WHEN field_aid_source = 'LEGACY_FULL_RESOLUTION_ACCEPTED' THEN 'legacy' WHEN field_aid_status = 'READY_FOR_FIELD_USE' THEN 'final' WHEN field_aid_status = 'NO_ESTIMATE' THEN 'fail' ELSE '' END AS dot, CASE WHEN field_aid_status = 'READY_FOR_FIELD_USE' THEN '' WHEN field_aid_status = 'CHECK_ON_SITE' THEN 'provisional' ELSE 'review' END AS badge, {_ADAPTIVE} AS adaptive, CASE WHEN field_aid_dbh_cm IS NOT NULL THEN 'DBH estimate' WHEN {_ADAPTIVE} THEN 'เส้นผ่านศูนย์กลาง ณ +0.30' ELSE 'เส้นผ่านศูนย์กลาง ณ ระนาบ' END AS label, CASE WHEN field_aid_dbh_cm IS NOT NULL THEN 'วัดที่ 1.30 ม.' WHEN {_ADAPTIVE} THEN 'ไม่ใช่ DBH ที่ 1.30 ม.' ELSE 'เส้นผ่านศูนย์กลางที่ระนาบ marking' END AS note FROM ({_RECORDS})",
)
def list_classes(spark, d):
    return _records(spark, d).select("record_index", labels.dot_class().alias("dot"), labels.badge_class().alias("badge"), labels.is_adaptive().alias("adaptive"), labels.diameter_label().alias("label"), labels.diameter_note().alias("note"))


@query("render_budgets", "SELECT p_partkey AS k, greatest(1, CAST(ceil(p_partkey * 997 / 250000e0) AS BIGINT)) AS step_250000, greatest(1, CAST(ceil(p_partkey * 997 / 500000e0) AS BIGINT)) AS step_500000, greatest(1, CAST(ceil(p_partkey * 997 / 1000000e0) AS BIGINT)) AS step_1000000 FROM part")
def render_budgets(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *browse.budget_steps(F.col("p_partkey") * 997))


@query("budget_sample", "SELECT event_id FROM events WHERE event_id % CAST(ceil((SELECT count(*) FROM events) / 700e0) AS BIGINT) = 0")
def budget_sample(spark, d):
    e = table(spark, d, "events").select("event_id")
    return sampling.budget_sample(e, e.count(), 700, "event_id")


@query("painter_order", f"SELECT point_index, row_number() OVER (ORDER BY y, point_index) AS place FROM ({SCATTER_SQL})")
def painter_order(spark, d):
    """The drawing order as places, seen straight on: far points first, of equally far ones the first by index."""
    p = scatter_points(spark, d).withColumnRenamed("hag", "z")
    return sampling.numbered(browse.painter_order(p, 0.0, 0.0).select("point_index", "depth"), ["depth", "point_index"], "place").select("point_index", "place")


@query("front_most_hits", "SELECT l_partkey AS ray, arg_min('T' || l_suppkey, (l_quantity, 'T' || l_suppkey)) AS tree_id FROM lineitem WHERE l_linenumber % 3 > 0 GROUP BY l_partkey")
def front_most_hits(spark, d):
    """Lines of an order as hits of a part's ray."""
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ray"), F.col("l_quantity").alias("distance"), F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("tree_id"), (F.col("l_linenumber") % 3 > 0).alias("visible"))
    return browse.front_most(hits)


@query("pixel_scale", f"SELECT p_partkey AS k, {rounded_sql('greatest(p_size / 10e0, 0.5e0) * 2 * tan(radians(25e0)) / 900 * 120')} AS width FROM part")
def pixel_scale(spark, d):
    """How wide a label of 120 pixels is at its distance."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), rounded(geo.world_per_pixel(F.col("p_size") / 10, 0.5, 50.0, 900) * 120).alias("width"))
