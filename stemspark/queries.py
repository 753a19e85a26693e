"""Queries over the driver's tables, one for each family of operators, and the SQL that gives the same rows.

Doubles that pass through trigonometry, sums or percentiles are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import labels
from .operators import clouds, fits, grid, joins, nms, sampling, vectors
from .plans import browse, detect, index, notes, views
from .plans.views import SCATTER_SQL, STEM_SQL, scatter_points, stem_points, table
from .registry import ORACLE, QUERIES, query, rounded, rounded_sql
from .sources import documents

BANDS = ((0.3, 0.7), (0.7, 1.1), (1.1, 1.5), (1.5, 1.9), (1.9, 2.3))
_BAND = "CASE " + " ".join(f"WHEN hag >= {a}e0 AND hag < {b}e0 THEN {i}" for i, (a, b) in enumerate(BANDS)) + " END"
_GRID = f"p AS (SELECT * FROM ({SCATTER_SQL}) WHERE x >= 5 AND x < 45 AND y >= -25 AND y < 5), b AS (SELECT CAST(floor((y + 25) / 4e0) AS INT) AS iy, CAST(floor((x - 5) / 4e0) AS INT) AS ix, {_BAND} AS band FROM p)"
_XY = {c: views.SCATTER[c] for c in "xy"}


@query("density_peaks", f"WITH {_GRID}, c AS (SELECT iy, ix, band, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL), s AS (SELECT iy, ix, min(n) AS score FROM c GROUP BY ALL HAVING count(*) = 5), t AS (SELECT quantile_cont(score, 0.75) AS cut FROM s) SELECT iy, ix, score FROM s, t WHERE score >= cut")
def density_peaks(spark, d):
    cells = grid.band_minimum(grid.band_histogram(scatter_points(spark, d), BANDS, 4.0), len(BANDS))
    threshold = cells.agg(F.percentile("score", F.lit(0.75)).alias("cut"))
    return cells.crossJoin(F.broadcast(threshold)).where("score >= cut").select("iy", "ix", "score")


@query("band_histogram_zero_filled", f"WITH {_GRID}, s AS (SELECT CAST(k.range // 80 AS INT) AS band, CAST(k.range // 10 % 8 AS INT) AS iy, CAST(k.range % 10 AS INT) AS ix FROM range(400) k) SELECT s.band, s.iy, s.ix, count(b.band) AS n FROM s LEFT JOIN b ON s.band = b.band AND s.iy = b.iy AND s.ix = b.ix GROUP BY ALL")
def band_histogram_zero_filled(spark, d):
    return grid.zero_filled(grid.band_histogram(scatter_points(spark, d), BANDS, 4.0), 5, 8, 10)


_KERNEL = "k AS (SELECT range - 5 AS o, exp(-((range - 5) * (range - 5)) / (2 * 1.2e0 * 1.2e0)) AS raw FROM range(11)), w AS (SELECT o, raw / (SELECT sum(raw) FROM k) AS w FROM k)"


def _mirror(axis: str, n: int) -> str:
    j = f"(({axis} + o) % {2 * n} + {2 * n}) % {2 * n}"
    return f"CASE WHEN {j} >= {n} THEN {2 * n - 1} - {j} ELSE {j} END"


_SMOOTH = f"WITH {_GRID}, h AS (SELECT band, iy, ix, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL), {_KERNEL}, s AS (SELECT range // 10 AS iy, range % 10 AS ix FROM range(80)), f AS (SELECT q.band, s.iy, s.ix, coalesce(n, 0) AS v FROM (SELECT DISTINCT band FROM h) q CROSS JOIN s LEFT JOIN h ON h.band = q.band AND h.iy = s.iy AND h.ix = s.ix), a AS (SELECT f.band, f.iy, f.ix, sum(g.v * w) AS v FROM f CROSS JOIN w JOIN f g ON g.band = f.band AND g.iy = f.iy AND g.ix = {_mirror('f.ix', 10)} GROUP BY ALL), c AS (SELECT a.band, a.iy, a.ix, sum(g.v * w) AS v FROM a CROSS JOIN w JOIN a g ON g.band = a.band AND g.ix = a.ix AND g.iy = {_mirror('a.iy', 8)} GROUP BY ALL)"


@query(
    "gaussian_smoothing",
    f"{_SMOOTH} SELECT band, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, {rounded_sql('v')} AS v FROM c",
)
def gaussian_smoothing(spark, d):
    counts = grid.band_histogram(scatter_points(spark, d), BANDS, 4.0)
    return grid.smoothed(counts, 8, 10).select("band", "iy", "ix", rounded("v").alias("v"))


@query("score_raster", f"{_SMOOTH}, z AS (SELECT iy, ix, min(v) AS score FROM c GROUP BY iy, ix HAVING count(*) = 5 AND min(v) > 0), t AS (SELECT quantile_cont(score, 0.99) AS top FROM z) SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, {rounded_sql("least(score, top)")} AS score FROM z, t")
def score_raster(spark, d):
    """The cells of the diagnostic picture."""
    points = scatter_points(spark, d).withColumn("z", F.col("hag") - 0.0)
    return detect.score_raster(points, 0.0, 4.0).select("iy", "ix", rounded("score").alias("score"))


@query("local_maxima", f"WITH {_GRID}, s AS (SELECT iy, ix, count(*) * 1000 + iy * 10 + ix AS score FROM b GROUP BY iy, ix) SELECT s.iy, s.ix, s.score FROM s JOIN s t ON abs(t.iy - s.iy) <= 1 AND abs(t.ix - s.ix) <= 1 GROUP BY s.iy, s.ix, s.score HAVING s.score = max(t.score)")
def local_maxima(spark, d):
    """Without ties, which recursion alone could settle in SQL; tests cover those."""
    cells = grid.in_window(scatter_points(spark, d)).select(grid.cell("y", grid.Y_MIN, 4.0).alias("iy"), grid.cell("x", grid.X_MIN, 4.0).alias("ix")).groupBy("iy", "ix").agg(F.count("*").alias("n"))
    return grid.local_maxima(cells.select("iy", "ix", (F.col("n") * 1000 + F.col("iy") * 10 + F.col("ix")).alias("score")), 1)


@query("tied_maxima", "SELECT CAST(n_nationkey * 12 AS INT) AS iy, 0 AS ix, 5e0 AS score FROM nation UNION ALL SELECT CAST(n_nationkey * 12 AS INT), 3, 5e0 FROM nation")
def tied_maxima(spark, d):
    """Rows of five equal cells, all with one score: a greedy pass keeps the first and the fourth."""
    rows = table(spark, d, "nation").select((F.col("n_nationkey") * 12).cast("int").alias("iy"), F.explode(F.expr("sequence(0, 4)")).alias("ix"), F.lit(5.0).alias("score"))
    return grid.local_maxima(rows, 2)


@query("stride_sample", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 23 = 0")
def stride_sample(spark, d):
    return sampling.stride_sample(table(spark, d, "orders"), 23, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("stride_in_groups", "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, event_id FROM n WHERE rn % CAST(ceil(c / 20e0) AS BIGINT) = 0")
def stride_in_groups(spark, d):
    return sampling.stride_in_groups(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], 20, "event_id")


@query("bbox_footprint", f"SELECT max(x) - min(x) AS width, max(y) - min(y) AS depth, max(hag) - min(hag) AS height, count(*) AS n_points FROM ({SCATTER_SQL})")
def bbox_footprint(spark, d):
    box = clouds.extent(scatter_points(spark, d), ("x", "y", "hag"))
    return box.select((F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("depth"), (F.col("max_hag") - F.col("min_hag")).alias("height"), "n_points")


@query("recentre_cloud", f"WITH p AS ({SCATTER_SQL}), c AS (SELECT (min(x) + max(x)) / 2 AS x0, (min(y) + max(y)) / 2 AS y0, (min(hag) + max(hag)) / 2 AS z0 FROM p) SELECT point_index, CAST(x - x0 AS FLOAT) AS x, CAST(y - y0 AS FLOAT) AS y, CAST(hag - z0 AS FLOAT) AS z FROM p, c")
def recentre_cloud(spark, d):
    return clouds.recentred(scatter_points(spark, d).withColumnRenamed("hag", "z")).select("point_index", "x", "y", "z")


@query("bounding_sphere", f"WITH p AS ({SCATTER_SQL}), c AS (SELECT (min(x) + max(x)) / 2 AS centre_x, (min(y) + max(y)) / 2 AS centre_y, (min(hag) + max(hag)) / 2 AS centre_z FROM p) SELECT centre_x, centre_y, centre_z, {rounded_sql('max(sqrt((x - centre_x) ** 2 + (y - centre_y) ** 2 + (hag - centre_z) ** 2))')} AS radius FROM p, c GROUP BY ALL")
def bounding_sphere(spark, d):
    return clouds.bounding_sphere(scatter_points(spark, d).withColumnRenamed("hag", "z")).withColumn("radius", rounded("radius"))


_RGB = "SELECT event_id, CAST(event_id * 7 % 900 AS INT) AS r, CAST(event_id * 11 % 256 AS INT) AS g, CAST(user_id % 256 AS INT) AS b FROM events"


@query("colour_shift", f"WITH p AS ({_RGB}), m AS (SELECT max(greatest(r, g, b)) AS most FROM p) SELECT event_id, CASE WHEN most > 255 THEN r >> 8 ELSE r END AS r, CASE WHEN most > 255 THEN g >> 8 ELSE g END AS g, CASE WHEN most > 255 THEN b >> 8 ELSE b END AS b FROM p, m")
def colour_shift(spark, d):
    rgb = table(spark, d, "events").selectExpr("event_id", "cast(event_id * 7 % 900 as int) AS r", "cast(event_id * 11 % 256 as int) AS g", "cast(user_id % 256 as int) AS b")
    return clouds.shifted_colours(rgb)


@query("affine_decode", f"SELECT event_id, {rounded_sql('(event_id % 100000) * 0.001e0 + 12.5e0')} AS x, CAST(trunc(((event_id % 100000) * 0.001e0 + 12.5e0) / 0.25e0) AS INT) AS ix, greatest(0, least(39, CAST(trunc(((event_id % 100000) * 0.001e0 + 12.5e0) / 0.25e0) AS INT))) AS clipped FROM events")
def affine_decode(spark, d):
    x = geo.affine(F.col("event_id") % 100000, 0.001, 12.5)
    return table(spark, d, "events").select("event_id", rounded(x).alias("x"), geo.cell_index(x, 0.0, 0.25).alias("ix"), geo.cell_index(x, 0.0, 0.25, 40).alias("clipped"))


_SEEDS = "SELECT DISTINCT user_id AS seed_id, 5 + ((user_id * 7919) % 400) / 10 AS seed_x, -25 + ((user_id * 104729) % 300) / 10 AS seed_y FROM events"


def _seeds(spark, d):
    return table(spark, d, "events").selectExpr("user_id AS seed_id", "5 + ((user_id * 7919) % 400) / 10 AS seed_x", "-25 + ((user_id * 104729) % 300) / 10 AS seed_y").distinct()


@query("radius_join", f"SELECT seed_id, point_index FROM ({_SEEDS}) s JOIN ({SCATTER_SQL}) p ON (x - seed_x) * (x - seed_x) + (y - seed_y) * (y - seed_y) <= 0.95e0 * 0.95e0")
def radius_join(spark, d):
    return joins.radius_join(_seeds(spark, d), scatter_points(spark, d), 0.95).select("seed_id", "point_index")


_CELLS = "SELECT CAST(range // 40 AS INT) AS iy, CAST(range % 40 AS INT) AS ix, 5 + (range % 40 + 0.5e0) * 1e0 AS cell_x, -25 + (range // 40 + 0.5e0) * 1e0 AS cell_y FROM range(1200)"
_OWNERS = f"SELECT iy, ix, arg_min(seed_id, (d2, seed_id)) AS owner, {rounded_sql('sqrt(min(d2))')} AS distance FROM (SELECT c.*, seed_id, (cell_x - seed_x) ** 2 + (cell_y - seed_y) ** 2 AS d2 FROM ({_CELLS}) c, ({_SEEDS}) s) WHERE d2 <= 2.25e0 GROUP BY iy, ix"


def _owners(spark, d):
    cells = spark.range(1200).selectExpr("cast(id div 40 as int) AS iy", "cast(id % 40 as int) AS ix").withColumns({"cell_x": geo.cell_centre("ix", 5.0, 1.0), "cell_y": geo.cell_centre("iy", -25.0, 1.0)})
    return joins.nearest_owner(cells, _seeds(spark, d), reach=1.5)


@query("nearest_owner", _OWNERS)
def nearest_owner(spark, d):
    return _owners(spark, d).withColumn("distance", rounded("distance"))


@query("cell_owner_join", f"WITH o AS ({_OWNERS}), p AS ({SCATTER_SQL}), q AS (SELECT *, CAST(trunc(x - 5) AS INT) AS jx, CAST(trunc(y + 25) AS INT) AS jy FROM p) SELECT owner, point_index FROM q JOIN o ON o.ix = jx AND o.iy = jy JOIN ({_SEEDS}) s ON seed_id = owner WHERE (x - seed_x) * (x - seed_x) + (y - seed_y) * (y - seed_y) <= 0.45e0 * 0.45e0 AND hag BETWEEN 0.55e0 AND 2.05e0")
def cell_owner_join(spark, d):
    points = grid.in_window(scatter_points(spark, d)).withColumns({"ix": geo.cell_index("x", 5.0, 1.0, 40), "iy": geo.cell_index("y", -25.0, 1.0, 30)})
    owned = joins.owned_points(points, _owners(spark, d)).join(_seeds(spark, d).withColumnRenamed("seed_id", "owner"), "owner")
    dx, dy = F.col("x") - F.col("seed_x"), F.col("y") - F.col("seed_y")
    return owned.where((dx * dx + dy * dy <= 0.45 * 0.45) & F.col("hag").between(0.55, 2.05)).select("owner", "point_index")


@query("neighbourhood_stats", f"SELECT seed_id, count(*) AS n, {rounded_sql('greatest(-6.93e0, least(-6.23e0, quantile_cont(hag - 6.68e0, 0.025)))')} AS ground, {rounded_sql('max(hag) - min(hag)')} AS z_range FROM ({_SEEDS}) s JOIN ({SCATTER_SQL}) p ON (x - seed_x) * (x - seed_x) + (y - seed_y) * (y - seed_y) <= 0.95e0 * 0.95e0 GROUP BY seed_id HAVING count(*) >= 20")
def neighbourhood_stats(spark, d):
    near = joins.radius_join(_seeds(spark, d), scatter_points(spark, d).withColumn("z", F.col("hag") - 6.68), 0.95)
    return near.groupBy("seed_id").agg(F.count("*").alias("n"), rounded(clouds.local_ground()).alias("ground"), rounded(F.max("hag") - F.min("hag")).alias("z_range")).where("n >= 20")


_STEM_XY = f"SELECT *, cx + r * cos(angle) AS x, cy + r * sin(angle) AS y FROM ({STEM_SQL})"


def _stem_xy(spark, d):
    return stem_points(spark, d).withColumns({"x": F.col("cx") + F.col("r") * F.cos("angle"), "y": F.col("cy") + F.col("r") * F.sin("angle")})


_BIN = "greatest(0, least(23, CAST(floor((angle + 0.001e0) / (2 * pi()) * 24) AS INT)))"


@query("angular_coverage", f"SELECT stem_id, count(DISTINCT {_BIN}) / 24e0 AS coverage, count(*) AS n FROM ({STEM_SQL}) GROUP BY stem_id")
def angular_coverage(spark, d):
    # a hair beyond the bins' edges, on which the derived angles fall
    turned = stem_points(spark, d).withColumn("a", F.col("angle") + 0.001)
    return turned.groupBy("stem_id").agg(fits.coverage(geo.angular_bin(-F.sin("a"), -F.cos("a"))).alias("coverage"), F.count("*").alias("n"))


_NOISY = f"SELECT stem_id, x + (point_index % 11 - 5) / 2000e0 AS x, y + (point_index % 13 - 6) / 2000e0 AS y FROM ({_STEM_XY})"
_MOMENTS = f"WITH p AS ({_NOISY}), m AS (SELECT stem_id, avg(x) AS mx, avg(y) AS my FROM p GROUP BY stem_id), c AS (SELECT stem_id, mx, my, x - mx AS u, y - my AS v FROM p JOIN m USING (stem_id)), s AS (SELECT stem_id, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) / 2 AS a, sum(v * (u * u + v * v)) / 2 AS b FROM c GROUP BY stem_id HAVING count(*) >= 3), f AS (SELECT *, (a * vv - b * uv) / (uu * vv - uv * uv) AS cu, (b * uu - a * uv) / (uu * vv - uv * uv) AS cv FROM s)"


@query("circle_fit_moments", f"{_MOMENTS} SELECT stem_id, n, {rounded_sql('mx + cu')} AS cx, {rounded_sql('my + cv')} AS cy, {rounded_sql('sqrt(cu * cu + cv * cv + (uu + vv) / n)')} AS r FROM f")
def circle_fit_moments(spark, d):
    """Points around known circles, off them by up to 3 mm."""
    points = _stem_xy(spark, d).select("stem_id", (F.col("x") + (F.col("point_index") % 11 - 5) / 2000).alias("x"), (F.col("y") + (F.col("point_index") % 13 - 6) / 2000).alias("y"))
    return fits.circle_from_moments(points, ["stem_id"]).where("n >= 3").select("stem_id", "n", rounded("cx").alias("cx"), rounded("cy").alias("cy"), rounded("r").alias("r"))


@query("inlier_statistics", f"WITH p AS (SELECT stem_id, sqrt((x - cx) ** 2 + (y - cy) ** 2) - r + (point_index % 7 - 3) / 100e0 AS e, greatest(0.018e0, least(0.045e0, 0.16e0 * r)) AS t FROM ({_STEM_XY})) SELECT stem_id, count(*) FILTER (WHERE abs(e) <= t + 1e-9) AS inliers, {rounded_sql('sqrt(avg(e * e) FILTER (WHERE abs(e) <= t + 1e-9))')} AS residual FROM p GROUP BY stem_id")
def inlier_statistics(spark, d):
    e = geo.radial_error("x", "y", "cx", "cy", "r") + (F.col("point_index") % 7 - 3) / 100
    p = _stem_xy(spark, d).select("stem_id", e.alias("e"), geo.loose_tolerance("r").alias("t")).withColumn("ok", F.abs("e") <= F.col("t") + 1e-9)
    return p.groupBy("stem_id").agg(F.count_if("ok").alias("inliers"), rounded(F.sqrt(F.avg(F.when(F.col("ok"), F.col("e") * F.col("e"))))).alias("residual"))


@query("circumcircle", f"WITH t AS (SELECT part.p_partkey AS k, p_size AS s, p_partkey % 97 AS a, p_partkey % 89 AS b FROM part) SELECT k, {rounded_sql('a / 2e0')} AS x, {rounded_sql('(s + 1) / 2e0')} AS y, {rounded_sql('sqrt(a * a + (s + 1) * (s + 1)) / 2e0')} AS r FROM t WHERE a > 0")
def circumcircle(spark, d):
    """Right-angled triangles, whose circle has the hypotenuse as diameter; flat ones have none."""
    t = table(spark, d, "part").selectExpr("p_partkey AS k", "cast(p_size + 1 as double) AS h", "cast(p_partkey % 97 as double) AS a", "0D AS z")
    c = t.select("k", geo.circumcircle("z", "z", "a", "z", "z", "h").alias("c")).where("c IS NOT NULL")
    return c.select("k", *(rounded(f"c.{n}").alias(n) for n in "xyr"))


_SLICES = f"SELECT stem_id, CAST(floor(hag / 0.4e0) AS INT) AS k, avg(x) AS sx, avg(y) AS sy, avg(r + k2) AS sr FROM (SELECT *, (point_index % 5) / 1000 AS k2 FROM ({_STEM_XY})) GROUP BY stem_id, CAST(floor(hag / 0.4e0) AS INT)"


def _slices(spark, d):
    return _stem_xy(spark, d).withColumn("k", F.floor(F.col("hag") / 0.4).cast("int")).groupBy("stem_id", "k").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"), F.avg(F.col("r") + (F.col("point_index") % 5) / 1000).alias("sr"))


@query("slice_consistency", f"WITH s AS ({_SLICES}), m AS (SELECT stem_id, median(sx) AS mx, median(sy) AS my FROM s GROUP BY stem_id) SELECT stem_id, count(*) AS n_slices, {rounded_sql('stddev_pop(sr) / greatest(avg(sr), 1e-6)')} AS radius_cv, {rounded_sql('max(sqrt((sx - mx) ** 2 + (sy - my) ** 2))')} AS centre_spread FROM s JOIN m USING (stem_id) GROUP BY stem_id HAVING count(*) >= 3")
def slice_consistency(spark, d):
    s = _slices(spark, d)
    both = fits.spread(s, ["stem_id"], "sr").join(fits.centre_spread(s, ["stem_id"], "sx", "sy"), "stem_id").where("n_slices >= 3")
    return both.select("stem_id", "n_slices", rounded("radius_cv").alias("radius_cv"), rounded("centre_spread").alias("centre_spread"))


@query("axis_line_fit", f"WITH s AS ({_SLICES}), l AS (SELECT stem_id, regr_slope(sx, k) AS ax, regr_intercept(sx, k) AS bx, regr_slope(sy, k) AS ay, regr_intercept(sy, k) AS by_ FROM s GROUP BY stem_id HAVING count(*) >= 4) SELECT stem_id, {rounded_sql('ax')} AS slope_x, {rounded_sql('ay')} AS slope_y, {rounded_sql('max(sqrt((sx - ax * k - bx) ** 2 + (sy - ay * k - by_) ** 2))')} AS line_residual FROM s JOIN l USING (stem_id) GROUP BY stem_id, ax, ay")
def axis_line_fit(spark, d):
    s = _slices(spark, d)
    many = s.groupBy("stem_id").count().where("count >= 4").select("stem_id")
    line = fits.axis_line(joins.members(s, many, "stem_id"), ["stem_id"], "k", "sx", "sy")
    return line.select("stem_id", *(rounded(c).alias(c) for c in ("slope_x", "slope_y", "line_residual")))


@query("plane_projection", f"WITH p AS (SELECT point_index, 0.6e0 AS ax, 0.0e0 AS ay, 0.8e0 AS az, x - 25 AS dx, y + 10 AS dy, hag - 1.3e0 AS dz FROM ({SCATTER_SQL})) SELECT point_index, {rounded_sql('dx * ax + dy * ay + dz * az')} AS axial, {rounded_sql('-0.8e0 * dx + 0.6e0 * dz')} AS u, {rounded_sql('-dy')} AS v FROM p")
def plane_projection(spark, d):
    axis = [F.lit(0.6), F.lit(0.0), F.lit(0.8)]
    u, v = geo.plane_basis(axis)
    p = scatter_points(spark, d).select("point_index", *(c.alias(n) for c, n in zip(geo.project([F.col("x") - 25, F.col("y") + 10, F.col("hag") - 1.3], axis, u, v), ("axial", "u", "v"), strict=True)))
    return p.select("point_index", *(rounded(c).alias(c) for c in ("axial", "u", "v")))


_QUALITY = "(s_suppkey % 300 + 1) * (0.35e0 + (s_suppkey % 24) / 24e0) * (5 / 5) / ((0.04e0 + (s_suppkey % 30) / 100e0) * (1 + 12 * (s_suppkey % 10) / 1000e0))"


def _candidates(spark, d):
    k = F.col("s_suppkey")
    quality = geo.final_quality(k % 300 + 1, (k % 24) / 24, F.lit(5.0), (k % 30) / 100, (k % 10) / 1000)
    return table(spark, d, "supplier").select(k.alias("id"), (k * 7919 % 300 / 100).alias("cx"), (k * 104729 % 300 / 100).alias("cy"), (k % 30 / 100).alias("r"), quality.alias("quality"))


@query("quality_rank", f"SELECT s_suppkey AS id, {rounded_sql(_QUALITY, 3)} AS quality, CAST(row_number() OVER (ORDER BY {rounded_sql(_QUALITY, 3)} DESC, s_suppkey) AS INT) AS rank FROM supplier")
def quality_rank(spark, d):
    return sampling.ranked(_candidates(spark, d).select("id", rounded("quality", 3).alias("quality")), [F.desc("quality"), "id"])


_NMS = f"SELECT s_suppkey AS id, s_suppkey * 7919 % 300 / 100 AS cx, s_suppkey * 104729 % 300 / 100 AS cy, s_suppkey % 30 / 100 AS r, {rounded_sql(_QUALITY, 3)} AS quality FROM supplier"


@query("nms_greedy", f"WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY quality DESC, id) AS k FROM ({_NMS})), g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, cx DOUBLE, cy DOUBLE, r DOUBLE)[]) AS kept UNION ALL SELECT c.k, CASE WHEN len(list_filter(kept, lambda o: sqrt((o.cx - c.cx) ** 2 + (o.cy - c.cy) ** 2) < greatest(0.2e0, 0.72e0 * (o.r + c.r)))) = 0 THEN list_append(kept, {{'id': c.id, 'cx': c.cx, 'cy': c.cy, 'r': c.r}}) ELSE kept END FROM g JOIN c ON c.k = g.k + 1), l AS (SELECT unnest(kept) AS o FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)) SELECT o.id AS id, o.cx AS cx, o.cy AS cy, o.r AS r FROM l")
def nms_greedy(spark, d):
    return nms.suppress(_candidates(spark, d).withColumn("quality", rounded("quality", 3))).select("id", "cx", "cy", "r")


@query("confidence_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 150 >= 100 AND o_orderkey % 24 / 24e0 >= 0.55e0 AND o_orderkey % 6 >= 5 THEN 'high' WHEN o_orderkey % 150 >= 40 AND o_orderkey % 24 / 24e0 >= 0.35e0 AND o_orderkey % 6 >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM orders")
def confidence_label(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", labels.confidence(k % 150, k % 24 / 24, k % 6).alias("confidence"))


# Orders as measurement records: fixed lists of statuses, picked by key.
_PICK = {
    "field_aid_status": ("READY_FOR_FIELD_USE", "CHECK_ON_SITE", "NO_ESTIMATE", "EXCLUDED_CONFIRMED_WRONG", None),
    "acceptance_status": ("FINAL_LIDAR_ESTIMATE", "NEEDS_LIDAR_REVIEW", None),
    "measurement_kind": ("STANDARD_DBH_1_30", "PROP_ROOT_PLUS_030", "LEGACY_STANDARD_DBH_1_30", None),
    "legacy_full_resolution_status": ("ACCEPTED", None),
    "legacy_measurement_rule": ("STANDARD_1_30", "ADAPTIVE_IRREGULAR_ZONE_PLUS_030", None),
    "field_aid_source": ("HUMAN_OPERATOR_EXCLUSION", "CURRENT_PROTOCOL_FINAL", "LEGACY_FULL_RESOLUTION_ACCEPTED", "FULL_LAS_GEOMETRY_ESTIMATE", None),
}


def _picked(values, by: str) -> str:
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


_RECORD_COLUMNS = (
    {"record_index": "o_orderkey", "tree_id": "concat('TREE_', lpad(CAST(o_orderkey AS STRING), 6, '0'))"}
    | {c: _picked(v, f"(o_orderkey // {i + 1})") for i, (c, v) in enumerate(_PICK.items())}
    | {"operationally_excluded": "CASE WHEN o_orderkey % 11 = 0 THEN true WHEN o_orderkey % 11 < 8 THEN false END", "field_aid_is_current_protocol_final": "CASE WHEN o_orderkey % 13 = 0 THEN true WHEN o_orderkey % 13 < 6 THEN false END"}
    | {"field_aid_circumference_cm": "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 END", "field_aid_dbh_cm": "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 3000 END", "renderable": "o_orderkey % 4 = 0"}
)
_RECORDS = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RECORD_COLUMNS.items()) + " FROM orders"


def _records(spark, d):
    return table(spark, d, "orders").selectExpr(*(f"{e.replace('//', 'div')} AS {c}" for c, e in _RECORD_COLUMNS.items()))


_LIVE = "NOT coalesce(operationally_excluded, false)"
_FACETS = {
    "ALL": "true", "MEASURED": "renderable", "READY": f"field_aid_status = 'READY_FOR_FIELD_USE' AND {_LIVE}", "CHECK": f"field_aid_status = 'CHECK_ON_SITE' AND {_LIVE}",
    "FINAL": f"acceptance_status = 'FINAL_LIDAR_ESTIMATE' AND {_LIVE}", "PROP_ROOT": f"measurement_kind = 'PROP_ROOT_PLUS_030' AND {_LIVE}", "LEGACY": f"legacy_full_resolution_status = 'ACCEPTED' AND {_LIVE}",
    "NO_ESTIMATE": "field_aid_status = 'NO_ESTIMATE'", "EXCLUDED": "coalesce(operationally_excluded, false) OR field_aid_status = 'EXCLUDED_CONFIRMED_WRONG'",
}
_REVIEW = {
    "ALL": "true", "FIELD_READY": "field_aid_status = 'READY_FOR_FIELD_USE'", "PROP_ROOT": _FACETS["PROP_ROOT"], "LEGACY": _FACETS["LEGACY"], "LEGACY_STANDARD": f"legacy_measurement_rule = 'STANDARD_1_30' AND {_LIVE}",
    "LEGACY_ADAPTIVE": f"legacy_measurement_rule = 'ADAPTIVE_IRREGULAR_ZONE_PLUS_030' AND {_LIVE}", "FINAL": "acceptance_status = 'FINAL_LIDAR_ESTIMATE'", "CHECK": "field_aid_status = 'CHECK_ON_SITE'",
    "HAS_ESTIMATE": f"field_aid_circumference_cm IS NOT NULL AND {_LIVE}", "NO_ESTIMATE": "field_aid_status = 'NO_ESTIMATE'", "EXCLUDED": "field_aid_status = 'EXCLUDED_CONFIRMED_WRONG'",
}


@query("facet_counts", " UNION ALL ".join(f"SELECT '{k}' AS facet, count(*) FILTER (WHERE {e}) AS n FROM ({_RECORDS})" for k, e in _FACETS.items()))
def facet_counts(spark, d):
    return browse.facet_counts(_records(spark, d))


@query("review_facet_counts", " UNION ALL ".join(f"SELECT '{k}' AS facet, count(*) FILTER (WHERE {e}) AS n FROM ({_RECORDS})" for k, e in _REVIEW.items()))
def review_facet_counts(spark, d):
    return browse.facet_counts(_records(spark, d), browse.REVIEW_FACETS)


@query("facet_filter", f"SELECT record_index, tree_id FROM ({_RECORDS}) WHERE {_FACETS['READY']} AND contains(tree_id, upper(trim(' tree_0001 ')))")
def facet_filter(spark, d):
    return browse.listing(_records(spark, d), "READY", " tree_0001 ").select("record_index", "tree_id")


@query("list_counter", f"SELECT count(*) FILTER (WHERE {_FACETS['LEGACY']} AND contains(tree_id, '_0')) AS shown, count(*) AS total FROM ({_RECORDS})")
def list_counter(spark, d):
    return browse.counter(_records(spark, d), "LEGACY", "_0")


@query("key_lookup", f"SELECT record_index, tree_id FROM ({_RECORDS}) WHERE record_index = 33")
def key_lookup(spark, d):
    return browse.selected(_records(spark, d), "tree_000033").select("record_index", "tree_id")


@query("id_search", "SELECT c_custkey, c_name FROM customer WHERE contains(upper(c_name), upper(trim(' r#0000000 ')))")
def id_search(spark, d):
    return table(spark, d, "customer").withColumn("name", F.upper("c_name")).where(browse.searched(" r#0000000 ", "name")).select("c_custkey", "c_name")


def _cases(column: str, values: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


_OUT = "coalesce(operationally_excluded, false) OR coalesce(field_aid_status, '') = 'EXCLUDED_CONFIRMED_WRONG'"


@query(
    "record_labels",
    f"SELECT record_index, CASE WHEN {_OUT} THEN '{labels.EXCLUDED_LABEL}' WHEN field_aid_status = 'READY_FOR_FIELD_USE' AND field_aid_is_current_protocol_final THEN '{labels.FINAL_LABEL}' ELSE {_cases('field_aid_status', labels.STATUS_LABELS, f'coalesce(field_aid_status, {chr(39)}{labels.UNKNOWN_STATUS}{chr(39)})')} END AS status, {_cases('measurement_kind', labels.KIND_LABELS, f'{chr(39)}{labels.KIND_DEFAULT}{chr(39)}')} AS kind, {_cases('field_aid_source', labels.SOURCE_TEXTS, f'{chr(39)}{labels.NO_FIT}{chr(39)}')} AS source, CASE WHEN {_OUT} THEN 'excluded' WHEN field_aid_status = 'READY_FOR_FIELD_USE' THEN 'ready' WHEN field_aid_status = 'CHECK_ON_SITE' THEN 'check' ELSE 'none' END AS class, lower(printf('%06x', CASE WHEN {_OUT} THEN {labels.EXCLUDED_COLOR} WHEN field_aid_status = 'NO_ESTIMATE' THEN {labels.NO_ESTIMATE_COLOR} WHEN field_aid_is_current_protocol_final THEN {labels.FINAL_COLOR} WHEN measurement_kind = 'PROP_ROOT_PLUS_030' THEN {labels.ROOT_COLOR} WHEN field_aid_source = 'LEGACY_FULL_RESOLUTION_ACCEPTED' THEN {labels.LEGACY_COLOR} WHEN field_aid_status = 'READY_FOR_FIELD_USE' THEN {labels.READY_COLOR} ELSE {labels.CHECK_COLOR} END)) AS color, replace(tree_id, 'TREE_', '') AS short_id FROM ({_RECORDS})",
)
def record_labels(spark, d):
    return _records(spark, d).select("record_index", labels.status_label().alias("status"), labels.kind_label().alias("kind"), labels.source_text().alias("source"), labels.status_class().alias("class"), labels.hex_color(labels.color()).alias("color"), labels.short_id().alias("short_id"))


@query("status_counts", f"SELECT coalesce(acceptance_status, 'null') AS status, count(*) AS n FROM ({_RECORDS}) GROUP BY ALL")
def status_counts(spark, d):
    return index.status_counts(_records(spark, d), "acceptance_status").select(F.explode("acceptance_status_counts").alias("status", "n"))


@query("id_lists", f"SELECT row_number() OVER (ORDER BY tree_id) - 1 AS pos, tree_id FROM ({_RECORDS}) WHERE field_aid_status = 'NO_ESTIMATE'")
def id_lists(spark, d):
    return index.ids_where(_records(spark, d), labels.equals("field_aid_status", "NO_ESTIMATE"))


@query("status_partition_check", f"SELECT count(*) AS listed, count(DISTINCT record_index) AS records FROM ({_RECORDS}) WHERE field_aid_status IS NOT NULL")
def status_partition_check(spark, d):
    r = _records(spark, d)
    lists = [r.where(labels.equals("field_aid_status", s)).select("record_index") for s in _PICK["field_aid_status"] if s]
    both = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3])
    return both.agg(F.count("*").alias("listed"), F.count_distinct("record_index").alias("records"))


@query("set_difference", f"SELECT tree_id FROM ({_RECORDS}) WHERE {_FACETS['LEGACY']} EXCEPT SELECT tree_id FROM ({_RECORDS}) WHERE field_aid_status = 'EXCLUDED_CONFIRMED_WRONG'")
def set_difference(spark, d):
    return browse.only_in(_records(spark, d), "LEGACY", "EXCLUDED_STATUS")


@query("set_intersection", f"SELECT tree_id FROM ({_RECORDS}) WHERE {_FACETS['PROP_ROOT']} INTERSECT SELECT tree_id FROM ({_RECORDS}) WHERE {_FACETS['READY']}")
def set_intersection(spark, d):
    return browse.in_both(_records(spark, d), "PROP_ROOT", "READY")


@query("semi_anti_membership", "SELECT c_mktsegment, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS inside, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS outside FROM customer GROUP BY ALL")
def semi_anti_membership(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both = joins.members(c, o, "c_custkey").withColumn("k", F.lit(True)).unionByName(joins.members(c, o, "c_custkey", False).withColumn("k", F.lit(False)))
    return both.groupBy("c_mktsegment").agg(F.count_if("k").alias("inside"), F.count_if(~F.col("k")).alias("outside"))


@query("strict_lookup_join", "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def strict_lookup_join(spark, d):
    left, right = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")), table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    return joins.strict_lookup(left, right, "key").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props_extract(spark, d):
    return documents.fields(table(spark, d, "events"), "props", "k BIGINT").where("k IS NOT NULL").select("event_id", "k")


@query("js_round_projection", "SELECT o_orderkey, floor(o_totalprice / 7e0 * 100 + 0.5) / 100 AS up, floor(-o_totalprice / 8e0 * 10 + 0.5) / 10 AS down FROM orders")
def js_round_projection(spark, d):
    return table(spark, d, "orders").select("o_orderkey", geo.js_round(F.col("o_totalprice") / 7, 2).alias("up"), geo.js_round(-F.col("o_totalprice") / 8, 1).alias("down"))


@query("top_k_desc", "SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def top_k_desc(spark, d):
    return notes.newest(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("string").alias("created_at")))


_FITS = "SELECT p_partkey AS k, (p_partkey % 2 = 0) AS ell, p_size / 100e0 AS a, p_size / 200e0 AS b, (p_partkey % 31) / 10e0 AS rot, (p_partkey % 7) / 10e0 AS u0, (p_partkey % 5) / 10e0 AS v0 FROM part"


def _index_rows(spark, d):
    """Parts as index records: circles and ellipses in planes."""
    e = "named_struct('valid', p_partkey % 2 = 0, 'center', array(p_partkey % 7 / 10D, p_partkey % 5 / 10D), 'semi_major_axis_m', p_size / 100D, 'semi_minor_axis_m', p_size / 200D, 'rotation_rad', p_partkey % 31 / 10D)"
    return table(spark, d, "part").selectExpr(
        "p_partkey AS k", "cast(p_partkey as string) AS tree_id", "CASE WHEN p_partkey % 2 = 0 THEN 'ELLIPSE' ELSE 'CIRCLE' END AS fit_model", "CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 100 END AS field_aid_diameter_cm",
        f"named_struct('center', array(p_partkey % 7 / 10D, p_partkey % 5 / 10D), 'radius_m', CASE WHEN p_partkey % 9 > 0 THEN p_size / 100D END, 'ellipse', {e}) AS fit",
        "named_struct('center_xyz', array(1D, 2D, 3D), 'basis_u', array(0D, 1D, 0D), 'basis_v', array(0D, 0D, 1D), 'axis_direction', array(1D, 0D, 0D)) AS plane",
    )


@query(
    "ring_outline",
    f"WITH f AS ({_FITS}), p AS (SELECT *, range AS i, 2 * pi() * range / 12 AS t FROM f, range(12)), q AS (SELECT k, CAST(i AS INT) AS i, CASE WHEN ell THEN u0 + a * cos(t) * cos(rot) - b * sin(t) * sin(rot) ELSE u0 + a * cos(t) END AS u, CASE WHEN ell THEN v0 + a * cos(t) * sin(rot) + b * sin(t) * cos(rot) ELSE v0 + a * sin(t) END AS v FROM p WHERE ell OR k % 9 > 0) SELECT k, i, {rounded_sql('2 + u')} AS y, {rounded_sql('3 + v')} AS z FROM q",
)
def ring_outline(spark, d):
    return browse.outlines(_index_rows(spark, d), 12).select(F.col("tree_id").cast("long").alias("k"), "i", rounded("y").alias("y"), rounded("z").alias("z"))


@query("effective_radius", f"SELECT p_partkey AS k, {rounded_sql('CASE WHEN p_partkey % 2 = 0 THEN (p_size / 100e0 + p_size / 200e0) / 2 WHEN p_partkey % 9 > 0 THEN p_size / 100e0 ELSE greatest(coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 100 END, 8) / 200, 0.04e0) END')} AS radius, {rounded_sql('2 + (p_partkey % 7) / 10e0')} AS centre_y FROM part")
def effective_radius(spark, d):
    return _index_rows(spark, d).select("k", rounded(browse.effective_radius()).alias("radius"), rounded(browse.fit_centre()[1]).alias("centre_y"))


@query("view_rotation", f"SELECT point_index, {rounded_sql('cos(0.7e0) * x - sin(0.7e0) * y')} AS \"right\", {rounded_sql('cos(0.3e0) * hag - sin(0.3e0) * (sin(0.7e0) * x + cos(0.7e0) * y)')} AS up, {rounded_sql('sin(0.3e0) * hag + cos(0.3e0) * (sin(0.7e0) * x + cos(0.7e0) * y)')} AS depth FROM ({SCATTER_SQL})")
def view_rotation(spark, d):
    p = browse.painter_order(scatter_points(spark, d).withColumnRenamed("hag", "z"), 0.7, 0.3)
    return p.select("point_index", *(rounded(c).alias(c) for c in ("right", "up", "depth")))


@query("scene_axes", f"SELECT point_index, x AS scene_x, hag AS scene_y, -y AS scene_z FROM ({SCATTER_SQL})")
def scene_axes(spark, d):
    return scatter_points(spark, d).select("point_index", *geo.to_scene("x", "y", "hag"))


@query("garden_predicates", f"SELECT count(*) FILTER (WHERE abs(hag - 1.3e0) <= 0.035e0 AND sqrt((x - 25) ** 2 + (y + 10) ** 2) <= 4.06e0) AS trunk, count(*) FILTER (WHERE hag >= 1 AND hag <= 2 AND ((x - 25) / 6e0) ** 2 + ((y + 10) / 4e0) ** 2 <= 1.08e0) AS crown FROM ({SCATTER_SQL})")
def garden_predicates(spark, d):
    p = scatter_points(spark, d).withColumnRenamed("hag", "z")
    return p.agg(F.count_if(clouds.trunk_slice(25.0, -10.0, 4.0, 1.3)).alias("trunk"), F.count_if(clouds.crown_ellipse(25.0, -10.0, 6.0, 4.0, 1.0, 2.0)).alias("crown"))


@query("scalar_geometry", f"SELECT p_partkey AS k, {rounded_sql('p_size / 100e0 * 200')} AS dbh_cm, {rounded_sql('2 * pi() * p_size / 100e0')} AS circumference, greatest(0.005e0, least(0.020e0, p_size / 100e0 * 0.13e0)) AS tolerance, greatest(0.018e0, p_size / 100e0 * 0.58e0) AS r_min, least(0.34e0, p_size / 100e0 * 1.5e0) AS r_max, greatest(0.065e0, p_size / 100e0 * 0.75e0) AS centre_tolerance, greatest(0.018e0, least(0.05e0, p_size / 100e0 * 0.085e0)) AS tube, greatest(1, CAST(ceil(p_partkey / 7e0) AS BIGINT)) AS step FROM part")
def scalar_geometry(spark, d):
    r = F.col("p_size") / 100
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), rounded(geo.dbh_cm(r)).alias("dbh_cm"), rounded(geo.circumference(r)).alias("circumference"), geo.tight_tolerance(r).alias("tolerance"), *geo.prior_bounds(r), geo.tube_radius(r).alias("tube"), geo.step_for(F.col("p_partkey"), F.lit(7.0)).alias("step"))


@query("axis_geometry", f"WITH s AS (SELECT s_suppkey AS k, s_suppkey % 17 / 100e0 AS a, s_suppkey % 13 / 100e0 AS b FROM supplier) SELECT k, {rounded_sql('a * 1.3e0 + 5')} AS x, {rounded_sql('b * 1.3e0 - 3')} AS y, {rounded_sql('7 - a * 1.3e0')} AS ground_x, {rounded_sql('8 - b * 1.3e0')} AS ground_y FROM s")
def axis_geometry(spark, d):
    k = F.col("s_suppkey")
    a, b = k % 17 / 100, k % 13 / 100
    x, y, _ = geo.axis_point(a, F.lit(5.0), b, F.lit(-3.0), F.lit(-6.68), F.lit(1.3))
    gx, gy = geo.ground_centre(F.lit(7.0), F.lit(8.0), a, b, F.lit(1.0))
    return table(spark, d, "supplier").select(k.alias("k"), rounded(x).alias("x"), rounded(y).alias("y"), rounded(gx).alias("ground_x"), rounded(gy).alias("ground_y"))


@query("text_fields", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'markings/' || c_name || '.json' END AS path, coalesce(trim(CASE WHEN c_custkey % 3 > 0 THEN '  ' || c_mktsegment || ' ' END), '') AS segment, array_to_string(string_split(c_name, '#')[1:3], ' · ') AS parts FROM customer")
def text_fields(spark, d):
    url = F.when(F.col("c_custkey") % 7 == 0, "/../secret").otherwise(F.concat(F.lit("//markings/"), "c_name", F.lit(".json")))
    segment = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    rows = table(spark, d, "customer").withColumn("codes", F.split("c_name", "#"))
    return rows.select("c_custkey", labels.safe_path(url).alias("path"), labels.optional_text(segment).alias("segment"), labels.top_reasons("codes").alias("parts"))


@query("embedding_nearest", "WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS nearest_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query_id, arg_min(nearest_id, (dist, nearest_id)) AS nearest_id, floor(min(dist) * 1e3 + 0.5) / 1e3 AS distance FROM p GROUP BY query_id")
def embedding_nearest(spark, d):
    """The nearest other vector of each query vector: queries are the ids divisible by 20, whose blocks meet blocks of all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = vectors.nearest_in_blocks(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding")
    return found.select("query_id", "nearest_id", rounded("distance", 3).alias("distance"))


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, d):
    from .streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


from . import queries_index, queries_sources, queries_stems  # noqa: E402, F401  they register their own
