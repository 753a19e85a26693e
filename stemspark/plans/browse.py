"""Browsing an index: facets of both viewers, search, key lookup, counters, outlines and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import number, on_plane, rotate
from ..functions.labels import equals, yes

READY, CHECK = "READY_FOR_FIELD_USE", "CHECK_ON_SITE"


def _live(condition: Column) -> Column:
    return condition & ~yes("operationally_excluded")


#: The main viewer's facets. Ready, check and final leave excluded records out; excluded is the flag or the status.
MAIN_FACETS = {
    "ALL": lambda: F.lit(True),
    "MEASURED": lambda: yes("renderable"),
    "READY": lambda: _live(equals("field_aid_status", READY)),
    "CHECK": lambda: _live(equals("field_aid_status", CHECK)),
    "FINAL": lambda: _live(equals("acceptance_status", "FINAL_LIDAR_ESTIMATE")),
    "PROP_ROOT": lambda: _live(equals("measurement_kind", "PROP_ROOT_PLUS_030")),
    "LEGACY": lambda: _live(equals("legacy_full_resolution_status", "ACCEPTED")),
    "NO_ESTIMATE": lambda: equals("field_aid_status", "NO_ESTIMATE"),
    "EXCLUDED": lambda: yes("operationally_excluded") | equals("field_aid_status", "EXCLUDED_CONFIRMED_WRONG"),
}
#: The review page's facets, which treat excluded records otherwise.
REVIEW_FACETS = {
    "ALL": lambda: F.lit(True),
    "FIELD_READY": lambda: equals("field_aid_status", READY),
    "PROP_ROOT": MAIN_FACETS["PROP_ROOT"],
    "LEGACY": MAIN_FACETS["LEGACY"],
    "LEGACY_STANDARD": lambda: _live(equals("legacy_measurement_rule", "STANDARD_1_30")),
    "LEGACY_ADAPTIVE": lambda: _live(equals("legacy_measurement_rule", "ADAPTIVE_IRREGULAR_ZONE_PLUS_030")),
    "FINAL": lambda: equals("acceptance_status", "FINAL_LIDAR_ESTIMATE"),
    "CHECK": lambda: equals("field_aid_status", CHECK),
    "HAS_ESTIMATE": lambda: _live(F.col("field_aid_circumference_cm").isNotNull()),
    "NO_ESTIMATE": MAIN_FACETS["NO_ESTIMATE"],
    "EXCLUDED": lambda: equals("field_aid_status", "EXCLUDED_CONFIRMED_WRONG"),
}


def matches(facet: str, facets=MAIN_FACETS) -> Column:
    """An unknown facet matches all."""
    return facets.get(facet, facets["ALL"])()


def searched(text: str, column: str = "tree_id") -> Column:
    """A literal part of the id, trimmed and in upper case; empty text matches all."""
    return F.contains(F.col(column), F.upper(F.trim(F.lit(text))))


def listing(index: DataFrame, facet: str = "ALL", text: str = "", facets=MAIN_FACETS) -> DataFrame:
    """In file order."""
    return index.where(matches(facet, facets) & searched(text)).orderBy("record_index")


def counter(index: DataFrame, facet: str = "ALL", text: str = "", facets=MAIN_FACETS) -> DataFrame:
    return index.agg(F.count_if(matches(facet, facets) & searched(text)).alias("shown"), F.count("*").alias("total"))


def facet_counts(index: DataFrame, facets=MAIN_FACETS) -> DataFrame:
    """All facets in one pass: facet, n."""
    counts = index.agg(*(F.count_if(f()).alias(k) for k, f in facets.items()))
    return counts.select(F.explode(F.create_map(*(x for k in facets for x in (F.lit(k), F.col(k))))).alias("facet", "n"))


def _ids(index: DataFrame, facet: str) -> DataFrame:
    return index.where({**REVIEW_FACETS, **MAIN_FACETS, "EXCLUDED_STATUS": REVIEW_FACETS["EXCLUDED"]}[facet]()).select("tree_id")


def only_in(index: DataFrame, facet: str, other: str) -> DataFrame:
    """The distinct ids in one facet but not in another."""
    return _ids(index, facet).subtract(_ids(index, other))


def in_both(index: DataFrame, facet: str, other: str) -> DataFrame:
    return _ids(index, facet).intersect(_ids(index, other))


def selected(index: DataFrame, tree_id: str | None, any_case: bool = True) -> DataFrame:
    """The record of a key, else the first in file order."""
    key = F.lit(tree_id).cast("string")
    hit = F.coalesce(F.col("tree_id") == (F.upper(key) if any_case else key), F.lit(False))
    return index.orderBy(F.desc(hit), "record_index").limit(1)


def kpis(summary: DataFrame, total: str, *parts: str) -> DataFrame:
    """Sums and differences of counts, missing ones as zero."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summary.select(count(total).alias("total"), sum((count(p) for p in parts), F.lit(0)).alias("listed"), (count(total) - sum((count(p) for p in parts), F.lit(0))).alias("rest"))


def is_ellipse() -> Column:
    return equals("fit_model", "ELLIPSE") & F.coalesce(F.col("fit.ellipse.valid"), F.lit(False))


def effective_radius() -> Column:
    ellipse = (F.col("fit.ellipse.semi_major_axis_m") + F.col("fit.ellipse.semi_minor_axis_m")) / 2
    return F.when(is_ellipse(), ellipse).otherwise(F.coalesce("fit.radius_m", F.greatest(F.coalesce("field_aid_diameter_cm", F.lit(8.0)) / 200, F.lit(0.04))))


def fit_centre() -> Column:
    """On the plane; the plane's centre if the fit has none; null without a plane."""
    uv = F.when(is_ellipse(), F.col("fit.ellipse.center")).otherwise(F.col("fit.center"))
    p = F.col("plane")
    there = on_plane(p["center_xyz"], p["basis_u"], p["basis_v"], uv[0], uv[1])
    return F.when(p.isNotNull(), F.when(uv.isNull(), p["center_xyz"]).otherwise(there))


def outline_uv(angle: Column) -> Column:
    """struct(u, v) on the fitted ellipse or circle; null without either."""
    e, c = F.col("fit.ellipse"), F.col("fit.center")
    along, across, turn = e["semi_major_axis_m"] * F.cos(angle), e["semi_minor_axis_m"] * F.sin(angle), e["rotation_rad"]
    ellipse = F.struct((e["center"][0] + along * F.cos(turn) - across * F.sin(turn)).alias("u"), (e["center"][1] + along * F.sin(turn) + across * F.cos(turn)).alias("v"))
    circle = F.struct((c[0] + F.col("fit.radius_m") * F.cos(angle)).alias("u"), (c[1] + F.col("fit.radius_m") * F.sin(angle)).alias("v"))
    return F.when(is_ellipse(), ellipse).when(c.isNotNull() & F.col("fit.radius_m").isNotNull(), circle)


def outlines(index: DataFrame, samples: int = 72, closed: bool = False) -> DataFrame:
    """tree_id, i, u, v, x, y, z: points around each fit. closed: the first point is repeated at the end."""
    n = samples + 1 if closed else samples
    angle = F.lit(2.0) * F.pi() * F.col("i") / samples
    rows = index.where("plane IS NOT NULL AND fit IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("uv", outline_uv(angle)).where("uv IS NOT NULL")
    p = F.col("plane")
    at = rows.withColumn("at", on_plane(p["center_xyz"], p["basis_u"], p["basis_v"], F.col("uv.u"), F.col("uv.v")))
    return at.select("tree_id", "i", "uv.u", "uv.v", *(F.col("at")[k].alias(c) for k, c in enumerate("xyz")))


def disc(index: DataFrame, radius: float = 0.34, samples: int = 80) -> DataFrame:
    """The rim of each measurement plane's disc, closed."""
    angle = F.lit(2.0) * F.pi() * F.col("i") / samples
    p = F.col("plane")
    at = on_plane(p["center_xyz"], p["basis_u"], p["basis_v"], F.lit(radius) * F.cos(angle), F.lit(radius) * F.sin(angle))
    return index.where("plane IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples)))).select("tree_id", "i", *(at[k].alias(c) for k, c in enumerate("xyz")))


def largest_coordinate(points: Column) -> Column:
    """Of nested points, by absolute value."""
    return F.array_max(F.transform(F.flatten(points), lambda v: F.abs(v)))


def painter_order(points: DataFrame, yaw: float, pitch: float) -> DataFrame:
    """Projected points, far ones first."""
    return points.select("*", *rotate("x", "y", "z", yaw, pitch)).orderBy("depth")


def front_most(hits: DataFrame, ray: str = "ray") -> DataFrame:
    """ray, tree_id: of each ray's hits (distance, tree_id, visible) the nearest that can be seen; of equally near ones the smaller id."""
    return hits.where(yes("visible")).groupBy(ray).agg(F.min(F.struct("distance", "tree_id")).alias("m")).select(ray, "m.tree_id")


def budget_steps(n: Column | str, budgets=(250_000, 500_000, 1_000_000)) -> list[Column]:
    return [F.greatest(F.lit(1).cast("bigint"), F.ceil(number(n) / b)).alias(f"step_{b}") for b in budgets]
