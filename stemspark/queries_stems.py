"""Queries of the stem detection, over stems of known place, radius and lean: the SQL has what the detection must find."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from .functions import geometry as geo
from .lineage import settled, shared_folder
from .operators import clouds, fits
from .plans import detect
from .plans.views import table
from .registry import query, rounded, rounded_sql
from .sources import documents

POINTS, GROUND_POINTS = 4800, 900
#: A stem for each residue of the suppliers' keys: its place in the window, radius and lean along x.
_STEM = {"stem": "s_suppkey % 40", "cx": "7 + (s_suppkey % 40) % 8 * 4.4e0", "cy": "-22 + (s_suppkey % 40) // 8 * 5e0 + (s_suppkey % 40) % 8 * 0.1e0", "r": "(6 + s_suppkey % 40 % 3) / 100e0", "lean": "(s_suppkey % 40 % 5 - 2) / 100e0"}
_STEMS = "SELECT DISTINCT " + ", ".join(f"CAST({e} AS {'BIGINT' if c == 'stem' else 'DOUBLE'}) AS {c}" for c, e in _STEM.items()) + " FROM supplier"


def _stems(spark, d):
    return table(spark, d, "supplier").selectExpr(*(f"cast({e.replace('//', 'div')} as {'bigint' if c == 'stem' else 'double'}) AS {c}" for c, e in _STEM.items())).distinct()


def _cloud(spark, d):
    """Points around each stem, off its surface by up to 2 mm, and ground about it."""
    i, turn = F.col("i"), 2 * F.pi() * (F.col("i") * 0.6180339887498949 - F.floor(F.col("i") * 0.6180339887498949))
    rows = _stems(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS + GROUND_POINTS - 1))))
    height = F.when(i < POINTS, i * 617 % POINTS / 2000 + 0.00025).otherwise(0.0005 * (i % 7))
    away = F.when(i < POINTS, F.col("r") + ((i * 7919 + F.col("stem") * 31) % 1001 - 500) / 250_000).otherwise(0.2 + (i - POINTS) / GROUND_POINTS * 0.7)
    return rows.select((F.col("stem") * 8192 + i).alias("point_index"), (F.col("cx") + F.col("lean") * height + away * F.cos(turn)).alias("x"), (F.col("cy") + away * F.sin(turn)).alias("y"), (height + detect.GROUND).alias("z"))


def _candidates(spark, d):
    """The known stems at breast height, as candidates of the refinement."""
    return _stems(spark, d).select(F.col("stem").alias("id"), (F.col("cx") + F.col("lean") * 1.3).alias("cx"), "cy", "r", F.lit(detect.GROUND).alias("ground"))


def _placed(found, stems, key: str):
    """Results beside their stems: whether centre, radius and lean are the known ones."""
    s = stems.select("stem", F.col("cx").alias("k_x"), F.col("cy").alias("k_y"), F.col("r").alias("k_r"), F.col("lean").alias("k_lean"))
    near = F.hypot(F.col("cx") - F.col("k_x") - F.col("k_lean") * 1.3, F.col("cy") - F.col("k_y"))
    return found.join(s, F.col(key) == F.col("stem")).select("*", (near <= 0.01).alias("centre_found"), (F.abs(F.col("r") - F.col("k_r")) <= 0.005).alias("radius_found"))


@query("stem_seeds", f"SELECT stem, true AS near FROM ({_STEMS})")
def stem_seeds(spark, d):
    """Peaks of the smoothed band minimum: every stem has one within 15 cm, and none is elsewhere."""
    seeds = detect.candidate_seeds(_cloud(spark, d))
    s = _stems(spark, d)
    near = seeds.select((F.floor((F.col("seed_x") - 4.8) / 4.4) + 8 * F.floor((F.col("seed_y") + 24) / 5)).cast("long").alias("stem"), "seed_x", "seed_y").join(s, "stem", "left")
    return near.groupBy("stem").agg(F.max(F.coalesce(F.hypot(F.col("seed_x") - F.col("cx") - F.col("lean"), F.col("seed_y") - F.col("cy")) <= 0.15, F.lit(False))).alias("near"))


@query("stem_candidates", f"SELECT stem, true AS centre_found, true AS radius_found, 5 AS slices, true AS upright, 1e0 AS coverage FROM ({_STEMS})")
def stem_candidates(spark, d):
    """Seeds beside the stems and in empty places: neighbourhoods, their ground and columns, robust circles at five heights, and the gates."""
    s = _stems(spark, d)
    seeds = s.select(F.col("stem").alias("seed_id"), (F.col("cx") + 0.03).alias("seed_x"), (F.col("cy") - 0.02).alias("seed_y")).unionByName(s.select((F.col("stem") + 1000).alias("seed_id"), (F.col("cx") + 1.0).alias("seed_x"), F.col("cy").alias("seed_y")))
    found = _placed(detect.evaluated(seeds, _cloud(spark, d)), s, "id")
    return found.select("stem", "centre_found", "radius_found", F.col("slice_count").alias("slices"), (F.col("verticality") >= 0.72).alias("upright"), "coverage")


_RINGS = f"SELECT stem, cx, cy, r, lean, range AS i, CASE WHEN range < {POINTS} THEN range * 617 % {POINTS} / 2000 + 0.00025e0 ELSE 0.0005e0 * (range % 7) END AS h FROM ({_STEMS}), range({POINTS + GROUND_POINTS})"


@query("stem_neighbourhoods", f"SELECT stem AS owner, count(*) AS n, min(stem * 8192 + i) AS first FROM ({_RINGS}) WHERE i < {POINTS} AND h >= 0.55e0 AND h <= 2.05e0 GROUP BY stem")
def stem_neighbourhoods(spark, d):
    """The points each candidate owns, by the owner of their cell, their distance and height."""
    return detect.full_neighbourhoods(_candidates(spark, d), _cloud(spark, d)).groupBy("owner").agg(F.count("*").alias("n"), F.min("point_index").alias("first"))


@query("stem_refinement", f"SELECT stem, true AS centre_found, true AS radius_found, true AS enough, true AS lean_found FROM ({_STEMS})")
def stem_refinement(spark, d):
    """Circles on all points, the axis through them, and circles again in planes across it."""
    refined = detect.full_neighbourhoods(_candidates(spark, d), _cloud(spark, d)).groupBy("owner").applyInPandas(detect.refine, detect.REFINED)
    found = _placed(refined, _stems(spark, d), "id")
    return found.select("stem", "centre_found", "radius_found", (F.col("slice_count") >= 4).alias("enough"), (F.abs(F.col("axis_x") / F.col("axis_z") - F.col("k_lean")) <= 0.01).alias("lean_found"))


def _detected(spark, d):
    return settled(detect.detect(spark, _cloud(spark, d)))


@query("stem_detection", f"SELECT CAST(row_number() OVER (ORDER BY cy DESC, cx DESC) AS INT) AS tree_id, stem, true AS centre_found, true AS radius_found, 'high' AS confidence FROM ({_STEMS})")
def stem_detection(spark, d):
    """The whole run, from points to numbered stems: those that exist, each once."""
    found = _detected(spark, d).withColumn("key", (F.floor((F.col("cx") - 4.8) / 4.4) + 8 * F.floor((F.col("cy") + 24) / 5)).cast("long"))
    return _placed(found, _stems(spark, d), "key").select("tree_id", "stem", "centre_found", "radius_found", "confidence")


@query("published_stems", f"SELECT CAST(row_number() OVER (ORDER BY cy DESC, cx DESC) AS INT) AS id, CAST((SELECT count(*) FROM ({_STEMS})) AS INT) AS stems, {rounded_sql('cx', 3)} AS x, {rounded_sql('cy', 3)} AS y, r AS radius, {rounded_sql('r * 200', 1)} AS dbh_cm, {rounded_sql('2 * pi() * r', 3)} AS circumference, -5.38e0 AS measured_at, 'high' AS confidence FROM ({_STEMS})")
def published_stems(spark, d):
    """The published document of stems, numbered from the north, read again."""
    path = f"{shared_folder(spark)}/stems-{uuid.uuid4().hex}/tree-measurements.json"
    known = {"ground": detect.GROUND, "axis_x": 0.0, "axis_y": 0.0, "axis_z": 1.0, "coverage": 1.0, "residual": 0.001, "verticality": 1.0}
    stems = _stems(spark, d).select("cx", "cy", "r", *(F.lit(v).alias(c) for c, v in known.items()), F.lit(150).alias("inliers"), F.lit(5).alias("slice_count"))
    detect.publish_stems(spark, detect.stem_records(stems), path, {"source": "known stems", "breastHeightM": 1.3})
    t = documents.read_document(spark, path, documents.TREES).select("visibleMeasuredTrees", F.explode("trees").alias("t"))
    return t.select("t.id", F.col("visibleMeasuredTrees").alias("stems"), *(rounded(F.get("t.center", F.lit(k)), 3).alias(c) for k, c in enumerate("xy")), F.col("t.radiusM").alias("radius"), F.col("t.dbhCm").alias("dbh_cm"), F.col("t.circumferenceM").alias("circumference"), F.col("t.measurementZ").alias("measured_at"), "t.confidence")


@query("verticality", f"SELECT stem, {rounded_sql('1 / sqrt(1 + (lean * 10) ** 2 + r ** 2)')} AS upright FROM ({_STEMS})")
def verticality(spark, d):
    """Points on lines of known direction."""
    lines = _stems(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40)))).select("stem", (F.col("cx") + F.col("lean") * 10 * F.col("i") / 20).alias("x"), (F.col("cy") + F.col("r") * F.col("i") / 20).alias("y"), (F.col("i") / 20).alias("z"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stem": [group["stem"].iloc[0]], "upright": [fits.verticality(group[["x", "y", "z"]].to_numpy())]})

    return lines.groupBy("stem").applyInPandas(run, "stem long, upright double").select("stem", rounded("upright").alias("upright"))


def _circle(kind: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("point_index")
        xy, first = group[["x", "y"]].to_numpy(), group.iloc[0]
        seed, rng = np.array([first["cx"] + 0.02, first["cy"] - 0.01]), np.random.default_rng(int(first["stem"]))
        found = fits.first_circle(xy, seed, rng) if kind == "first" else fits.known_circle(xy, seed, first["r"] * 1.1, rng)
        if not found:
            return pd.DataFrame({"stem": [], "found": [], "inliers": [], "coverage": []})
        near = abs(found["r"] - first["r"]) < 0.003 and np.hypot(found["cx"] - first["cx"], found["cy"] - first["cy"]) < 0.003
        return pd.DataFrame({"stem": [int(first["stem"])], "found": [bool(near)], "inliers": [found["inliers"]], "coverage": [found["coverage"]]})

    return run


def _slices(spark, d):
    """200 points on each stem's circle and 50 far off it; a stem whose number is divisible by 7 has too few points."""
    i = F.col("i")
    rows = _stems(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("stem") % 7 == 0, F.lit(8)).otherwise(F.lit(249)))))
    away = F.when(i < 200, F.col("r")).otherwise(F.col("r") + 0.08 + (i - 200) / 500)
    turn = i * 2.399963229728653
    return rows.select("stem", "cx", "cy", "r", i.alias("point_index"), (F.col("cx") + away * F.cos(turn)).alias("x"), (F.col("cy") + away * F.sin(turn)).alias("y"))


for _kind in ("first", "known"):

    @query(f"{_kind}_circles", f"SELECT stem, true AS found, 200 AS inliers, 1e0 AS coverage FROM ({_STEMS}) WHERE stem % 7 > 0")
    def _circles(spark, d, kind=_kind):
        """The circle of a slice among points off it, whole and with all of its points; none from too few."""
        return _slices(spark, d).groupBy("stem").applyInPandas(_circle(kind), "stem long, found boolean, inliers int, coverage double")


_CROWN = "SELECT n_nationkey AS k, 5 + n_nationkey % 4 AS w, 4 + n_nationkey % 3 AS h FROM nation"
_CROWN_POINTS = f"SELECT k, w, h, (i.range + 0.5e0) * 0.04e0 + k AS x, (j.range + 0.5e0) * 0.04e0 AS y FROM ({_CROWN}), range(8) i, range(6) j WHERE i.range < w AND j.range < h"


@query("crown_metrics", f"SELECT k, count(*) AS cells, {rounded_sql('any_value(w * h) * 0.0016e0')} AS hull_area, {rounded_sql('quantile_cont(x, 0.99) - quantile_cont(x, 0.01)')} AS spread_x, {rounded_sql('quantile_cont(y, 0.99) - quantile_cont(y, 0.01)')} AS spread_y, {rounded_sql('sqrt((avg(x) - 3) ** 2 + (avg(y) - 1) ** 2)')} AS away FROM ({_CROWN_POINTS}) GROUP BY k")
def crown_metrics(spark, d):
    """Full rectangles of cells: their area, spread, and distance from a trunk."""
    k = F.col("n_nationkey")
    crowns = table(spark, d, "nation").select(k.alias("k"), (5 + k % 4).alias("w"), (4 + k % 3).alias("h"))
    points = crowns.withColumn("i", F.explode(F.expr("sequence(0, w - 1)"))).withColumn("j", F.explode(F.expr("sequence(0, h - 1)"))).select("k", ((F.col("i") + 0.5) * 0.04 + F.col("k")).alias("x"), ((F.col("j") + 0.5) * 0.04).alias("y"))
    found = clouds.offset_from_trunk(clouds.crown_metrics(points, ["k"]), 3.0, 1.0)
    return found.select("k", "cells", rounded("hull_area").alias("hull_area"), rounded("spread_x").alias("spread_x"), rounded("spread_y").alias("spread_y"), rounded("offset").alias("away"))


@query("largest_component", "WITH c AS (SELECT n_nationkey AS k, 3 + n_nationkey % 6 AS w FROM nation), b AS (SELECT arg_min(k, (-w, k)) AS k, max(w) AS w FROM c) SELECT b.k * 20 + i.range + j.range AS ix, i.range AS iy FROM b, range(8) i, range(8) j WHERE i.range < w AND j.range < w")
def largest_component(spark, d):
    """Slanted blocks of cells, apart from one another: the largest, of equal ones the first."""
    k = F.col("n_nationkey")
    blocks = table(spark, d, "nation").select(k.alias("k"), (3 + k % 6).alias("w"))
    cells = blocks.withColumn("iy", F.explode(F.expr("sequence(0L, w - 1)"))).withColumn("j", F.explode(F.expr("sequence(0L, w - 1)"))).select((F.col("k") * 20 + F.col("iy") + F.col("j")).alias("ix"), "iy")
    return clouds.largest_component(cells)


_RING = "SELECT event_id, ((event_id * 7919) % 8000) / 1000e0 - 4 AS x, ((event_id * 104729) % 8000) / 1000e0 - 4 AS y FROM events"


@query("ground_plane", f"WITH p AS ({_RING}), q AS (SELECT * FROM p WHERE sqrt(x * x + y * y) BETWEEN 0.5e0 AND 3.5e0) SELECT -6.5e0 AS z, 0.1e0 AS slope_x, -0.2e0 AS slope_y, count(*) AS n FROM q WHERE event_id % 50 > 0")
def ground_plane(spark, d):
    """Ground on a known plane, with a fiftieth of it far above: the plane, and as many points as lie on it."""
    e = F.col("event_id")
    x, y = (e * 7919) % 8000 / 1000 - 4, (e * 104729) % 8000 / 1000 - 4
    points = table(spark, d, "events").select(x.alias("x"), y.alias("y"), (-6.5 + 0.1 * x - 0.2 * y + F.when(e % 50 == 0, 8.0).otherwise(0.0)).alias("z"))
    fit = clouds.ground_plane(points, 0.0, 0.0, 0.5, 3.5, rounds=6)
    rows = spark.createDataFrame([(fit["z"], fit["slope_x"], fit["slope_y"], fit["n"])], "z double, slope_x double, slope_y double, n long")
    return rows.select(*(rounded(c).alias(c) for c in ("z", "slope_x", "slope_y")), "n")
