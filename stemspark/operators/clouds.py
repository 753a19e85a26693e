"""Whole-cloud aggregates: extents, spheres, crowns, ground."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settled


def extent(points: DataFrame, columns=("x", "y", "z")) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n_points"))


def recentred(points: DataFrame, narrow: bool = True) -> DataFrame:
    """Coordinates less the middle of their extent, as stored floats; one row is broadcast."""
    box = points.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"_{c}") for c in ("x", "y", "z")))
    moved = points.crossJoin(F.broadcast(box))
    return moved.withColumns({c: (F.col(c) - F.col(f"_{c}")).cast("float" if narrow else "double") for c in ("x", "y", "z")}).drop("_x", "_y", "_z")


def shifted_colours(points: DataFrame) -> DataFrame:
    """All colours as 8 bits, shifted if any of them needs more."""
    most = points.agg(F.max(F.greatest("r", "g", "b")).alias("_most"))
    return points.crossJoin(F.broadcast(most)).withColumns({c: F.when(F.col("_most") > 255, F.shiftright(c, 8)).otherwise(F.col(c)) for c in ("r", "g", "b")}).drop("_most")


def sampled_cloud(points: DataFrame) -> DataFrame:
    """recentred and shifted_colours in one pass over the points for both: the extent and the largest colour are one row, which is broadcast."""
    facts = points.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"_{c}") for c in "xyz"), F.max(F.greatest("r", "g", "b")).alias("_most"))
    wide = points.crossJoin(F.broadcast(facts))
    moved = {c: (F.col(c) - F.col(f"_{c}")).cast("float") for c in "xyz"} | {c: F.when(F.col("_most") > 255, F.shiftright(c, 8)).otherwise(F.col(c)) for c in "rgb"}
    return wide.withColumns(moved).drop("_x", "_y", "_z", "_most")


def alignment(preview: DataFrame, full: DataFrame) -> DataFrame:
    """One row: what moves a recentred preview to the full cloud, from the first point of both (point_index 0)."""
    first = lambda points, p: points.where("point_index = 0").select(*(F.col(c).cast("double").alias(p + c) for c in "xyz"))
    return first(full, "f").crossJoin(F.broadcast(first(preview, "p"))).select(*((F.col(f"f{c}") - F.col(f"p{c}")).alias(f"d{c}") for c in "xyz"))


def aligned(preview: DataFrame, full: DataFrame) -> DataFrame:
    """The preview in the full cloud's coordinates; the one row of the alignment is broadcast."""
    return preview.crossJoin(F.broadcast(alignment(preview, full))).withColumns({c: F.col(c).cast("double") + F.col(f"d{c}") for c in "xyz"}).drop("dx", "dy", "dz")


def bounding_sphere(points: DataFrame) -> DataFrame:
    """Centre of the box, and the largest distance from it."""
    box = points.agg(*(((F.min(c) + F.max(c)) / 2).alias(f"centre_{c}") for c in ("x", "y", "z")))
    d2 = sum((F.col(c) - F.col(f"centre_{c}")) ** 2 for c in ("x", "y", "z"))
    return points.crossJoin(F.broadcast(box)).groupBy("centre_x", "centre_y", "centre_z").agg(F.sqrt(F.max(d2)).alias("radius"))


def local_ground(z="z", hint: float = -6.68):
    """A low percentile, kept near the survey's ground."""
    return F.greatest(F.lit(hint - 0.25), F.least(F.lit(hint + 0.45), F.percentile(z, F.lit(0.025))))


def trunk_slice(cx: float, cy: float, r: float, z: float):
    return (F.abs(F.col("z") - z) <= 0.035) & (F.hypot(F.col("x") - cx, F.col("y") - cy) <= r + 0.06)


def crown_ellipse(cx: float, cy: float, rx: float, ry: float, low: float, high: float):
    ex, ey = (F.col("x") - cx) / rx, (F.col("y") - cy) / ry
    return (F.col("z") >= low) & (F.col("z") <= high) & (ex * ex + ey * ey <= 1.08)


def hull_area(xy: np.ndarray) -> float:
    """Area of the convex hull (monotone chain)."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return 0.0

    def half(rows):
        chain: list = []
        for q in rows:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (q[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (q[0] - chain[-2][0]):
                chain.pop()
            chain.append(q)
        return chain[:-1]

    ring = np.array(half(p) + half(p[::-1]))
    return float(abs(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1))) / 2)


def crown_metrics(points: DataFrame, keys: list[str], cell: float = 0.04) -> DataFrame:
    """Spread (1st to 99th percentile), centroid and hull area of each crown's occupied cells.

    Points reduce to distinct cells first, so a group is bounded by its crown's area.
    """
    cells = points.select(*keys, F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy")).distinct()
    stats = points.groupBy(*keys).agg(*((F.percentile(c, F.lit(0.99)) - F.percentile(c, F.lit(0.01))).alias(f"spread_{c}") for c in ("x", "y")), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))

    def hull(group: pd.DataFrame) -> pd.DataFrame:
        corners = np.concatenate([(group[["ix", "iy"]].to_numpy(float) + d) * cell for d in ((0, 0), (0, 1), (1, 0), (1, 1))])
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "cells": [len(group)], "hull_area": [hull_area(corners)]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema) + ", cells long, hull_area double"
    return stats.join(cells.groupBy(*keys).applyInPandas(hull, schema), keys)


def offset_from_trunk(metrics: DataFrame, x: float, y: float) -> DataFrame:
    """How far each crown's centroid is from a trunk, and by which east and north parts."""
    dx, dy = F.col("centroid_x") - x, F.col("centroid_y") - y
    return metrics.withColumns({"offset_x": dx, "offset_y": dy, "offset": F.hypot(dx, dy)})


def largest_component(cells: DataFrame) -> DataFrame:
    """ix, iy of the largest 8-connected set of occupied cells; of equal sizes the one with the smallest (iy, ix).

    A round takes the least label of the neighbours, and then that of the cell so named, so that labels travel in doubling steps.
    """
    here = F.struct("iy", "ix")
    grid = settled(cells.select("ix", "iy").distinct().withColumn("label", here))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    before = None
    while True:
        spread = grid.withColumn("o", F.explode(offsets)).select((F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), "label")
        met = settled(spread.groupBy("ix", "iy").agg(F.min("label").alias("label")).join(grid.select("ix", "iy"), ["ix", "iy"]))
        # the cell that a label names may know a smaller one by now, and so may each cell that bore the old label
        named = met.select(here.alias("label"), F.col("label").alias("further"))
        grid = settled(met.join(named, "label", "left").select("ix", "iy", F.least("label", F.coalesce("further", "label")).alias("label")))
        now = grid.agg(F.sum(F.xxhash64("ix", "iy", "label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            best = grid.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)
            return grid.join(F.broadcast(best), "label").select("ix", "iy")
        before = now


def ground_plane(points: DataFrame, cx: float, cy: float, inner: float, outer: float, rounds: int = 3, keep: float = 2.0) -> dict:
    """z = a + b x + c y of the ground around a trunk: least squares in an annulus, outliers left out in further rounds. Only sums reach the driver."""
    u, v, z = F.col("x") - cx, F.col("y") - cy, F.col("z")
    ring = points.where(F.hypot(u, v).between(inner, outer))
    fit, chosen = None, ring
    for _ in range(rounds):
        terms = [F.lit(1.0), u, v]
        sums = chosen.agg(*(F.sum(a * b).alias(f"s{i}{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)), *(F.sum(a * z).alias(f"t{i}") for i, a in enumerate(terms)), F.sum(z * z).alias("zz"), F.count("*").alias("n")).first()
        if not sums["n"] or sums["n"] < 3:
            break
        m, t = np.array([[sums[f"s{i}{j}"] for j in range(3)] for i in range(3)]), np.array([sums[f"t{i}"] for i in range(3)])
        a = np.linalg.lstsq(m, t, rcond=None)[0]
        sigma = float(np.sqrt(max(0.0, (sums["zz"] - a @ t) / sums["n"])))
        fit = {"z": float(a[0]), "slope_x": float(a[1]), "slope_y": float(a[2]), "sigma": sigma, "n": sums["n"]}
        chosen = ring.where(F.abs(z - (a[0] + a[1] * u + a[2] * v)) <= keep * sigma + 1e-9)
    return fit or {}
