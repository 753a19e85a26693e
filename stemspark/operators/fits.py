"""Circle, line and spread fits: closed forms as aggregates, robust fits in grouped Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 24


def circle_from_moments(points: DataFrame, keys: list[str], x="x", y="y") -> DataFrame:
    """Least-squares circle of each group: n, cx, cy, r; null where fewer than three points or no proper circle.

    Coordinates are taken from the group's mean first. One shuffle for the means, whose result joins the points' own partitioning.
    """
    means = points.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = points.join(means, keys).withColumns({"_u": F.col(x) - F.col("_mx"), "_v": F.col(y) - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    s = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * (u * u + v * v)).alias("uw"), F.sum(v * (u * u + v * v)).alias("vw"),
    )
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    safe = F.when((F.col("n") >= 3) & (F.abs(det) > 1e-18), 2 * det)
    cu = (F.col("uw") * F.col("vv") - F.col("vw") * F.col("uv")) / safe
    cv = (F.col("vw") * F.col("uu") - F.col("uw") * F.col("uv")) / safe
    r2 = cu * cu + cv * cv + (F.col("uu") + F.col("vv")) / F.col("n")
    return s.select(*keys, "n", (F.col("_mx") + cu).alias("cx"), (F.col("_my") + cv).alias("cy"), F.when(r2 > 0, F.sqrt(r2)).alias("r"))


def coverage(bin_column: Column, bins: int = BINS) -> Column:
    """The share of angular bins that occur; a bit a bin, so partial aggregates are one number."""
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bin_column))) / F.lit(float(bins))


def spread(rows: DataFrame, keys: list[str], r="r") -> DataFrame:
    """Coefficient of variation, with the mean kept off zero."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_slices"), (F.stddev_pop(r) / F.greatest(F.avg(r), F.lit(1e-6))).alias("radius_cv"))


def centre_spread(rows: DataFrame, keys: list[str], x="cx", y="cy") -> DataFrame:
    """The largest distance from the component-wise median centre."""
    middle = rows.groupBy(*keys).agg(F.median(x).alias("_x"), F.median(y).alias("_y"))
    return rows.join(middle, keys).groupBy(*keys).agg(F.max(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias("centre_spread"))


def axis_line(rows: DataFrame, keys: list[str], h="height", x="cx", y="cy") -> DataFrame:
    """Slopes and intercepts of the centres over height, and the largest distance from that line."""
    line = rows.groupBy(*keys).agg(F.regr_slope(x, h).alias("slope_x"), F.regr_intercept(x, h).alias("icpt_x"), F.regr_slope(y, h).alias("slope_y"), F.regr_intercept(y, h).alias("icpt_y"))
    off = F.hypot(F.col(x) - (F.col("slope_x") * F.col(h) + F.col("icpt_x")), F.col(y) - (F.col("slope_y") * F.col(h) + F.col("icpt_y")))
    return rows.join(line, keys).groupBy(*keys, "slope_x", "icpt_x", "slope_y", "icpt_y").agg(F.max(off).alias("line_residual"))


def verticality(points: np.ndarray) -> float:
    """The vertical part of the direction along which points (n, 3) spread most."""
    _, vectors = np.linalg.eigh(np.cov(points, rowvar=False))
    return float(abs(vectors[2, -1]))


# Robust fits. All hypotheses are arrays: triples, their circles, and the residuals of every point to every circle.


def circles_through(triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres (k, 2) and radii (k) of circles through triples (k, 3, 2); NaN where in line."""
    base = triples[:, 0]
    a, b = triples[:, 1] - base, triples[:, 2] - base
    twice = 2 * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    twice[np.abs(twice) < 1e-10] = np.nan
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    offset = np.stack([b[:, 1] * a2 - a[:, 1] * b2, a[:, 0] * b2 - b[:, 0] * a2], 1) / twice[:, None]
    return base + offset, np.hypot(*offset.T)


def circle_of(xy: np.ndarray):
    """Algebraic least-squares circle, or None."""
    if len(xy) < 3:
        return None
    mean = xy.mean(0)
    u = xy - mean
    w = (u * u).sum(1)
    s = u.T @ u
    det = s[0, 0] * s[1, 1] - s[0, 1] ** 2
    if abs(det) < 1e-18:
        return None
    centre = np.linalg.solve(2 * s, u.T @ w)
    r2 = centre @ centre + w.mean()
    return (mean + centre, float(np.sqrt(r2))) if r2 > 0 else None


def bins_hit(xy: np.ndarray, centre: np.ndarray, mask: np.ndarray | None = None) -> float:
    d = (xy if mask is None else xy[mask]) - centre
    if not len(d):
        return 0.0
    k = np.clip(((np.arctan2(d[:, 1], d[:, 0]) + np.pi) / (2 * np.pi) * BINS).astype(int), 0, BINS - 1)
    return len(np.unique(k)) / BINS


class Rules:
    """What a robust fit accepts and how it scores; see LOOSE and TIGHT."""

    def __init__(self, tries, least, sample, width, floor, ceiling, support, refits, last, drift, least_coverage=0.0):
        self.tries, self.least, self.sample, self.support, self.refits, self.last, self.drift, self.least_coverage = tries, least, sample, support, refits, last, drift, least_coverage
        self.tolerance = lambda r: np.clip(r * width, floor, ceiling)


#: Fixed values of the two fits: a first one on the sample, and one on all points around a known radius.
LOOSE = Rules(500, 10, 2500, 0.16, 0.018, 0.045, 8, 3, 10, 0.40)
TIGHT = Rules(900, 30, 6000, 0.13, 0.005, 0.020, 20, 4, 30, None, 0.25)


def robust_circle(xy: np.ndarray, seed: np.ndarray, rules: Rules, r_min: float, r_max: float, reach: float, score, rng: np.random.Generator):
    """dict(cx, cy, r, inliers, coverage, residual) or None. score: of (inliers, coverage, radius)."""
    if len(xy) < rules.least:
        return None
    fit = xy[:: max(1, -(-len(xy) // rules.sample))]
    picks = np.argsort(rng.random((rules.tries, min(len(fit), 64))), axis=1)[:, :3] if len(fit) <= 64 else rng.integers(0, len(fit), (rules.tries, 3))
    centres, radii = circles_through(fit[picks])
    good = np.isfinite(radii) & (radii >= r_min) & (radii <= r_max)
    good[good] = np.hypot(*(centres[good] - seed).T) <= reach
    best = None
    for centre, r in zip(centres[good], radii[good], strict=True):
        inside = np.abs(np.hypot(*(fit - centre).T) - r) <= rules.tolerance(r)
        n = int(inside.sum())
        if n >= rules.support and (best is None or score(n, 1.0, r) > best[0]):  # full coverage bounds the score
            value = score(n, bins_hit(fit, centre, inside), r)
            if best is None or value > best[0]:
                best = (value, centre, float(r))
    if best is None:
        return None
    _, centre, r = best
    for _ in range(rules.refits):
        again = circle_of(xy[np.abs(np.hypot(*(xy - centre).T) - r) <= rules.tolerance(r)])
        if again is None or not r_min <= again[1] <= r_max or np.hypot(*(again[0] - seed)) > (rules.drift or reach):
            break
        centre, r = again
    error = np.hypot(*(xy - centre).T) - r
    inside = np.abs(error) <= rules.tolerance(r)
    part = bins_hit(xy, centre, inside)
    if inside.sum() < rules.last or part < rules.least_coverage:
        return None
    return {"cx": float(centre[0]), "cy": float(centre[1]), "r": float(r), "inliers": int(inside.sum()), "coverage": part, "residual": float(np.sqrt(np.mean(error[inside] ** 2)))}


def first_circle(xy: np.ndarray, seed: np.ndarray, rng: np.random.Generator):
    """Compact circles win: support over radius."""
    return robust_circle(xy, seed, LOOSE, 0.025, 0.30, 0.38, lambda n, c, r: n * (0.35 + c) / (0.04 + r), rng)


def known_circle(xy: np.ndarray, seed: np.ndarray, prior: float, rng: np.random.Generator):
    """Around a preliminary radius."""
    return robust_circle(xy, seed, TIGHT, max(0.018, prior * 0.58), min(0.34, prior * 1.5), max(0.065, prior * 0.75), lambda n, c, r: n * (0.25 + c), rng)
