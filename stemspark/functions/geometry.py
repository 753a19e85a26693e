"""Scalar geometry as Column expressions, so that it stays inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAST_HEIGHT_CM = 130


def number(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def js_round(value, digits: int = 4) -> Column:
    """Half up towards positive infinity on the binary value; null for null, NaN and infinities."""
    x, f = number(value), F.lit(float(10**digits))
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.floor(x * f + 0.5).cast("double") / f)


def js_round_all(array, digits: int = 6) -> Column:
    """A vector rounded by element; null if there is none."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(a.isNotNull(), F.transform(a, lambda v: js_round(v, digits)))


def clip(value, low, high) -> Column:
    return F.greatest(number(low), F.least(number(high), number(value)))


def affine(raw, scale, offset) -> Column:
    """Stored integers to metres: scale first, then offset."""
    return number(raw) * number(scale) + number(offset)


def eight_bit(channel, most) -> Column:
    """16-bit colour as 8 bits, if the cloud's largest value needs it."""
    return F.when(number(most) > 255, F.shiftright(number(channel).cast("int"), 8)).otherwise(number(channel).cast("int"))


def to_scene(x="x", y="y", z="z") -> list[Column]:
    """Z-up to Y-up."""
    return [number(x).alias("scene_x"), number(z).alias("scene_y"), (-number(y)).alias("scene_z")]


def cell_index(value, low: float, size: float, n: int | None = None) -> Column:
    """Truncated, not floored; clipped to a grid of n cells if given."""
    i = ((number(value) - F.lit(float(low))) / F.lit(float(size))).cast("int")
    return i if n is None else F.greatest(F.lit(0), F.least(F.lit(n - 1), i))


def cell_centre(index, low: float, size: float) -> Column:
    return F.lit(float(low)) + (number(index) + 0.5) * F.lit(float(size))


def angular_bin(dy, dx, bins: int = 24) -> Column:
    turn = (F.atan2(number(dy), number(dx)) + F.pi()) / (2 * F.pi())
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), (turn * bins).cast("int")))


def radial_error(x, y, cx, cy, r) -> Column:
    return F.hypot(number(x) - number(cx), number(y) - number(cy)) - number(r)


def loose_tolerance(r) -> Column:
    return clip(number(r) * 0.16, 0.018, 0.045)


def tight_tolerance(r) -> Column:
    return clip(number(r) * 0.13, 0.005, 0.020)


def prior_bounds(prior) -> list[Column]:
    """Least and largest radius, and how far a centre may move, around a preliminary radius."""
    p = number(prior)
    return [F.greatest(F.lit(0.018), p * 0.58).alias("r_min"), F.least(F.lit(0.34), p * 1.5).alias("r_max"), F.greatest(F.lit(0.065), p * 0.75).alias("centre_tolerance")]


def circumcircle(x1, y1, x2, y2, x3, y3) -> Column:
    """struct(x, y, r) through three points, null where they are (almost) in line."""
    ax, ay, bx, by = number(x2) - number(x1), number(y2) - number(y1), number(x3) - number(x1), number(y3) - number(y1)
    twice = 2 * (ax * by - ay * bx)
    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
    safe = F.when(F.abs(twice) >= 1e-10, twice)
    ux, uy = (by * a2 - ay * b2) / safe, (ax * b2 - bx * a2) / safe
    return F.when(safe.isNotNull(), F.struct((number(x1) + ux).alias("x"), (number(y1) + uy).alias("y"), F.hypot(ux, uy).alias("r")))


Vector = list  # three Columns


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda s, t: s + t, (p * q for p, q in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector) -> Vector:
    size = F.sqrt(dot(a, a))
    return [c / size for c in a]


def plane_basis(axis: Vector) -> tuple[Vector, Vector]:
    """Two directions that span the plane across the axis; the helper direction avoids the axis's own."""
    steep = F.abs(axis[1]) < 0.9
    helper = [F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0)]
    u = unit(cross(axis, helper))
    return u, cross(axis, u)


def project(relative: Vector, axis: Vector, u: Vector, v: Vector) -> list[Column]:
    return [dot(relative, axis).alias("axial"), dot(relative, u).alias("u"), dot(relative, v).alias("v")]


def on_plane(centre: Column, basis_u: Column, basis_v: Column, u, v) -> Column:
    """The point of a plane (arrays of three) at coordinates u, v."""
    return F.array(*(centre[k] + basis_u[k] * number(u) + basis_v[k] * number(v) for k in range(3)))


def axis_point(slope_x, icpt_x, slope_y, icpt_y, ground, height) -> Vector:
    h = number(height)
    return [number(slope_x) * h + number(icpt_x), number(slope_y) * h + number(icpt_y), number(ground) + h]


def ground_centre(cx, cy, axis_x, axis_y, axis_z, height: float = 1.3) -> list[Column]:
    return [(number(cx) - number(axis_x) / number(axis_z) * height).alias("ground_x"), (number(cy) - number(axis_y) / number(axis_z) * height).alias("ground_y")]


def ground_point(centre: Column, axis: Column, height: Column) -> Column:
    """Down the axis, which is flipped if it points down."""
    up = F.when(axis[2] < 0, F.transform(axis, lambda a: -a)).otherwise(axis)
    return F.array(*(centre[k] - up[k] * height for k in range(3)))


def dbh_cm(r) -> Column:
    return number(r) * 200


def circumference(r) -> Column:
    return F.lit(2.0) * F.pi() * number(r)


def first_score(inliers, coverage, upright, slices, r, residual):
    """Of numbers or Columns; upright is 0.1 at least."""
    return inliers * (0.4 + coverage) * upright * (slices / 5) / ((0.04 + r) * (1 + 8 * residual))


def final_score(inliers, coverage, slices, r, residual):
    return inliers * (0.35 + coverage) * (slices / 5) / ((0.04 + r) * (1 + 12 * residual))


def first_quality(inliers, coverage, verticality, slices, r, residual) -> Column:
    return first_score(number(inliers), number(coverage), F.greatest(number(verticality), F.lit(0.1)), number(slices), number(r), number(residual))


def final_quality(inliers, coverage, slices, r, residual) -> Column:
    return final_score(number(inliers), number(coverage), number(slices), number(r), number(residual))


def rotate(x, y, z, yaw: float, pitch: float) -> list[Column]:
    """About the vertical, then about the view's horizontal: screen right, screen up, depth."""
    cy, sy, cp, sp = (f(F.lit(float(a))) for a in (yaw, pitch) for f in (F.cos, F.sin))
    right, ahead = cy * number(x) - sy * number(y), sy * number(x) + cy * number(y)
    return [right.alias("right"), (cp * number(z) - sp * ahead).alias("up"), (sp * number(z) + cp * ahead).alias("depth")]


def world_per_pixel(distance, near: float, view_degrees: float, height_pixels: int) -> Column:
    """The width of a screen pixel at a distance, but not nearer than the camera sees, for a vertical angle of view."""
    away = F.greatest(number(distance), F.lit(float(near)))
    return away * 2 * F.tan(F.radians(F.lit(view_degrees / 2))) / max(height_pixels, 1)


def step_for(n, budget) -> Column:
    """Every how many points to keep, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(number(n) / number(budget)).cast("bigint"))


def tube_radius(r) -> Column:
    return clip(number(r) * 0.085, 0.018, 0.05)
