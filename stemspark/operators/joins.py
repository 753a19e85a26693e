"""Spatial joins as equi-joins on cells, so that no plan needs a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settled

NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _cell(column: str, size: float):
    return F.floor(F.col(column) / F.lit(float(size)))


def radius_join(seeds: DataFrame, points: DataFrame, radius: float, sx="seed_x", sy="seed_y", px="x", py="y") -> DataFrame:
    """Pairs at most `radius` apart. Cells are one radius wide, so a seed only meets its 3 x 3 cells; either side may be the large one."""
    cells = F.array(*(F.struct((_cell(sy, radius) + dy).alias("iy"), (_cell(sx, radius) + dx).alias("ix")) for dy, dx in NEIGHBOURS))
    left = seeds.withColumn("_c", F.explode(cells)).select("*", F.col("_c.iy").alias("_iy"), F.col("_c.ix").alias("_ix")).drop("_c")
    right = points.withColumns({"_py": _cell(py, radius), "_px": _cell(px, radius)})
    dx, dy = F.col(px) - F.col(sx), F.col(py) - F.col(sy)
    near = dx * dx + dy * dy <= radius * radius
    return left.join(right, (F.col("_iy") == F.col("_py")) & (F.col("_ix") == F.col("_px")) & near).drop("_iy", "_ix", "_py", "_px")


def nearest_owner(cells: DataFrame, seeds: DataFrame, key="seed_id", cx="cell_x", cy="cell_y", sx="seed_x", sy="seed_y", reach: float | None = None) -> DataFrame:
    """iy, ix, owner, distance of every cell: its nearest seed, ties to the smaller key.

    reach: how far an owner matters; cells with none within it have no row, and the join is by cells of that width. Without it every
    cell has an owner, and the reach doubles until all have found one.
    """
    if reach:
        return _nearest_within(cells, seeds, key, cx, cy, sx, sy, reach)
    box = seeds.select(F.col(sx).alias("x"), F.col(sy).alias("y")).unionByName(cells.select(F.col(cx).alias("x"), F.col(cy).alias("y"))).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    n = seeds.count()
    if not n or not any(box):
        return _nearest_within(cells, seeds, key, cx, cy, sx, sy, 1.0)
    reach, open_, found = max(box) / max(1.0, n**0.5), cells.select("iy", "ix", cx, cy), None
    while True:
        here = settled(_nearest_within(open_, seeds, key, cx, cy, sx, sy, reach))
        found = here if found is None else found.unionByName(here)
        open_ = settled(open_.join(here, ["iy", "ix"], "left_anti"))
        if open_.isEmpty():
            return found
        reach *= 2


def _nearest_within(cells: DataFrame, seeds: DataFrame, key, cx, cy, sx, sy, reach: float) -> DataFrame:
    d2 = (F.col(cx) - F.col(sx)) ** 2 + (F.col(cy) - F.col(sy)) ** 2
    near = radius_join(seeds, cells, reach, sx, sy, cx, cy).withColumn("_d2", d2)
    return near.groupBy("iy", "ix").agg(F.min(F.struct("_d2", key)).alias("_m")).select("iy", "ix", F.col(f"_m.{key}").alias("owner"), F.sqrt("_m._d2").alias("distance"))


def unique_owners(owned: DataFrame) -> DataFrame:
    """The owners that have any point."""
    return owned.select("owner").distinct()


def owned_points(points: DataFrame, owners: DataFrame) -> DataFrame:
    """Points (iy, ix) with the owner of their cell: an inner equi-join."""
    return points.join(owners, ["iy", "ix"])


def strict_lookup(left: DataFrame, right: DataFrame, on: str, what: str = "record") -> DataFrame:
    """One right row for each left row, or the whole query fails and names up to five missing keys.

    Keys that occur twice on the right fail as well, since each left row must keep being one row.
    """
    twice = right.groupBy(on).count().where("count > 1").select(F.col(on).cast("string").alias("k"), F.lit("ambiguous").alias("why"))
    missing = left.join(right.select(on), on, "left_anti").select(F.coalesce(F.col(on).cast("string"), F.lit("null")).alias("k"), F.lit("missing").alias("why"))
    bad = missing.unionByName(twice).limit(5).collect()  # five rows for the message
    if bad:
        raise ValueError(f"no single {what} for: " + ", ".join(f"{r['k']} ({r['why']})" for r in bad))
    return left.join(right, on)


def members(left: DataFrame, right: DataFrame, on: str, inside: bool = True) -> DataFrame:
    return left.join(right.select(on), on, "left_semi" if inside else "left_anti")
