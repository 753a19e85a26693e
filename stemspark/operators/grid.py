"""Cell binning, histograms by height band, smoothing and local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settled

#: The analysis window in metres, half-open.
X_MIN, X_MAX, Y_MIN, Y_MAX = 5.0, 45.0, -25.0, 5.0


def in_window(points: DataFrame) -> DataFrame:
    return points.where((F.col("x") >= X_MIN) & (F.col("x") < X_MAX) & (F.col("y") >= Y_MIN) & (F.col("y") < Y_MAX))


def cell(column, low: float, size: float):
    return F.floor((F.col(column) - low) / F.lit(float(size))).cast("int")


def band_of(bands, hag="hag"):
    """The number of the half-open band that holds the height, else null."""
    found = None
    for i, (low, high) in enumerate(bands):
        hit = (F.col(hag) >= float(low)) & (F.col(hag) < float(high))
        found = F.when(hit, i) if found is None else found.when(hit, i)
    return found


def band_histogram(points: DataFrame, bands, size: float) -> DataFrame:
    """band, iy, ix, n of the occupied cells; counts combine before the shuffle."""
    binned = in_window(points).select(band_of(bands).alias("band"), cell("y", Y_MIN, size).alias("iy"), cell("x", X_MIN, size).alias("ix"))
    return binned.where("band IS NOT NULL").groupBy("band", "iy", "ix").agg(F.count("*").alias("n"))


def band_minimum(histogram: DataFrame, n_bands: int) -> DataFrame:
    """The least count over all bands; a cell that lacks a band counts zero there and is left out."""
    return histogram.groupBy("iy", "ix").agg(F.min("n").alias("score"), F.count("*").alias("bands")).where(F.col("bands") == n_bands).drop("bands")


def zero_filled(histogram: DataFrame, n_bands: int, ny: int, nx: int) -> DataFrame:
    """All cells of all bands, empty ones as 0. The spine is the raster itself, whatever the cloud's size."""
    spine = histogram.sparkSession.range(n_bands * ny * nx).selectExpr(f"cast(id div {ny * nx} as int) AS band", f"cast(id div {nx} % {ny} as int) AS iy", f"cast(id % {nx} as int) AS ix")
    return spine.join(histogram, ["band", "iy", "ix"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gaussian_weights(sigma: float) -> list[float]:
    """A kernel cut at four sigmas."""
    import math

    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _reflected(i, n: int):
    """An index beyond the edge comes back: the edge cell is repeated."""
    j = F.pmod(i, F.lit(2 * n))
    return F.when(j >= n, 2 * n - 1 - j).otherwise(j).cast("int")


def smoothed(histogram: DataFrame, ny: int, nx: int, sigma: float = 1.2, value: str = "n") -> DataFrame:
    """Gaussian smoothing of each band, along x and then y; a value spreads from its cell, so empty cells cost nothing."""
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    table = F.array(*(F.struct(F.lit(k - reach).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    out = histogram.select("band", "iy", "ix", F.col(value).cast("double").alias("v"))
    for axis, n in (("ix", nx), ("iy", ny)):
        other = "iy" if axis == "ix" else "ix"
        # a cell near an edge also reaches its neighbours by reflection: images of the cell beyond both edges spread as well
        images = F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis))
        spread = out.withColumn("image", F.explode(images)).where((F.col("image") >= -reach) & (F.col("image") < n + reach)).withColumn("t", F.explode(table))
        moved = spread.select("band", other, (F.col("image") + F.col("t.k")).cast("int").alias(axis), (F.col("v") * F.col("t.w")).alias("v"))
        out = moved.where((F.col(axis) >= 0) & (F.col(axis) < n)).groupBy("band", "iy", "ix").agg(F.sum("v").alias("v"))
    return out


def local_maxima(score: DataFrame, spacing: int = 4, threshold: float = 0.0) -> DataFrame:
    """Cells (iy, ix, score) above the threshold that no cell within `spacing` beats; of equal neighbours, the better ranked stays.

    The window maximum is an equi-join on shifted cells; ties are settled as a greedy pass by (score, iy, ix) would.
    """
    high = score.where(F.col("score") > threshold).select("iy", "ix", "score")
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-spacing, spacing + 1) for j in range(-spacing, spacing + 1)))
    reach = high.withColumn("o", F.explode(offsets)).select((F.col("iy") + F.col("o.i")).alias("iy"), (F.col("ix") + F.col("o.j")).alias("ix"), F.col("score").alias("other"))
    best = reach.groupBy("iy", "ix").agg(F.max("other").alias("best"))
    peaks = settled(high.join(best, ["iy", "ix"]).where(F.col("score") == F.col("best")).select("iy", "ix", "score"))
    kept, open_ = None, peaks.withColumns({"by": F.floor(F.col("iy") / (spacing + 1)), "bx": F.floor(F.col("ix") / (spacing + 1))})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))

    def near(rows, others):
        """Rows with the others of the same score within the spacing: by blocks of that width, so that a common score is no key of its own."""
        spread = others.withColumn("o", F.explode(around)).select((F.col("by") + F.col("o.i")).alias("by"), (F.col("bx") + F.col("o.j")).alias("bx"), "score", F.col("iy").alias("oy"), F.col("ix").alias("ox"))
        return rows.join(spread, ["by", "bx", "score"]).where((F.abs(F.col("iy") - F.col("oy")) <= spacing) & (F.abs(F.col("ix") - F.col("ox")) <= spacing))

    while True:  # only equal scores can still be close to one another
        first = (F.col("oy") < F.col("iy")) | ((F.col("oy") == F.col("iy")) & (F.col("ox") < F.col("ix")))
        won = settled(open_.join(near(open_, open_).where(first).select("iy", "ix").distinct(), ["iy", "ix"], "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        open_ = settled(open_.join(near(open_, won).select("iy", "ix").distinct(), ["iy", "ix"], "left_anti"))
        if open_.isEmpty():
            return kept.select("iy", "ix", "score")
