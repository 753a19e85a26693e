"""Greedy suppression of near duplicates, in rounds that equal the sequential order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settled

#: Radii are below 0.34 m, so conflicting centres are less than this apart.
REACH = 0.5


def conflicts(candidates: DataFrame) -> DataFrame:
    """winner, loser: pairs too close to both stay, better quality (then smaller id) first."""
    b = candidates.select(F.col("id").alias("id2"), F.col("cx").alias("cx2"), F.col("cy").alias("cy2"), F.col("r").alias("r2"), F.col("quality").alias("q2"))
    cells = F.array(*(F.struct((F.floor(F.col("cy2") / REACH) + i).alias("iy"), (F.floor(F.col("cx2") / REACH) + j).alias("ix")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    right = b.withColumn("c", F.explode(cells)).select("id2", "cx2", "cy2", "r2", "q2", F.col("c.iy").alias("iy2"), F.col("c.ix").alias("ix2"))
    left = candidates.withColumns({"iy": F.floor(F.col("cy") / REACH), "ix": F.floor(F.col("cx") / REACH)})
    close = F.hypot(F.col("cx") - F.col("cx2"), F.col("cy") - F.col("cy2")) < F.greatest(F.lit(0.2), 0.72 * (F.col("r") + F.col("r2")))
    better = (F.col("quality") > F.col("q2")) | ((F.col("quality") == F.col("q2")) & (F.col("id") < F.col("id2")))
    return left.join(right, (F.col("iy") == F.col("iy2")) & (F.col("ix") == F.col("ix2")) & close & better).select(F.col("id").alias("winner"), F.col("id2").alias("loser"))


def suppress(candidates: DataFrame) -> DataFrame:
    """The candidates (id, cx, cy, r, quality) a greedy pass by quality keeps.

    A round keeps all that no undecided better conflict outranks and drops what they conflict with; it ends when all are decided.
    """
    candidates = settled(candidates)
    pairs = settled(conflicts(candidates))
    open_, kept = candidates.select("id"), None
    while True:
        live = pairs.join(open_, pairs["winner"] == open_["id"], "left_semi").join(open_, pairs["loser"] == open_["id"], "left_semi")
        losers = live.select(F.col("loser").alias("id")).distinct()
        won = settled(open_.join(losers, "id", "left_anti"))
        kept = won if kept is None else kept.union(won)
        beaten = pairs.join(won, pairs["winner"] == won["id"], "left_semi").select(F.col("loser").alias("id")).distinct()
        open_ = settled(open_.join(won, "id", "left_anti").join(beaten, "id", "left_anti"))
        if open_.isEmpty():
            return candidates.join(kept, "id", "left_semi")
