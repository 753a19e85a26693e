"""Searches among vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; two blocks meet in one task.
BLOCK = 4096


def nearest_in_blocks(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """query_id, nearest_id, distance: of each query the nearest other row, ties to the smaller key. Exact.

    Blocks of queries meet blocks of rows as products of matrices, so a task holds two blocks however large the tables are; a block
    of rows is sent once for each block of queries. Null vectors are left out.
    """
    n_queries, n_rows = (max(1, -(-t.count() // block)) for t in (queries, rows))
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n_queries)).cast("int").alias("i")).withColumn("j", tiles(n_rows))
    right = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n_rows)).cast("int").alias("j")).withColumn("i", tiles(n_queries))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table.column("v").combine_chunks()
        return table.column("k").to_numpy(), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            (ids, q), (others, v) = matrix(a), matrix(b)
            order = np.argsort(others, kind="stable")
            others, v = others[order], v[order]
            size = (v * v).sum(1)
            for at in range(0, len(q), 256):
                part, own = q[at : at + 256], ids[at : at + 256]
                rough = size - 2 * part @ v.T + (part * part).sum(1)[:, None]
                rough[own[:, None] == others] = np.inf
                # products round, so all that may be the nearest are measured again
                slack = 1e-9 * (1 + size.max() + (part * part).sum(1))
                for k, row in enumerate(rough):
                    if np.isfinite(row.min()):
                        near = np.flatnonzero(row <= row.min() + slack[k])
                        exact = ((v[near] - part[k]) ** 2).sum(1)
                        out.append((int(own[k]), int(others[near[exact.argmin()]]), float(np.sqrt(exact.min()))))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "nearest_id", "distance"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(best, "query_id long, nearest_id long, distance double")
    return found.groupBy("query_id").agg(F.min(F.struct("distance", "nearest_id")).alias("m")).select("query_id", "m.nearest_id", "m.distance")
