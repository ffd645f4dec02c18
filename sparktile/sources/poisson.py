"""The 7-point Laplacian of a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poisson3d(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(row, col, val): 6 on the diagonal, -1 to each neighbour inside the box; rows run x first."""
    row = F.col("id")
    i, j, k = row % nx, F.floor(row / nx) % ny, F.floor(row / (nx * ny))
    entries = [F.struct(row.alias("col"), F.lit(6.0).alias("val"))]
    for inside, step in ((i > 0, -1), (i < nx - 1, 1), (j > 0, -nx), (j < ny - 1, nx), (k > 0, -nx * ny), (k < nz - 1, nx * ny)):
        entries.append(F.when(inside, F.struct((row + step).alias("col"), F.lit(-1.0).alias("val"))))
    return spark.range(nx * ny * nz).select(row.alias("row"), F.explode(F.array_compact(F.array(*entries))).alias("e")).select("row", "e.col", "e.val")
