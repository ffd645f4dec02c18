"""Rows dealt to tiles; interior, separator and halo rows; local numbers; level sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .levels import levels_of
from .sparse import Matrix

INTERIOR, SEPARATOR, HALO = 0, 1, 2
BLOCK_ROWS = 4096


def running_total(df: DataFrame, key: str, value: str, n: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` over all rows up to this one by ``key`` (0 to n - 1).

    Blocks of neighbouring keys are summed first, the few sums are added up, and each
    block adds up its own rows: no task sees more than a block or the sums.
    """
    size = max(block, int(n**0.5))
    marked = df.withColumn("_block", F.floor(F.col(key) / size))
    sums = marked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(key))
    return marked.withColumn("_inside", inside).join(before.select("_block", "_before"), "_block").withColumn("total", F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")


def partition_rows(matrix: Matrix, tiles: int) -> DataFrame:
    """(row, tile): contiguous blocks of about equal weight, a row weighing its entries and one more."""
    n = matrix.n_rows
    if tiles == 1:
        return matrix.spark.range(n).select(F.col("id").alias("row"), F.lit(0).alias("tile"))
    weight = matrix.df.select("row", F.lit(1).alias("w")).unionAll(matrix.spark.range(n).select("id", F.lit(1))).groupBy("row").agg(F.sum("w").alias("w"))
    total = matrix.df.count() + n
    placed = running_total(weight, "row", "w", n)
    raw = F.least(F.floor((F.col("total") - F.col("w")) * tiles / total), F.lit(tiles - 1)).cast("int")
    rows = placed.select("row", raw.alias("raw"))
    used = rows.select("raw").distinct()  # at most one row a tile
    dense = used.withColumn("tile", F.row_number().over(Window.orderBy("raw")) - 1)
    return rows.join(F.broadcast(dense), "raw").select("row", F.col("tile").cast("int").alias("tile"))


def tile_starts(matrix: Matrix, tiles: int) -> tuple[np.ndarray, int]:
    """The first rows of the tiles that ``partition_rows`` deals, and the entries' number; only blocks' sums reach the driver."""
    n = matrix.n_rows
    size = max(BLOCK_ROWS, int(n**0.5))
    weights = np.minimum(size, n - np.arange(0, n, size))
    block = F.expr(f"row div {size}").cast("long")
    for r in matrix.df.groupBy(block.alias("block")).count().toPandas().itertuples():
        weights[r.block] += r.count
    ends = np.cumsum(weights)
    total = int(ends[-1]) if n else 0
    if tiles == 1 or not total:
        return np.zeros(1, np.int64), total - n
    begin = ends - weights
    raw = lambda before: np.minimum(before * tiles // total, tiles - 1)
    inside = [int(b) for b in np.flatnonzero(raw(begin) != raw(ends))]  # blocks in which, or right after which, a tile begins
    if not inside:
        return np.zeros(1, np.int64), total - n
    known = matrix.spark.createDataFrame(pa.table({"block": inside, "before": begin[inside]}))
    every = known.select(F.explode(F.expr(f"sequence(block * {size}L, least((block + 1) * {size}L, {n}L) - 1)")).alias("row"))
    rows = matrix.df.select("row").where(block.isin(inside)).unionAll(every).groupBy("row").count()
    last = F.sum("count").over(Window.partitionBy("block").orderBy("row"))
    placed = rows.withColumn("block", block).join(F.broadcast(known), "block").select("row", "count", (F.col("before") + last).alias("end"))
    dealt = lambda end: F.least(F.expr(f"({end}) * {tiles} div {total}"), F.lit(tiles - 1))
    found = placed.where(dealt("end") != dealt("end - count")).select(F.col("row") + 1).toPandas().iloc[:, 0].to_numpy(np.int64)
    return np.unique(np.append(0, found[found < n])).astype(np.int64), total - n


def partition_box(spark, nx: int, ny: int, nz: int, parts: tuple[int, int, int]) -> DataFrame:
    """(row, tile) of a box cut into equal boxes."""
    px, py, pz = parts
    row = F.col("id")
    cut = lambda x, n, p: F.least(F.floor(x * p / n), F.lit(p - 1))
    i, j, k = row % nx, F.floor(row / nx) % ny, F.floor(row / (nx * ny))
    return spark.range(nx * ny * nz).select(row.alias("row"), ((cut(k, nz, pz) * py + cut(j, ny, py)) * px + cut(i, nx, px)).cast("int").alias("tile"))


def imbalance(partition: DataFrame) -> DataFrame:
    """One row: the least and most rows of a tile and (most - least) / least."""
    sizes = partition.groupBy("tile").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), ((F.max("n") - F.min("n")) / F.min("n")).alias("imbalance"))


def edge_tiles(matrix: Matrix, partition: DataFrame) -> DataFrame:
    """Entries with the tiles of their row and column."""
    rows = partition.select("row", F.col("tile").alias("row_tile"))
    cols = partition.select(F.col("row").alias("col"), F.col("tile").alias("col_tile"))
    return matrix.df.join(rows, "row").join(cols, "col")


def tile_layout(matrix: Matrix, partition: DataFrame) -> DataFrame:
    """(tile, local_row, global_row, kind, region, owner).

    A row that other tiles' rows refer to is a separator of its tile, in the region
    named by the set of those tiles, and a halo row of each of them; others are
    interior. Local numbers run interior, separators, halos, by region and row.
    """
    needs = edge_tiles(matrix, partition).where("row_tile <> col_tile").select(F.col("col").alias("row"), F.col("col_tile").alias("owner"), F.col("row_tile").alias("reader")).distinct()
    readers = needs.groupBy("row").agg(F.array_sort(F.collect_set("reader")).alias("readers"))
    own = partition.join(readers, "row", "left")
    region = F.concat_ws(",", F.col("readers").cast("array<string>"))
    owned = own.select("tile", F.col("row").alias("global_row"), F.when(F.col("readers").isNull(), INTERIOR).otherwise(SEPARATOR).alias("kind"), F.coalesce(region, F.lit("")).alias("region"), F.col("tile").alias("owner"))
    halo = needs.join(readers, "row").select(F.col("reader").alias("tile"), F.col("row").alias("global_row"), F.lit(HALO).alias("kind"), F.concat(F.col("owner").cast("string"), F.lit(":"), region).alias("region"), "owner")
    local = F.row_number().over(Window.partitionBy("tile").orderBy("kind", "region", "global_row")) - 1
    return owned.union(halo).select("tile", local.cast("bigint").alias("local_row"), "global_row", "kind", "region", "owner")


def vector_shape(layout: DataFrame, with_halo: bool = False) -> dict[int, int]:
    """Rows by tile."""
    rows = layout if with_halo else layout.where(F.col("kind") != HALO)
    return {r.tile: r.n for r in rows.groupBy("tile").agg(F.count("*").alias("n")).collect()}


def exchange_halo(layout: DataFrame, x: DataFrame) -> DataFrame:
    """(tile, local_row, v) of the halo rows, with their owners' current values."""
    return layout.where(F.col("kind") == HALO).join(x.select(F.col("i").alias("global_row"), "v"), "global_row").select("tile", "local_row", "v")


def strip_halo(layout: DataFrame) -> DataFrame:
    return layout.where(F.col("kind") != HALO)


def decompose_vector(layout: DataFrame, x: DataFrame, with_halo: bool = True) -> DataFrame:
    """A global vector in each tile's order."""
    rows = layout if with_halo else strip_halo(layout)
    return rows.join(x.select(F.col("i").alias("global_row"), "v"), "global_row").select("tile", "local_row", "global_row", "kind", "v")


def local_addressing(matrix: Matrix, layout: DataFrame) -> DataFrame:
    """Entries in local numbers: (tile, local_row, local_col, val)."""
    own = strip_halo(layout).select("tile", F.col("global_row").alias("row"), "local_row")
    seen = layout.select("tile", F.col("global_row").alias("col"), F.col("local_row").alias("local_col"))
    return matrix.df.join(own, "row").join(seen, ["tile", "col"]).select("tile", "local_row", "local_col", "val")


def row_levels(matrix: Matrix, partition: DataFrame) -> DataFrame:
    """(tile, row, level) of the lower triangle inside each tile; references to other tiles do not count."""
    inside = edge_tiles(matrix, partition).where("row_tile = col_tile").select(F.col("row_tile").alias("tile"), "row", "col")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["row"], pdf["col"]]))
        rows, cols = np.searchsorted(ids, pdf["row"]), np.searchsorted(ids, pdf["col"])
        level = levels_of(rows[cols < rows], cols[cols < rows], len(ids))
        return pd.DataFrame({"tile": pdf["tile"].iloc[0], "row": ids, "level": level})

    found = inside.groupBy("tile").applyInPandas(run, "tile int, row long, level long")
    return partition.join(found, ["tile", "row"], "left").select("tile", "row", F.coalesce("level", F.lit(0)).alias("level"))


def color_addressing(levels: DataFrame) -> DataFrame:
    """(tile, level, start, n): where each level starts in the tile's rows ordered by level."""
    sizes = levels.groupBy("tile", "level").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("tile").orderBy("level")) - F.col("n")
    return sizes.select("tile", "level", start.alias("start"), "n")


def recommend_multicolor(levels: DataFrame) -> bool:
    """Whether more than nine tenths of the rows are in levels of more than twelve rows."""
    sizes = levels.groupBy("tile", "level").agg(F.count("*").alias("n"))
    r = sizes.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("n") > 12, F.col("n"))), F.lit(0)).alias("large")).first()
    return bool(r["all"]) and r.large > 0.9 * r["all"]

