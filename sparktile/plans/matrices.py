"""Queries of sources, sparse products, layouts and solvers."""

from __future__ import annotations

import uuid
from functools import partial, reduce
from operator import add, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.sparse import Matrix
from ..operators.tensor import Tensor
from ..session import shared_dir
from ..shape import DistributedShape
from ..solvers.config import from_json
from ..solvers.distributed import Image, solve
from ..sources import matrix_market
from ..types import FLOAT32, FLOAT64
from .tables import customer_part, part_vector, supplier_part, table, user_hour

BOX = (8, 6, 5)
_NX, _NY, _NZ = BOX
_N = _NX * _NY * _NZ
#: The box's matrix in SQL.
_POISSON = f"""
WITH p AS (SELECT range AS row, range % {_NX} AS x, range // {_NX} % {_NY} AS y, range // {_NX * _NY} AS z FROM range({_N})),
a AS (
  SELECT row, row AS col, 6.0::DOUBLE AS val FROM p
  UNION ALL SELECT row, row - 1, -1.0 FROM p WHERE x > 0 UNION ALL SELECT row, row + 1, -1.0 FROM p WHERE x < {_NX - 1}
  UNION ALL SELECT row, row - {_NX}, -1.0 FROM p WHERE y > 0 UNION ALL SELECT row, row + {_NX}, -1.0 FROM p WHERE y < {_NY - 1}
  UNION ALL SELECT row, row - {_NX * _NY}, -1.0 FROM p WHERE z > 0 UNION ALL SELECT row, row + {_NX * _NY}, -1.0 FROM p WHERE z < {_NZ - 1}
)"""


def _box(spark: SparkSession) -> Matrix:
    return Matrix.poisson3d(spark, *BOX)


def _ones(spark: SparkSession, n: int = _N, value: float = 1.0) -> Tensor:
    return Tensor.with_initial_value(spark, value, DistributedShape((n,)), FLOAT64)


def _ramp(spark: SparkSession, n: int = _N) -> Tensor:
    return Tensor.iota(spark, DistributedShape((n,)), FLOAT64)


def _rounded(t: Tensor, digits: int = 3) -> DataFrame:
    return t.df.select("i", F.round(F.col("v").cast("double"), digits).alias("v"))


# --- sparse products ------------------------------------------------------------------
def _spmv_customer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(customer_part(spark, sf_dir).spmv(part_vector(spark, sf_dir, F.col("p_retailprice"), FLOAT64)), 2)


def _spmv_supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(supplier_part(spark, sf_dir).spmv(part_vector(spark, sf_dir, F.col("p_size").cast("double"), FLOAT64)), 2)


def _spmv_user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(user_hour(spark, sf_dir).spmv(_ramp(spark, 24)), 2)


def _poisson_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box(spark).df.select("row", "col", "val")


def _poisson_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_box(spark).spmv(_ones(spark)))


def _faces(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A chain of 100 cells with different coefficients each way."""
    cells = spark.range(100)
    faces = cells.where("id < 99").select(F.col("id").alias("lower"), (F.col("id") + 1).alias("upper"), (-1.0 - F.col("id") / 10).alias("upper_val"), F.lit(-2.0).alias("lower_val"))
    return cells.select(F.col("id").alias("row"), (F.col("id") + 10.0).alias("val")), faces


def _ldu_spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Matrix.from_ldu(*_faces(spark), 100).spmv(_ramp(spark, 100)))


def _ldu_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    diag, faces = _faces(spark)
    return _rounded(Matrix.from_ldu(diag, faces.drop("lower_val"), 100).spmv(_ramp(spark, 100)))


def _to_ldu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box(spark).to_ldu()[1].select("lower", "upper", "lower_val", "upper_val")


def _crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box(spark).crs().select("row", "row_ptr", "diag", F.size("cols").alias("n"), F.array_join(F.col("cols").cast("array<string>"), ",").alias("cols"))


def _residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_box(spark).residual(_ramp(spark), _ones(spark)))


def _residual_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single-precision matrix and vector, computed in double."""
    a = _box(spark).cast(FLOAT32)
    x = (_ramp(spark) / 3.0).cast(FLOAT32).lazy()
    return _rounded(a.residual(x, _ones(spark).cast(FLOAT32).lazy(), FLOAT64, FLOAT64), 4)


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries: those of one customer and part add up."""
    return customer_part(spark, sf_dir).df.select("row", "col", F.round("val", 2).alias("val"))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read again."""
    path = f"{shared_dir(spark)}/market-{uuid.uuid4().hex}"
    matrix_market.write_triplets(_box(spark).df, path, _N, _N)
    return Matrix.from_matrix_market(spark, path).df.select("row", "col", "val")


def _densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v"))
    return matrix_market.densify(v, table(spark, sf_dir, "part").count())


# --- layouts ----------------------------------------------------------------------
def _partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.partition_rows(_box(spark), 4).select("row", "tile")


def _imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.imbalance(layout.partition_rows(_box(spark), 4)).select("least", "most", F.round("imbalance", 6).alias("imbalance"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    return layout.tile_layout(a, layout.partition_rows(a, 4)).select("tile", "local_row", "global_row", "kind", "region")


def _halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    found = layout.tile_layout(a, layout.partition_rows(a, 4))
    return layout.exchange_halo(found, _ramp(spark).df.select("i", "v")).select("tile", "local_row", "v")


def _addressing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    return layout.local_addressing(a, layout.tile_layout(a, layout.partition_rows(a, 4))).select("tile", "local_row", "local_col", "val")


def _decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    found = layout.tile_layout(a, layout.partition_rows(a, 4))
    return layout.decompose_vector(found, _ramp(spark).df.select("i", "v")).select("tile", "local_row", "kind", "v")


def _box_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.partition_box(spark, *BOX, (2, 2, 1)).select("row", "tile")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    return layout.row_levels(a, layout.partition_rows(a, 1)).select("row", "level")


def _colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _box(spark)
    return layout.color_addressing(layout.row_levels(a, layout.partition_rows(a, 1))).select("tile", "level", "start", "n")


# --- solvers -------------------------------------------------------------------------
_ILU = {"type": "ILU"}
#: Every solver, nested as the benchmark configurations nest them.
SOLVERS = {
    "bicgstab": {"type": "PBiCGStab", "relResidual": 1e-9, "maxIterations": 200},
    "bicgstab_ilu": {"type": "PBiCGStab", "relResidual": 1e-9, "maxIterations": 200, "preconditioner": _ILU},
    "bicgstab_dilu": {"type": "PBiCGStab", "relResidual": 1e-9, "maxIterations": 200, "preconditioner": {"type": "ILU", "diagonalBased": True}},
    "bicgstab_gs": {"type": "PBiCGStab", "relResidual": 1e-9, "maxIterations": 200, "preconditioner": {"type": "GaussSeidel", "numFixedIterations": 2}},
    "gauss_seidel": {"type": "GaussSeidel", "relResidual": 1e-7, "maxIterations": 1000},
    "gauss_seidel_fixed": {"type": "GaussSeidel", "numFixedIterations": 150},
    "refinement": {"type": "IterativeRefinement", "relResidual": 1e-9, "maxIterations": 20, "extendedPrecisionType": "float64", "innerSolver": {"type": "PBiCGStab", "relResidual": 1e-3, "maxIterations": 50, "preconditioner": _ILU}},
    "refinement_twofloat": {"type": "IterativeRefinement", "relResidual": 1e-9, "maxIterations": 20, "extendedPrecisionType": "twofloat32", "innerSolver": {"type": "PBiCGStab", "workingType": "float32", "relResidual": 1e-3, "maxIterations": 50}},
    "refinement_gs": {"type": "IterativeRefinement", "relResidual": 1e-8, "maxIterations": 20, "innerSolver": {"type": "GaussSeidel", "numFixedIterations": 30}},
    "refinement_ilu": {"type": "IterativeRefinement", "relResidual": 1e-8, "maxIterations": 200, "innerSolver": _ILU},
    "restarter": {"type": "restarter", "maxRestarts": 5, "innerSolver": {"type": "PBiCGStab", "relResidual": 1e-6, "maxIterations": 6, "preconditioner": _ILU}},
}


def _solve(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """b = A 1 on the box: the solution is one everywhere."""
    a = _box(spark).materialize()
    x, _ = solve(a, a.spmv(_ones(spark)), from_json(SOLVERS[name]))
    return _rounded(x)


def _solve_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over four tiles, distributed."""
    a = Matrix.poisson3d(spark, 4, 4, 4).materialize()
    config = from_json({"type": "PBiCGStab", "relResidual": 1e-5, "maxIterations": 20, "preconditioner": _ILU})
    x, _ = solve(a, a.spmv(_ones(spark, 64)), config, tiles=4, where="distributed")
    return _rounded(x)


def _solve_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nonsymmetric, diagonally dominant system over the nations of suppliers and customers."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    counts = c.groupBy("c_nationkey").count().withColumnRenamed("count", "nc").join(s.groupBy("s_nationkey").count().withColumnRenamed("count", "ns"), (F.col("c_nationkey") + 1) % 25 == F.col("s_nationkey"))
    off = counts.select(F.col("c_nationkey").alias("row"), F.col("s_nationkey").alias("col"), (-F.col("ns") / (F.col("nc") + F.col("ns"))).alias("val"))
    eye = spark.range(25).select("id", "id", F.lit(2.0))
    a = Matrix.from_coo(off.union(eye), n_rows=25, n_cols=25).materialize()
    x, _ = solve(a, a.spmv(_ones(spark, 25)), from_json(SOLVERS["bicgstab_ilu"]))
    return _rounded(x)


#: Solvers over four tiles of a system of the orders' size, distributed.
TILE_SOLVERS = {
    "bicgstab": {"type": "PBiCGStab", "relResidual": 1e-7, "maxIterations": 50, "preconditioner": _ILU},
    "gauss_seidel": {"type": "GaussSeidel", "relResidual": 1e-7, "maxIterations": 50},
    "refinement": {"type": "IterativeRefinement", "relResidual": 1e-7, "maxIterations": 20, "extendedPrecisionType": "float64", "innerSolver": {"type": "PBiCGStab", "workingType": "float32", "relResidual": 1e-3, "maxIterations": 10}},
    "dilu": {"type": "IterativeRefinement", "relResidual": 1e-7, "maxIterations": 50, "innerSolver": {"type": "ILU", "diagonalBased": True}},
    "restarter": {"type": "restarter", "maxRestarts": 10, "innerSolver": {"type": "PBiCGStab", "relResidual": 1e-3, "maxIterations": 3, "preconditioner": _ILU}},
}


def _order_system(spark: SparkSession, sf_dir: str) -> tuple[Matrix, DataFrame]:
    """Each order is coupled to its neighbours and to one that its customer picks; x is o_custkey % 7 + 1.

    Keys are dense from 0: were one there twice, another row would have no diagonal entry.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("row"), F.col("o_custkey").cast("bigint").alias("c"))
    n = orders.count()
    k = F.col("row")
    terms = [(k, 16.0), ((k + 1) % n, -1.0), ((k + n - 1) % n, -2.0), ((k * 7 + F.col("c")) % n, -1.0)]
    named = orders.select("row", *(col.cast("bigint").alias(f"c{i}") for i, (col, _) in enumerate(terms)))
    cols = [F.col(f"c{i}") for i in range(len(terms))]
    # A row's entries all come from its order: those of one place are summed at the first of them, without a shuffle.
    # Columns and values have names, as their expressions inside one another are computed wherever they are used.
    summed = [reduce(add, (F.when(cols[j] == col, terms[j][1]).otherwise(0.0) for j in range(i + 1, len(cols))), F.lit(terms[i][1])) for i, col in enumerate(cols)]
    again = [reduce(or_, (col == before for before in cols[:i]), F.lit(False)) for i, col in enumerate(cols)]
    found = named.select("row", *cols, *(F.when(~seen, val).alias(f"v{i}") for i, (seen, val) in enumerate(zip(again, summed, strict=True))))
    entries = F.array(*(F.struct(col.alias("col"), F.col(f"v{i}").alias("val")) for i, col in enumerate(cols)))
    exploded = found.select("row", F.explode(entries).alias("e")).where("e.val is not null")
    a = Matrix.from_coo(exploded, "row", "e.col", "e.val", n, n, unique=True).materialize()
    return a, orders.select(F.col("row").alias("i"), (F.col("c") % 7 + 1).cast("double").alias("v"))


def _solve_order_tiles(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    a, x = _order_system(spark, sf_dir)
    found, _ = solve(a, Image(x), from_json(TILE_SOLVERS[name]), tiles=4, where="distributed")
    return _rounded(found, 2)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of Gauss-Seidel on a bidiagonal matrix of the parts' size, which are known in closed form."""
    n = table(spark, sf_dir, "part").count()
    row = F.col("id")
    entries = spark.range(n).select(row, row, F.lit(4.0)).union(spark.range(n - 1).select(row, row + 1, F.lit(1.0))).toDF("row", "col", "val")
    a = Matrix.from_coo(entries, n_rows=n, n_cols=n, unique=True).materialize()
    _, stats = solve(a, a.spmv(_ones(spark, n)), from_json({"type": "GaussSeidel", "maxIterations": 8}))
    return stats.to_dataframe(spark).select("iteration", F.round("residual", 6).alias("residual"))


def _vector_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tile of a vector over a layout, with and without the halo."""
    a = _box(spark)
    found = layout.tile_layout(a, layout.partition_rows(a, 4))
    own, every = layout.vector_shape(found), layout.vector_shape(found, True)
    return spark.createDataFrame([(t, own[t], every[t]) for t in sorted(every)], "tile int, own long, every long")


def _recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether level sets pay: on a wide box they do, on a chain they do not."""
    wide, chain = Matrix.poisson3d(spark, 12, 12, 12), Matrix.poisson3d(spark, 100, 1, 1)
    told = [(name, layout.recommend_multicolor(layout.row_levels(a, layout.partition_rows(a, 1)))) for name, a in (("box", wide), ("chain", chain))]
    return spark.createDataFrame(told, "name string, multicolor boolean")


def _million(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of a Poisson box of a million rows."""
    return _rounded(Matrix.poisson3d(spark, 100, 100, 100).spmv(_ones(spark, 1_000_000)))


QUERIES = {
    "spmv_customer_part": _spmv_customer_part,
    "spmv_supplier_part": _spmv_supplier_part,
    "spmv_user_hour": _spmv_user_hour,
    "poisson_coo": _poisson_coo,
    "poisson_row_sums": _poisson_row_sums,
    "ldu_spmv": _ldu_spmv,
    "ldu_symmetric": _ldu_symmetric,
    "to_ldu": _to_ldu,
    "crs": _crs,
    "residual": _residual,
    "residual_mixed": _residual_mixed,
    "sum_duplicates": _duplicates,
    "matrix_market": _market,
    "densify_vector": _densify,
    "tile_partition": _partition,
    "box_partition": _box_partition,
    "imbalance": _imbalance,
    "tile_layout": _layout,
    "halo_cells": _halo,
    "local_addressing": _addressing,
    "decompose_vector": _decompose,
    "row_levels": _levels,
    "color_addressing": _colors,
    "solve_tiles": _solve_tiles,
    "solve_nations": _solve_graph,
    "solver_stats": _stats,
    "vector_shape": _vector_shape,
    "recommend_multicolor": _recommend,
    "poisson_million": _million,
} | {f"solve_tiles_{k}": partial(_solve_order_tiles, k) for k in TILE_SOLVERS} | {f"solve_{k}": partial(_solve, k) for k in SOLVERS}

_CP = "SELECT o_custkey AS row, l_partkey AS col, sum(l_quantity) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
_W = f"""{_POISSON}, w AS (SELECT row, count(*) + 1 AS w FROM a GROUP BY row),
s AS (SELECT row, sum(w) OVER (ORDER BY row) AS total, w, (SELECT sum(w) FROM w) AS everything FROM w),
tile AS (SELECT row, (dense_rank() OVER (ORDER BY raw) - 1)::INTEGER AS tile FROM (SELECT row, least((total - w) * 4 // everything, 3) AS raw FROM s))"""
_LAYOUT = f"""{_W}, need AS (
  SELECT DISTINCT a.col AS row, c.tile AS owner, r.tile AS reader FROM a JOIN tile r ON r.row = a.row JOIN tile c ON c.row = a.col WHERE r.tile <> c.tile
), readers AS (SELECT row, string_agg(reader::VARCHAR, ',' ORDER BY reader) AS region FROM need GROUP BY row
), every AS (
  SELECT tile.tile, tile.row AS global_row, CASE WHEN region IS NULL THEN 0 ELSE 1 END AS kind, coalesce(region, '') AS region FROM tile LEFT JOIN readers ON readers.row = tile.row
  UNION ALL SELECT reader, need.row, 2, owner || ':' || region FROM need JOIN readers ON readers.row = need.row
), numbered AS (SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY kind, region, global_row) - 1 AS local_row, global_row, kind, region FROM every)"""
_LDU = "WITH c AS (SELECT range AS id FROM range(100))"
_ALL_ONE = "SELECT range AS i, 1.0::DOUBLE AS v FROM range({0})"
ORACLE = {
    "spmv_customer_part": f"SELECT c_custkey AS i, round(coalesce(sum(val * p_retailprice), 0), 2) AS v FROM customer LEFT JOIN ({_CP}) ON row = c_custkey LEFT JOIN part ON p_partkey = col GROUP BY ALL",
    "spmv_supplier_part": "SELECT s_suppkey AS i, round(coalesce(sum(l_extendedprice * p_size), 0), 2) AS v FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "spmv_user_hour": "SELECT range AS i, round(coalesce(sum(hour(ts)), 0)::DOUBLE, 2) AS v FROM range((SELECT max(user_id) + 1 FROM events)) LEFT JOIN events ON user_id = range GROUP BY ALL",
    "poisson_coo": f"{_POISSON} SELECT row, col, val FROM a",
    "poisson_row_sums": f"{_POISSON} SELECT row AS i, round(sum(val), 3) AS v FROM a GROUP BY row",
    "ldu_spmv": f"{_LDU} SELECT id AS i, round((id + 10.0) * id + CASE WHEN id < 99 THEN (-1.0 - id / 10.0) * (id + 1) ELSE 0 END + CASE WHEN id > 0 THEN -2.0 * (id - 1) ELSE 0 END, 3)::DOUBLE AS v FROM c",
    "ldu_symmetric": f"{_LDU} SELECT id AS i, round((id + 10.0) * id + CASE WHEN id < 99 THEN (-1.0 - id / 10.0) * (id + 1) ELSE 0 END + CASE WHEN id > 0 THEN (-1.0 - (id - 1) / 10.0) * (id - 1) ELSE 0 END, 3)::DOUBLE AS v FROM c",
    "to_ldu": f"{_POISSON} SELECT least(row, col) AS lower, greatest(row, col) AS upper, sum(val) FILTER (WHERE row > col) AS lower_val, sum(val) FILTER (WHERE row < col) AS upper_val FROM a WHERE row <> col GROUP BY ALL",
    "crs": f"{_POISSON}, g AS (SELECT row, sum(val) FILTER (WHERE row = col) AS diag, count(*) FILTER (WHERE row <> col)::INTEGER AS n, string_agg(col::VARCHAR, ',' ORDER BY col) FILTER (WHERE row <> col) AS cols FROM a GROUP BY row) SELECT row, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS row_ptr, diag, n, cols FROM g",
    "residual": f"{_POISSON} SELECT row AS i, round(1 - sum(val * col), 3) AS v FROM a GROUP BY row",
    "residual_mixed": f"{_POISSON} SELECT row AS i, round(1 - sum(val * (col / 3.0::DOUBLE)::FLOAT::DOUBLE), 4) AS v FROM a GROUP BY row",
    "sum_duplicates": f"SELECT row, col, round(val, 2) AS val FROM ({_CP})",
    "matrix_market": f"{_POISSON} SELECT row, col, val FROM a",
    "densify_vector": "SELECT p_partkey AS i, CASE WHEN p_size > 25 THEN p_size ELSE 0 END::DOUBLE AS v FROM part",
    "tile_partition": f"{_W} SELECT row, tile FROM tile",
    "box_partition": f"{_POISSON} SELECT row, ((y * 2 // {_NY}) * 2 + x * 2 // {_NX})::INTEGER AS tile FROM p",
    "imbalance": f"{_W} SELECT min(n) AS least, max(n) AS most, round((max(n) - min(n)) / min(n)::DOUBLE, 6) AS imbalance FROM (SELECT count(*) AS n FROM tile GROUP BY tile)",
    "tile_layout": f"{_LAYOUT} SELECT tile, local_row, global_row, kind, region FROM numbered",
    "halo_cells": f"{_LAYOUT} SELECT tile, local_row, global_row::DOUBLE AS v FROM numbered WHERE kind = 2",
    "local_addressing": f"{_LAYOUT} SELECT r.tile, r.local_row, c.local_row AS local_col, a.val FROM a JOIN numbered r ON r.global_row = a.row AND r.kind < 2 JOIN numbered c ON c.global_row = a.col AND c.tile = r.tile",
    "decompose_vector": f"{_LAYOUT} SELECT tile, local_row, kind, global_row::DOUBLE AS v FROM numbered",
    "row_levels": f"{_POISSON} SELECT row, x + y + z AS level FROM p",
    "color_addressing": f"{_POISSON}, c AS (SELECT x + y + z AS level, count(*) AS n FROM p GROUP BY ALL) SELECT 0::INTEGER AS tile, level, (sum(n) OVER (ORDER BY level) - n)::BIGINT AS start, n FROM c",
    "solve_tiles": _ALL_ONE.format(64),
    "solve_nations": _ALL_ONE.format(25),
    "solver_stats": "SELECT range::INTEGER AS iteration, round(pow(0.25, range) * sqrt(25 * ((SELECT count(*) FROM part) - range - 1) + 16), 6) AS residual FROM range(9)",
    "vector_shape": f"{_LAYOUT} SELECT tile, count(*) FILTER (WHERE kind < 2) AS own, count(*) AS every FROM numbered GROUP BY tile",
    "recommend_multicolor": "SELECT * FROM (VALUES ('box', true), ('chain', false)) AS t(name, multicolor)",
    "poisson_million": "SELECT range AS i, round(6.0::DOUBLE - (range % 100 > 0)::INTEGER - (range % 100 < 99)::INTEGER - (range // 100 % 100 > 0)::INTEGER - (range // 100 % 100 < 99)::INTEGER - (range // 10000 > 0)::INTEGER - (range // 10000 < 99)::INTEGER, 3) AS v FROM range(1000000)",
} | {f"solve_tiles_{k}": "SELECT o_orderkey AS i, (o_custkey % 7 + 1)::DOUBLE AS v FROM orders" for k in TILE_SOLVERS} | {f"solve_{k}": _ALL_ONE.format(_N) for k in SOLVERS}
