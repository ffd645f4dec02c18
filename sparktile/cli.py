"""Benchmark entry: a JSON configuration over a Matrix Market file or a Poisson box."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sparse import Matrix
from .operators.tensor import Tensor
from .session import get_session
from .shape import DistributedShape
from .solvers.config import from_json, parse_json
from .solvers.distributed import solve
from .sources import matrix_market
from .types import FLOAT64


def _vector(spark: SparkSession, value: float | str, n: int) -> DataFrame:
    """A constant, or a Matrix Market vector file."""
    if isinstance(value, str):
        return matrix_market.densify(matrix_market.read_vector(spark, value)[0], n)
    return spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v"))


def run(spark: SparkSession, config: dict[str, Any], matrix: Matrix, tiles: int | None = None) -> dict[str, Any]:
    """Solve, or one product; returns seconds, and a solver's stats."""
    n, kind = matrix.n_rows, config.get("benchmark")
    matrix = matrix.materialize()
    as_tensor = lambda df: Tensor(df.select("i", F.lit(0).alias("tile"), "v"), DistributedShape((n,)), FLOAT64)
    if kind == "spmv":
        begin = time.perf_counter()
        matrix.spmv(as_tensor(_vector(spark, config.get("x", 1.0), n))).materialize()
        return {"benchmark": kind, "seconds": time.perf_counter() - begin}
    if kind != "solve":
        raise ValueError(f"unknown benchmark {kind!r}")
    b = _vector(spark, config["b"], n) if "b" in config else matrix.products(_vector(spark, config.get("x", 1.0), n))
    begin = time.perf_counter()
    x, stats = solve(matrix, b, from_json(config["solver"]), _vector(spark, config.get("x0", 0.0), n), tiles)
    return {"benchmark": kind, "seconds": time.perf_counter() - begin, "x": x, "stats": stats}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparktile")
    parser.add_argument("-c", "--config", required=True)
    parser.add_argument("-t", "--tiles", type=int, help="as many as the system asks for, if not given")
    parser.add_argument("-d", "--explain", action="store_true", help="print the plan of one product")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("-m", "--matrix")
    source.add_argument("-p", "--poisson", help="nx,ny,nz")
    options = parser.parse_args(args)
    spark = get_session()
    config = parse_json(Path(options.config).read_text())
    if options.matrix:
        matrix = Matrix.from_matrix_market(spark, options.matrix)
    else:
        matrix = Matrix.poisson3d(spark, *(int(x) for x in options.poisson.split(",")))
    if options.explain:
        matrix.products(_vector(spark, 1.0, matrix.n_rows)).explain("formatted")
    out = run(spark, config, matrix, options.tiles)
    print(out["stats"].line() if "stats" in out else f"{out['benchmark']}: {out['seconds']:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
