"""Solvers over matrices of any size: loops on the driver, vectors on the executors.

The matrix is written once in blocks, bucketed by tile, so that no step moves it again;
each tile's kernel (sweep or triangular solve) runs on the tile's rows alone, a chunk at
a time. Scalars of one step are sums over chunks; state is written to the shared folder
once a step, so plans stay short and a lost executor repeats one step.

A small system of one tile may be solved inside one task instead. Both places read the
same configuration, compute in the same types, and tell and time their runs alike.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layout import tile_starts
from ..operators.sparse import Matrix
from ..operators.tensor import Tensor
from ..session import dropped, written
from ..shape import DistributedShape
from ..types import FLOAT64, DType
from .blocks import Blocks, Vector, dtype_of
from .config import GaussSeidelConfig, ILUConfig, IterativeRefinementConfig, PBiCGStabConfig, RestarterConfig, SolverConfig
from .local import Csr, LocalSolver
from .stats import SolverStats

#: Systems of up to so many rows and entries may be solved inside one task.
LOCAL_ROWS, LOCAL_ENTRIES = 20_000, 400_000
#: Rows and entries of a tile, where the number of tiles is not given.
TILE_ROWS, TILE_ENTRIES = 50_000, 1_000_000


def _kind(t: DType | None, default: str) -> str:
    """What a solver computes in, as a column type: single precision for float32, else double."""
    return default if t is None else "float" if t.spark == "float" else "double"


def _wider(*kinds: str) -> str:
    return "double" if "double" in kinds else "float"


def _share(x: np.ndarray, kind: str) -> float:
    """What a chunk adds to a norm."""
    x = x.astype(np.float64)
    return float({"L1": lambda: np.abs(x).sum(), "L2": lambda: (x * x).sum(), "LINF": lambda: np.abs(x).max(initial=0.0)}[kind]())


def _dot(u: np.ndarray, v: np.ndarray) -> float:
    return float((u.astype(np.float64) * v).sum())


@dataclass(frozen=True)
class Image:
    """A right-hand side A x by its x: in blocks a product moves packed values only, as a join of frames does not."""

    x: Tensor | DataFrame


class System:
    """A square matrix in blocks, its rows dealt to tiles; rows are numbered tile by tile."""

    def __init__(self, matrix: Matrix, tiles: int = 1, partition: DataFrame | None = None):
        if matrix.n_rows != matrix.n_cols:
            raise ValueError("a solver needs a square matrix")
        self.n, self.tiles, self.kind, self.places = matrix.n_rows, tiles, _kind(matrix.dtype, "double"), None
        made: list[DataFrame] = []
        if not hasattr(matrix.df, "_tile_path"):
            matrix = matrix.materialize()
            made.append(matrix.df)
        if partition is None:
            starts, count = tile_starts(matrix, tiles)
        else:
            sizes = partition.groupBy("tile").count().orderBy("tile").toPandas()
            starts, count = np.append(0, np.cumsum(sizes["count"].to_numpy())[:-1]), matrix.df.count()
            begin = F.broadcast(matrix.spark.createDataFrame([(int(t), int(s)) for t, s in zip(sizes["tile"], starts, strict=True)], "tile int, begin long"))
            place = F.row_number().over(Window.partitionBy("tile").orderBy("row")) - 1 + F.col("begin")
            self.places = written(partition.join(begin, "tile").select("row", place.cast("bigint").alias("place")))
        entries = matrix.df.select("row", "col", F.col("val").cast("double").alias("val"))
        if self.places is not None:
            for side in ("row", "col"):
                entries = entries.join(self.places.select(F.col("row").alias(side), F.col("place").alias(f"new_{side}")), side)
            entries = entries.select(F.col("new_row").alias("row"), F.col("new_col").alias("col"), "val")
        self.blocks = Blocks(entries, self.n, count, starts, self.kind)
        dropped(*made)

    def vector(self, df: DataFrame) -> Vector:
        if self.places is not None:
            df = df.join(self.places, df["i"] == self.places["row"]).select(F.col("place").alias("i"), "v")
        return self.blocks.vector(df, self.kind)

    def image(self, df: DataFrame) -> Vector:
        x = self.vector(df)
        out, _ = self.blocks.product(x, self.kind, {}, {"v": self.kind}, lambda ax, _: {"v": ax})
        self.blocks.drop(x)
        return out["v"]

    def frame(self, x: Vector) -> DataFrame:
        df = self.blocks.frame(x)
        if self.places is not None:
            df = df.join(self.places, df["i"] == self.places["place"]).select(F.col("row").alias("i"), "v")
        return df

    def drop(self) -> None:
        self.blocks.close()
        dropped(self.places)


class DistributedSolver:
    """A solver of any kind over a system; ``kind`` is the type of the vectors that it is given. No guess means zeros."""

    def __init__(self, system: System, config: SolverConfig, lines: list[str] | None = None, kind: str | None = None):
        self.system, self.config, self.lines, self.given = system, config, lines if lines is not None else [], kind or system.kind
        self.blocks = system.blocks
        self.stats = SolverStats(config.type, getattr(config, "norm", "L2"), system.tiles)
        self.factors: DataFrame | None = None
        self.kind = self.given if not isinstance(config, IterativeRefinementConfig) else _kind(config.extendedPrecisionType, "double")
        if isinstance(config, (PBiCGStabConfig, GaussSeidelConfig)):
            self.kind = _kind(config.workingType, self.given)
        inner = getattr(config, "innerSolver", None) or getattr(config, "preconditioner", None)
        passed = system.kind if isinstance(config, IterativeRefinementConfig) else self.kind
        self.inner = DistributedSolver(system, inner, self.lines, passed) if inner else None

    def solve(self, x: Vector | None, b: Vector) -> Vector | None:
        self.stats = SolverStats(self.config.type, getattr(self.config, "norm", "L2"), self.system.tiles, lines=self.lines)
        run = {PBiCGStabConfig: self._bicgstab, IterativeRefinementConfig: self._refine, GaussSeidelConfig: self._gauss_seidel, ILUConfig: self._ilu, RestarterConfig: self._restart}[type(self.config)]
        out = run(x, b)
        self.stats.finish(self.config)
        return out

    def _named(self, name: str) -> str:
        """A norm's share by chunk: of the maximum norm the largest counts, of others the sum."""
        return f"max_{name}" if self.stats.norm == "LINF" else name

    def _norm(self, found: float) -> float:
        return math.sqrt(found) if self.stats.norm == "L2" else found

    def _cast(self, x: Vector, kind: str) -> Vector:
        return self.blocks.combine({"x": x}, {"v": kind}, lambda a: {"v": a["x"]})[0]["v"]

    def _begin(self, x: Vector | None, b: Vector, kind: str) -> tuple[Vector, float]:
        """The first residual, and its square."""
        r, s, norm, number = self._named("r"), self._named("s"), self.stats.norm, dtype_of(kind)

        def told(rest: np.ndarray, right: np.ndarray) -> dict:
            return {"v": rest, r: _share(rest, norm), s: _share(right, norm), "dot": _dot(rest, rest)}

        dots = (r, s, "dot")
        if x is None:
            out, d = self.blocks.combine({"b": b}, {"v": kind}, lambda a: told(a["b"].astype(number), a["b"].astype(number)), dots)
        else:
            out, d = self.blocks.product(x, kind, {"b": b}, {"v": kind}, lambda ax, a: told(a["b"].astype(number) - ax, a["b"].astype(number)), dots)
        self.stats.start(self._norm(d[r]), self._norm(d[s]))
        return out["v"], d["dot"]

    def _restart(self, x: Vector | None, b: Vector) -> Vector | None:
        x = self.inner.solve(x, b)
        for _ in range(self.config.maxRestarts):
            if self.inner.stats.converged:
                break
            old, x = x, self.inner.solve(x, b)
            if old is not x:
                self.blocks.drop(old)
        self.stats = self.inner.stats
        return x

    def _refine(self, x: Vector | None, b: Vector) -> Vector | None:
        """The residual and the sum in the wide type, the inner solver in the matrix's own."""
        c, stats, blocks, wide, phi = self.config, self.stats, self.blocks, dtype_of(self.kind), x
        norm, name = stats.norm, self._named("r")
        r, _ = self._begin(phi, b, self.kind)
        while stats.goes_on(c):
            given = self._cast(r, self.system.kind) if self.system.kind == "float" != r.kind else r
            step = self.inner.solve(None, given)
            if step is not None:
                parts = {"d": step} | ({} if phi is None else {"phi": phi})
                new = blocks.combine(parts, {"v": self.kind}, lambda a: {"v": a["d"].astype(wide) + (a["phi"].astype(wide) if "phi" in a else wide.type(0))})[0]["v"]
                blocks.drop(step, phi if phi is not x else None, r, given)
                phi = new
                out, d = blocks.product(phi, self.kind, {"b": b}, {"v": self.kind}, lambda ax, a: {"v": a["b"].astype(wide) - ax, name: _share(a["b"].astype(wide) - ax, norm)}, (name,))
                r, last = out["v"], self._norm(d[name])
            else:
                last = stats.final_residual
            stats.iterations += 1
            stats.check(last, c)
        blocks.drop(r)
        return phi

    # --- tile kernels -------------------------------------------------------------
    def _ilu(self, x: Vector | None, b: Vector) -> Vector:
        """Couplings to other tiles do not count: each tile is factorised alone, once; its factors are kept."""
        if self.factors is None:
            self.factors = self.blocks.factors(self.config.diagonalBased)
        self.stats.iterations = 1
        return self.blocks.substitute(self.factors, b, self.config.diagonalBased)

    def _gauss_seidel(self, x: Vector | None, b: Vector) -> Vector:
        """Sweeps of every tile over its rows, with the other tiles' values of the sweep before.

        A sweep's product with the values before it tells their residual too, so both are
        one pass; the last one's sweep is left out of the result.
        """
        c, stats, blocks = self.config, self.stats, self.blocks
        kind = _wider(self.kind, self.system.kind)
        norm, wide, r, s = stats.norm, dtype_of(kind), self._named("r"), self._named("s")
        x = blocks.zeros(self.kind) if x is None else x if x.kind == self.kind else self._cast(x, self.kind)
        if c.numFixedIterations:
            for _ in range(c.numFixedIterations):
                old, (x, _) = x, blocks.sweep(x, b, kind, lambda ax, b: {})
                blocks.drop(old)
            stats.iterations = c.numFixedIterations
            return x

        def look(x: Vector) -> tuple[Vector, float, float]:
            after, d = blocks.sweep(x, b, kind, lambda ax, b: {r: _share(b.astype(wide) - ax, norm), s: _share(b, norm)}, (r, s))
            return after, self._norm(d[r]), self._norm(d[s])

        after, residual, size = look(x)
        stats.start(residual, size)
        while stats.goes_on(c):
            for _ in range(c.numSweeps):
                blocks.drop(x)
                x = after
                after, residual, _ = look(x)
            stats.iterations += c.numSweeps
            stats.check(residual, c)
        blocks.drop(after)
        return x

    # --- PBiCGStab -------------------------------------------------------------
    def _preconditioned(self, x: Vector) -> Vector:
        return x if self.inner is None else self.inner.solve(None, x) or self.blocks.zeros(self.kind)

    def _bicgstab(self, x: Vector | None, b: Vector) -> Vector | None:
        """Each vector is written once a step: p, v, s, t, and x with r."""
        c, stats, blocks, kind, begun = self.config, self.stats, self.blocks, self.kind, x
        number, norm, name = dtype_of(kind).type, stats.norm, self._named("norm")
        r, rho = self._begin(x, b, kind)
        shadow = p = r
        v, rho_old, alpha, omega = None, 1.0, 1.0, 1.0
        while stats.goes_on(c):
            if stats.mark_singular(rho):
                break
            if v is not None:
                beta, w = number(rho / rho_old * alpha / omega), number(omega)
                old, p = p, blocks.combine({"r": r, "p": p, "v": v}, {"v": kind}, lambda a: {"v": a["r"] + beta * (a["p"] - w * a["v"])})[0]["v"]
                blocks.drop(old if old is not shadow else None, v)
            y = self._preconditioned(p)
            out, d = blocks.product(y, kind, {"shadow": shadow}, {"v": kind}, lambda ax, a: {"v": ax, "dot": _dot(a["shadow"], ax)}, ("dot",))
            v = out["v"]
            if stats.mark_singular(d["dot"]):
                break
            alpha = rho / d["dot"]
            by = number(alpha)
            s = blocks.combine({"r": r, "v": v}, {"v": kind}, lambda a: {"v": a["r"] - by * a["v"]})[0]["v"]
            z = self._preconditioned(s)
            out, d = blocks.product(z, kind, {"s": s}, {"v": kind}, lambda ax, a: {"v": ax, "ts": _dot(ax, a["s"]), "tt": _dot(ax, ax)}, ("ts", "tt"))
            t, exact = out["v"], d["tt"] == 0.0  # s is zero: the half step is the solution
            omega = 0.0 if exact else d["ts"] / d["tt"]
            if not exact:
                stats.mark_singular(omega)
            residual, rho_old = stats.final_residual, rho
            if not stats.singular:
                w, parts = number(omega), {"y": y, "z": z, "s": s, "t": t, "shadow": shadow} | ({} if x is None else {"x": x})

                def update(a: dict[str, np.ndarray]) -> dict:
                    step = by * a["y"].astype(number) + w * a["z"].astype(number)
                    rest = a["s"] - w * a["t"]
                    return {"x": a["x"].astype(number) + step if "x" in a else step, "r": rest, name: _share(rest, norm), "rho": _dot(a["shadow"], rest)}

                out, d = blocks.combine(parts, {"x": kind, "r": kind}, update, (name, "rho"))
                # x and r share a table, which goes as one
                blocks.drop(x if x is not begun else None, y if y is not p else None, z if z is not s else None, s, t)
                x, r = out["x"], out["r"]
                residual, rho = self._norm(d[name]), d["rho"]
            stats.iterations += 1
            stats.check(residual, c)
            if exact:
                break
        blocks.drop(shadow, p, v)
        return x


def _solve_local(matrix: Matrix, x: DataFrame, b: DataFrame, config: SolverConfig) -> tuple[DataFrame, SolverStats]:
    """The whole system inside one task; its size has been checked."""
    n, kind = matrix.n_rows, np.dtype(np.float32 if _kind(matrix.dtype, "double") == "float" else np.float64)
    rows = matrix.df.select(F.lit(0).alias("part"), "row", "col", F.col("val").cast("double").alias("val"))
    vectors = x.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "b"), "i").select("i", F.col("x").cast("double"), F.col("b").cast("double"))
    both = rows.unionByName(vectors.select(F.lit(1).alias("part"), F.col("i").alias("row"), F.lit(0).cast("bigint").alias("col"), F.col("x").alias("val"))).unionByName(
        vectors.select(F.lit(2).alias("part"), F.col("i").alias("row"), F.lit(0).cast("bigint").alias("col"), F.col("b").alias("val"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf[pdf["part"] == 0]
        csr = Csr(a["row"].to_numpy(), a["col"].to_numpy(), a["val"].to_numpy(), n, kind)
        vx, vb = np.zeros(n), np.zeros(n)
        for part, v in ((1, vx), (2, vb)):
            p = pdf[pdf["part"] == part]
            v[p["row"].to_numpy()] = p["val"].to_numpy()
        solver = LocalSolver(csr, config)
        out = solver.solve(vx.astype(kind), vb.astype(kind))
        s = solver.stats
        told = [float(s.iterations), float(s.converged), float(s.singular), s.norm_factor, s.seconds, *s.history]
        said = json.dumps(solver.lines)
        return pd.DataFrame({"part": [0] * n + [1] * len(told) + [2], "i": [*range(n), *range(len(told)), 0], "v": [*out.astype(float), *told, 0.0], "said": [None] * (n + len(told)) + [said]})

    done = written(both.withColumn("system", F.lit(0)).groupBy("system").applyInPandas(run, "part int, i long, v double, said string"))
    told = [r.v for r in done.where("part = 1").orderBy("i").collect()]
    lines = json.loads(done.where("part = 2").first()["said"])
    stats = SolverStats(config.type, getattr(config, "norm", "L2"), 1, iterations=int(told[0]), converged=bool(told[1]), singular=bool(told[2]), norm_factor=told[3], seconds=told[4], history=told[5:], lines=lines)
    if stats.history:
        stats.initial_residual, stats.final_residual = stats.history[0], stats.history[-1]
    return done.where("part = 0").select("i", "v"), stats


def solve(matrix: Matrix, b: Tensor | DataFrame | Image, config: SolverConfig, x0: Tensor | DataFrame | float = 0.0, tiles: int | None = None, where: str = "auto", partition: DataFrame | None = None) -> tuple[Tensor, SolverStats]:
    """x with A x = b, and what was told on the way, which is printed.

    ``where``: local (one task), distributed, or auto: local for one tile and a small
    system. Without ``tiles`` there are as many as the rows and entries ask for.
    """
    kind = _kind(matrix.dtype, "double")
    frame = lambda v: (v.df if isinstance(v, Tensor) else v).select("i", F.col("v").cast(kind).alias("v"))
    x = frame(x0) if not isinstance(x0, (int, float)) else matrix.spark.range(matrix.n_rows).select(F.col("id").alias("i"), F.lit(float(x0)).cast(kind).alias("v"))
    if tiles is None or where == "auto":
        entries = matrix.df.count()
        if tiles is None:
            tiles = 1 if where == "local" else max(1, math.ceil(matrix.n_rows / TILE_ROWS), math.ceil(entries / TILE_ENTRIES))
        if where == "auto":
            where = "local" if tiles == 1 and partition is None and matrix.n_rows <= LOCAL_ROWS and entries <= LOCAL_ENTRIES else "distributed"
    if where == "local":
        out, stats = _solve_local(matrix, x, frame(matrix.products(frame(b.x)) if isinstance(b, Image) else b), config)
    else:
        system = System(matrix, tiles, partition)
        try:
            solver = DistributedSolver(system, config)
            right = system.image(frame(b.x)) if isinstance(b, Image) else system.vector(frame(b))
            found = solver.solve(None if isinstance(x0, (int, float)) and x0 == 0 else system.vector(x), right)
            out = written(system.frame(found if found is not None else system.blocks.zeros(system.kind)))
            stats = solver.stats
        finally:
            system.drop()
    for line in stats.lines:
        print(line)
    return Tensor(out.select("i", F.lit(0).alias("tile"), "v"), DistributedShape((matrix.n_rows,)), FLOAT64, "x"), stats
