"""What a solver says of its run."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .config import Tolerances


@dataclass
class SolverStats:
    solver: str
    norm: str = "L2"
    tiles: int = 1
    initial_residual: float = math.nan
    final_residual: float = math.nan
    norm_factor: float = math.nan  # of the right-hand side
    iterations: int = 0
    converged: bool = False
    singular: bool = False
    history: list[float] = field(default_factory=list)
    begun: float = field(default_factory=time.perf_counter)
    seconds: float = math.nan
    lines: list[str] = field(default_factory=list)  # what is told on the way

    def start(self, residual: float, b_norm: float) -> None:
        self.initial_residual = self.final_residual = residual
        self.norm_factor = b_norm
        self.history = [residual]

    def check(self, residual: float, limits: Tolerances) -> None:
        """Convergence is strict: a limit of zero is never met."""
        self.final_residual = residual
        self.history.append(residual)
        self.converged = (
            residual < limits.absTolerance
            or residual < limits.relResidual * self.initial_residual
            or (limits.relTolerance > 0 and residual < limits.relTolerance * self.norm_factor)
        )
        if limits.verbose or limits.printPerformanceEachIteration:
            self.lines.append(f"{self.solver} iteration={self.iterations} residual={residual:.8g} seconds={time.perf_counter() - self.begun:.3f}")

    def finish(self, config: object) -> None:
        """The run ends: its time is taken, and told if asked for."""
        self.seconds = time.perf_counter() - self.begun
        if getattr(config, "printPerformanceAfterSolve", False) or getattr(config, "verbose", False):
            self.lines.append(self.line())

    def goes_on(self, limits: Tolerances) -> bool:
        if self.singular or not math.isfinite(self.final_residual):
            return False
        return not (self.converged and self.iterations >= limits.minIterations) and self.iterations < limits.maxIterations

    def mark_singular(self, value: float, least: float = 1e-37) -> bool:
        """Sticky: once seen, it stays."""
        self.singular = self.singular or not math.isfinite(value) or abs(value) < least
        return self.singular

    def line(self) -> str:
        told = {"tiles": self.tiles, "norm": self.norm, "first": f"{self.initial_residual:.8g}", "last": f"{self.final_residual:.8g}", "iterations": self.iterations, "converged": self.converged, "singular": self.singular, "seconds": f"{self.seconds:.3f}"}
        return f"{self.solver} " + " ".join(f"{k}={v}" for k, v in told.items())

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(r)) for k, r in enumerate(self.history)], "iteration int, residual double")
