"""Solver configurations: frozen records read from JSON with comments."""

from __future__ import annotations

import dataclasses
import json
import re
import warnings
from dataclasses import dataclass
from typing import Any

from ..operators.tensor import parse_norm
from ..types import DType, parse_type

ITERATION_CAP = 10_000  # where the configuration names no limit


def strip_comments(text: str) -> str:
    """JSON without ``//`` and ``/* */`` comments; strings are left alone."""
    return re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0].startswith('"') else "", text, flags=re.S)


def parse_json(text: str) -> dict[str, Any]:
    return json.loads(strip_comments(text))


def _multicolor(value: object) -> str:
    """on, off or auto."""
    if isinstance(value, bool):
        return "on" if value else "off"
    if value in ("true", "on"):
        return "on"
    if value in ("false", "off"):
        return "off"
    if value == "auto":
        return "auto"
    raise ValueError(f"invalid multicolor mode {value!r}")


@dataclass(frozen=True)
class Tolerances:
    absTolerance: float = 0.0
    relTolerance: float = 0.0
    relResidual: float = 0.0
    maxIterations: int = ITERATION_CAP
    minIterations: int = 0
    norm: str = "L2"
    verbose: bool = False
    printPerformanceAfterSolve: bool = False
    printPerformanceEachIteration: bool = False


@dataclass(frozen=True)
class PBiCGStabConfig(Tolerances):
    workingType: DType | None = None
    preconditioner: SolverConfig | None = None
    type: str = "PBiCGStab"


@dataclass(frozen=True)
class IterativeRefinementConfig(Tolerances):
    extendedPrecisionType: DType | None = None
    innerSolver: SolverConfig | None = None
    type: str = "IterativeRefinement"


@dataclass(frozen=True)
class GaussSeidelConfig(Tolerances):
    numSweeps: int = 1
    numFixedIterations: int = 0
    solveMulticolor: str = "auto"
    workingType: DType | None = None
    type: str = "GaussSeidel"


@dataclass(frozen=True)
class ILUConfig:
    solveMulticolor: str = "auto"
    factorizeMulticolor: str = "auto"
    diagonalBased: bool = False
    type: str = "ILU"


@dataclass(frozen=True)
class RestarterConfig:
    maxRestarts: int = 1
    innerSolver: SolverConfig | None = None
    type: str = "restarter"


SolverConfig = PBiCGStabConfig | IterativeRefinementConfig | GaussSeidelConfig | ILUConfig | RestarterConfig
_KINDS = {c.type: c for c in (PBiCGStabConfig, IterativeRefinementConfig, GaussSeidelConfig, ILUConfig, RestarterConfig)}
_NEEDS_INNER = ("IterativeRefinement", "restarter")


def from_json(config: dict[str, Any] | str) -> SolverConfig:
    """A configuration and those nested in it; unknown keys are named in a warning and ignored."""
    if isinstance(config, str):
        config = parse_json(config)
    if "type" not in config:
        raise ValueError("a solver configuration needs a type")
    kind = _KINDS.get(config["type"])
    if kind is None:
        raise ValueError(f"unknown solver type {config['type']!r}")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    values: dict[str, Any] = {}
    for key, value in config.items():
        if key == "type":
            continue
        if key not in fields:
            warnings.warn(f"{kind.type} ignores {key!r}", stacklevel=2)
        elif key in ("innerSolver", "preconditioner"):
            values[key] = from_json(value)
        elif key in ("workingType", "extendedPrecisionType"):
            values[key] = parse_type(value)
        elif key.endswith("Multicolor"):
            values[key] = _multicolor(value)
        elif key == "norm":
            values[key] = parse_norm(value)
        else:
            values[key] = type(fields[key].default)(value)
    if kind.type in _NEEDS_INNER and "innerSolver" not in values:
        raise ValueError(f"{kind.type} needs an innerSolver")
    return kind(**values)
