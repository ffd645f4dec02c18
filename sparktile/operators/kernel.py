"""User kernels: a function over each tile's rows of several tensors.

``In`` columns are read, ``Out`` columns are returned, ``InOut`` both, ``Member``
values go along as they are. A tensor of one row is broadcast to every tile, and so is
one of lower rank, whose values stand as one array beside every row. A function that takes ``tile`` (or ``worker``, if threaded) is told where it runs.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import DType
from .tensor import WORKERS, Tensor


@dataclass(frozen=True)
class In:
    tensor: Tensor


@dataclass(frozen=True)
class Out:
    dtype: DType


@dataclass(frozen=True)
class InOut:
    tensor: Tensor


@dataclass(frozen=True)
class Member:
    value: object


Binding = In | Out | InOut | Member


def _rows(bindings: dict[str, Binding]) -> tuple[int, int]:
    """The rank and the rows of the tensors that a kernel runs over."""
    return max((b.tensor.shape.rank, b.tensor.shape.dims[0]) for b in bindings.values() if isinstance(b, (In, InOut)))


def _frame(bindings: dict[str, Binding]) -> DataFrame:
    frame, single = None, []
    tensors = {name: b.tensor for name, b in bindings.items() if isinstance(b, (In, InOut))}
    n = _rows(bindings)[1] if tensors else 1
    for name, t in tensors.items():
        if t.shape.dims[0] == 1:
            single.append(t.df.select(F.col("v").alias(name)))
            continue
        if t.shape.dims[0] != n:
            if isinstance(bindings[name], InOut):
                raise ValueError(f"{name} of {t.shape} has other rows than the kernel")
            single.append(t.as_row().select(F.col("v").alias(name)))
            continue
        part = t.df.select("i", "tile", F.col("v").alias(name))
        frame = part if frame is None else frame.join(part.drop("tile"), "i")
    if frame is None:
        raise ValueError("a kernel needs a tensor with rows")
    for row in single:
        frame = frame.crossJoin(F.broadcast(row))  # one row each
    return frame


def _run(fn: Callable, bindings: dict[str, Binding], keys: list[str], frame: DataFrame) -> DataFrame:
    outs = {n: b.dtype if isinstance(b, Out) else b.tensor.dtype for n, b in bindings.items() if isinstance(b, (Out, InOut))}
    arrays = {n for n, b in bindings.items() if isinstance(b, InOut) and b.tensor.is_array}
    members = {n: b.value for n, b in bindings.items() if isinstance(b, Member)}
    read = [n for n, b in bindings.items() if isinstance(b, (In, InOut))]
    returned = list(outs)
    wanted = [k for k in ("worker", "tile") if k in inspect.signature(fn).parameters]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        extra = {k: int(pdf[k].iloc[0]) for k in wanted}
        args = {n: pdf[n].to_numpy() for n in read}
        result = fn(**args, **members, **extra)
        return pd.DataFrame({"i": pdf["i"], "tile": pdf["tile"], **{n: list(result[n]) for n in returned}})

    schema = "i long, tile int, " + ", ".join(f"{n} {'array<' + t.spark + '>' if n in arrays else t.spark}" for n, t in outs.items())
    return frame.groupBy(*keys).applyInPandas(group, schema)


def _results(df: DataFrame, bindings: dict[str, Binding]) -> dict[str, Tensor]:
    n = _rows(bindings)[1]
    shape = next(b.tensor.shape for b in bindings.values() if isinstance(b, (In, InOut)) and b.tensor.shape.dims[0] == n)
    out = {}
    for n, b in bindings.items():
        if isinstance(b, (Out, InOut)):
            flat = shape if isinstance(b, InOut) else type(shape)((shape.dims[0],), shape.rows)
            out[n] = Tensor(df.select("i", "tile", F.col(n).alias("v")), flat, b.dtype if isinstance(b, Out) else b.tensor.dtype, n)
    return out


def execute(fn: Callable, **bindings: Binding) -> dict[str, Tensor]:
    """Once a tile, over the tile's rows in order; ``fn`` returns a dict of its outputs."""
    return _results(_run(fn, bindings, ["tile"], _frame(bindings)), bindings)


#: One function that leads all workers of a tile sees the tile as a whole.
execute_on_supervisor = execute


def execute_on_single_tile(fn: Callable, tile: int, **bindings: Binding) -> dict[str, Tensor]:
    return _results(_run(fn, bindings, ["tile"], _frame(bindings).where(F.col("tile") == tile)), bindings)


def execute_threaded(fn: Callable, **bindings: Binding) -> dict[str, Tensor]:
    """Once a tile and worker, rows dealt in turn; ``fn`` may take ``worker``."""
    frame = _frame(bindings).withColumn("worker", (F.col("i") % WORKERS).cast("int"))
    return _results(_run(fn, bindings, ["tile", "worker"], frame), bindings)


def reinterpret(tensor: Tensor, dtype: DType) -> Tensor:
    """The same bits as another type of equal size, in Arrow batches."""
    if dtype.size != tensor.dtype.size or dtype.name in ("twofloat32", "uint64") or tensor.dtype.name in ("twofloat32", "uint64"):
        raise TypeError(f"{tensor.dtype} cannot be read as {dtype}")
    source, target = tensor.dtype.numpy(), dtype.numpy()

    @F.pandas_udf(dtype.spark)
    def view(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy().astype(source).view(target))

    return Tensor(tensor.df.withColumn("v", view("v")), tensor.shape, dtype, tensor.name)
