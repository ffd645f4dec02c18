"""Tensors: frames with a row for each index of dimension 0, and their reductions."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as ew
from ..session import written
from ..shape import Dims, DistributedShape, compatible
from ..types import BOOL, FLOAT32, DType, convert, from_spark, from_value, parse_type, smallest_uint
from ..types import wrap as wrap_int
from .expression import Leaf, compiled, wrap
from .placement import of_tile, tile_of

REDUCTIONS = ("add", "mul", "square_add", "logical_and", "logical_or", "min", "max")
NORMS = ("L1", "L2", "LINF")
WORKERS = 6


def parse_norm(name: str) -> str:
    if name not in NORMS:
        raise ValueError(f"invalid vector norm {name!r}")
    return name


class Tensor(Leaf):
    """A lazy, immutable tensor; copies share the frame, ``materialize`` writes it."""

    def __init__(self, df: DataFrame, shape: DistributedShape, dtype: DType, name: str = ""):
        self.df, self.shape, self.dtype, self.name = df, shape, dtype, name
        self.tensor, self.metadata = self, {}
        self.value_col = "v"  # a path, where several tensors are fields of one frame's v

    @property
    def is_array(self) -> bool:
        return self.shape.rank > 1

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    # --- sources -----------------------------------------------------------
    @classmethod
    def from_dataframe(cls, df: DataFrame, value: Column | str = "v", index: Column | str = "i", dims: Dims | None = None, tiles: int = 1, dtype: DType | None = None, name: str = "") -> Tensor:
        """From a frame with a dense 0-based index; ``dims`` is counted if not given."""
        value, index = (F.col(x) if isinstance(x, str) else x for x in (value, index))
        frame = df.select(index.cast("bigint").alias("i"), value.alias("v"))
        kind = dict(frame.dtypes)["v"]
        if dtype is not None and not kind.startswith("struct"):
            frame = frame.withColumn("v", F.col("v").cast(f"array<{dtype.spark}>" if kind.startswith("array") else dtype.spark))
        dtype = dtype or from_spark(kind)
        if dims is None:
            width = (frame.select(F.size("v")).first()[0],) if kind.startswith("array") else ()
            dims = (frame.count(), *width)
        shape = DistributedShape.linear(dims, tiles) if tiles <= dims[0] else DistributedShape(dims)
        return cls(frame.select("i", _linear_tile(F.col("i"), dims[0], tiles).alias("tile"), "v"), shape, dtype, name)

    @classmethod
    def from_numpy(cls, spark: SparkSession, values: np.ndarray, shape: DistributedShape | None = None, dtype: DType | None = None, name: str = "") -> Tensor:
        values = np.asarray(values)
        dtype = dtype or parse_type(values.dtype.name)
        shape = shape or DistributedShape(tuple(values.shape))
        rows = values.reshape(shape.dims[0], -1).tolist()
        kind = dtype.spark if shape.rank == 1 else f"array<{dtype.spark}>"
        df = spark.createDataFrame([(k, r[0] if shape.rank == 1 else r) for k, r in enumerate(rows)], f"i bigint, v {kind}")
        return cls(df.select("i", tile_of(F.col("i"), shape).alias("tile"), "v"), shape, dtype, name)

    @classmethod
    def with_initial_value(cls, spark: SparkSession, value: object, shape: DistributedShape, dtype: DType | None = None) -> Tensor:
        """Every element one value, or a list with all of them."""
        if isinstance(value, (list, tuple)):
            kind = dtype or from_value(value[0])
            return cls.from_numpy(spark, np.array(value).reshape(shape.dims), shape, kind)
        dtype = dtype or from_value(value)
        one = F.lit(value).cast(dtype.spark)
        v = one if shape.rank == 1 else F.array_repeat(one, shape.row_size)
        i = F.col("id")
        return cls(spark.range(shape.dims[0]).select(i.alias("i"), tile_of(i, shape).alias("tile"), v.alias("v")), shape, dtype)

    @classmethod
    def uninitialised(cls, spark: SparkSession, shape: DistributedShape, dtype: DType = FLOAT32, mapping: dict | None = None) -> Tensor:
        """Zeros; a mapping that does not cover the shape is an error."""
        if mapping is not None and not compatible(mapping, shape.elements):
            raise ValueError("the mapping does not fit the shape")
        return cls.with_initial_value(spark, False if dtype == BOOL else 0, shape, dtype)

    @classmethod
    def iota(cls, spark: SparkSession, shape: DistributedShape, dtype: DType = FLOAT32) -> Tensor:
        i, width = F.col("id"), shape.row_size
        v = i.cast(dtype.spark) if shape.rank == 1 else F.transform(F.sequence(i * width, i * width + width - 1), lambda x: x.cast(dtype.spark))
        return cls(spark.range(shape.dims[0]).select(i.alias("i"), tile_of(i, shape).alias("tile"), v.alias("v")), shape, dtype)

    def field(self, name: str, dtype: DType) -> Tensor:
        """A tensor that is one field of this one's struct values; fields of one frame need no join."""
        out = Tensor(self.df, self.shape, dtype, name)
        out.value_col = f"v.{name}"
        return out

    # --- placement ----------------------------------------------------------
    def materialize(self, name: str = "") -> Tensor:
        """Written to the shared folder, where its lineage ends."""
        return Tensor(written(self.df), self.shape, self.dtype, name or self.name)

    def materialize_if_necessary(self) -> Tensor:
        return self

    def same(self) -> Tensor:
        return self

    def assign(self, value: object) -> Tensor:
        """A tensor of this shape and type with another's value, cast and broadcast as needed."""
        e = wrap(value)
        if e.dtype != self.dtype:
            e = e.cast(self.dtype)
        if e.shape.dims != self.shape.dims:
            e = e.broadcast(self.shape)
        return Tensor(compiled(e), self.shape, self.dtype, self.name)

    def rearrange(self, shape: DistributedShape) -> Tensor:
        if shape.dims != self.shape.dims:
            raise ValueError(f"{self.shape} cannot be rearranged as {shape}")
        return Tensor(self.df.withColumn("tile", tile_of(F.col("i"), shape)), shape, self.dtype, self.name)

    def slice_tile(self, tile: int) -> Tensor:
        """The rows of one tile; a tensor of one row stays whole."""
        if self.shape.dims[0] == 1:
            return self
        n = self.shape.rows[tile]
        return Tensor(self.df.where(F.col("tile") == tile), DistributedShape.on_single_tile((n, *self.shape.dims[1:]), tile), self.dtype, self.name)

    def slice_device(self, device: int, tiles_per_device: int) -> Tensor:
        inside = {t: n for t, n in self.shape.rows.items() if t // tiles_per_device == device}
        rows = self.df.where(F.col("tile").between(device * tiles_per_device, (device + 1) * tiles_per_device - 1))
        return Tensor(rows, DistributedShape.on_tiles((sum(inside.values()), *self.shape.dims[1:]), inside), self.dtype, self.name)

    def as_row(self) -> DataFrame:
        """All elements as one array in one row, for a lower rank beside a higher one.

        It stands for trailing dimensions, so it is as wide as any row of the result, which hold that many elements too.
        """
        parts = F.array_sort(F.collect_list(F.struct("i", "v")))
        values = F.transform(parts, lambda p: p["v"])
        return self.df.agg((F.flatten(values) if self.is_array else values).alias("v"))

    def narrow(self) -> Tensor:
        """Non-negative integers as the smallest unsigned type that holds their maximum."""
        if not self.dtype.is_integer:
            raise TypeError(f"{self.dtype} cannot be narrowed")
        x = F.array_max("v") if self.is_array else F.col("v")
        ends = self.df.agg(F.max(x).alias("most"), F.min(F.array_min("v") if self.is_array else F.col("v")).alias("least")).first()
        if ends.least is not None and ends.least < 0:
            raise ValueError("negative values have no unsigned type")
        return self.cast(smallest_uint(int(ends.most or 0))).lazy(self.name)

    def unroll(self) -> Tensor:
        """A double-word tensor with its high and low parts as a last dimension of two."""
        def parts(x: Column) -> Column:
            high = x.cast("float")
            return F.array(high, (x - high.cast("double")).cast("float"))

        v = parts(F.col("v")) if not self.is_array else F.flatten(F.transform("v", parts))
        return Tensor(self.df.withColumn("v", v), self.shape.push_back(2), FLOAT32, self.name)

    # --- reductions -----------------------------------------------------------
    def reduce(self, dim: int = 0, op: str = "add") -> Tensor:
        """Over dimension 0 a partial and a final aggregate; over another dimension no shuffle."""
        if not 0 <= dim < self.shape.rank:
            raise ValueError(f"no dimension {dim} in {self.shape}")
        if dim > 0:
            return self._reduce_trailing(dim, op)
        return self._grouped([F.lit(0).cast("bigint").alias("i")], DistributedShape((1, *self.shape.dims[1:])), op)

    def reduce_per_tile(self, dim: int = 0, op: str = "add") -> Tensor:
        if dim > 0:
            return self._reduce_trailing(dim, op)
        return self.reduce_grouped(1, op)

    def reduce_grouped(self, size: int, op: str = "add") -> Tensor:
        """One row for each group of ``size`` neighbouring tiles."""
        group = (F.col("tile") - F.col("tile") % size).cast("int")
        rows = self.shape.group(size).rows
        shape = DistributedShape.on_tiles((len(rows), *self.shape.dims[1:]), {t: 1 for t in rows})
        return self._grouped([group.alias("tile")], shape, op)

    def reduce_per_worker(self, op: str = "add") -> Tensor:
        """Six partial rows a tile: aligned chunks of the tile's rows, the last worker takes the rest."""
        here = of_tile(F.col("tile"), self.shape)
        chunk = F.floor(F.floor(here.rows / WORKERS) / 4) * 4
        local = F.col("i") - here.begin
        worker = F.when(chunk == 0, F.lit(WORKERS - 1)).otherwise(F.least(F.floor(local / F.greatest(chunk, F.lit(1))), F.lit(WORKERS - 1))).cast("int")
        tiles = self.shape.rows.keys()
        shape = DistributedShape.on_tiles((WORKERS * len(tiles), *self.shape.dims[1:]), {t: WORKERS for t in tiles})
        part = self._grouped([F.col("tile"), worker.alias("worker")], shape, op)
        neutral = self._neutral(op, part.dtype)
        if self.is_array:
            neutral = F.array_repeat(neutral, self.shape.row_size)
        every = self.spark.range(shape.dims[0]).select(F.col("id").alias("i"), tile_of(F.col("id"), shape).alias("tile"))
        part.df = every.join(part.df.drop("tile"), "i", "left").select("i", "tile", F.coalesce("v", neutral).alias("v"))
        return part

    @staticmethod
    def _neutral(op: str, t: DType) -> Column:
        """What a worker without rows gives."""
        if op in ("logical_and", "logical_or"):
            return F.lit(op == "logical_and")
        if op in ("min", "max"):
            big = float("inf") if t.is_float else (1 << (t.bits - t.is_signed)) - 1
            low = -big if t.is_float else (-(1 << (t.bits - 1)) if t.is_signed else 0)
            return F.lit(big if op == "min" else low).cast(t.spark)
        return F.lit(1 if op == "mul" else 0).cast(t.spark)

    def _value(self, x: Column, op: str) -> Column:
        if op not in REDUCTIONS:
            raise ValueError(f"unknown reduction {op!r}")
        if op in ("logical_and", "logical_or"):
            return convert(x, self.dtype, BOOL)
        return ew.unary("square", x, self.dtype)[0] if op == "square_add" else x

    def _aggregate(self, x: Column, op: str) -> Column:
        """Integers add up exactly (as decimals if 64 bits wide) and wrap once; floats add up in double."""
        x = self._value(x, op)
        if op in ("logical_and", "logical_or"):
            return F.bool_and(x) if op == "logical_and" else F.bool_or(x)
        if op in ("min", "max"):
            return getattr(F, op)(x)
        if op == "mul":
            return convert(F.product(x.cast("double")), ew.FLOAT64, self.dtype)
        if self.dtype.is_float:
            return F.sum(x.cast("double")).cast(self.dtype.spark)
        return wrap_int(F.sum(x.cast("decimal(28,0)" if self.dtype.bits == 64 else "bigint")), self.dtype)

    def _reduced_type(self, op: str) -> DType:
        return BOOL if op in ("logical_and", "logical_or") else self.dtype

    def _grouped(self, keys: list[Column], shape: DistributedShape, op: str) -> Tensor:
        """One row for each of the keys: i alone, or tile with or without worker, whose places give i."""
        width = self.shape.row_size
        if not self.is_array:
            out = self.df.groupBy(*keys).agg(self._aggregate(F.col("v"), op).alias("v"))
        else:
            each = [self._aggregate(F.get("v", F.lit(k)), op).alias(f"e{k}") for k in range(width)]
            out = self.df.groupBy(*keys).agg(*each)
            out = out.withColumn("v", F.array(*[f"e{k}" for k in range(width)])).drop(*[f"e{k}" for k in range(width)])
        if "tile" not in out.columns:
            out = out.withColumn("tile", F.lit(0))
        elif "worker" in out.columns:
            out = out.withColumn("i", of_tile(F.col("tile"), shape).place * WORKERS + F.col("worker"))
        else:
            out = out.withColumn("i", of_tile(F.col("tile"), shape).place)
        return Tensor(out.select("i", "tile", "v"), shape, self._reduced_type(op), self.name)

    def _reduce_trailing(self, dim: int, op: str) -> Tensor:
        dims = self.shape.dims[1:]
        outer, n, inner = prod(dims[: dim - 1]), dims[dim - 1], prod(dims[dim:])

        def element(o: Column, r: Column) -> Column:
            part = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: self._value(F.get("v", (o * n * inner + m * inner + r).cast("int")), op))
            if op in ("logical_and", "logical_or"):
                return F.forall(part, lambda x: x) if op == "logical_and" else F.exists(part, lambda x: x)
            if op in ("min", "max"):
                return F.array_min(part) if op == "min" else F.array_max(part)
            step = "multiply" if op == "mul" else "add"
            if self.dtype.is_float:
                return F.aggregate(part, F.lit(1.0 if op == "mul" else 0.0), lambda s, x: s * x.cast("double") if op == "mul" else s + x.cast("double")).cast(self.dtype.spark)
            return F.aggregate(part, F.lit(1 if op == "mul" else 0).cast(self.dtype.spark), lambda s, x: ew.binary(step, s, self.dtype, x, self.dtype)[0])

        v = F.transform(F.sequence(F.lit(0), F.lit(outer * inner - 1)), lambda k: element(F.floor(k / inner), k % inner))
        trailing = (*dims[: dim - 1], 1, *dims[dim:])
        return Tensor(self.df.withColumn("v", v), self.shape.with_trailing(trailing), self._reduced_type(op), self.name)

    def norm(self, kind: str = "L2") -> Tensor:
        """The L1, L2 or LINF norm over dimension 0."""
        parse_norm(kind)
        if kind == "L2":
            return self.reduce(0, "square_add").sqrt().lazy()
        return self.absolute().lazy().reduce(0, "add" if kind == "L1" else "max")

    def scalar(self) -> object:
        """The value of a one-element tensor, on the driver."""
        if self.shape.elements != 1:
            raise ValueError(f"{self.shape} is no scalar")
        v = self.df.first()["v"]
        return v[0] if self.is_array else v


def _linear_tile(i: Column, n: int, tiles: int) -> Column:
    each = max(1, n // tiles)
    return F.least(F.floor(i / each), F.lit(tiles - 1)).cast("int")

