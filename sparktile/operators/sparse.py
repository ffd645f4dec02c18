"""Sparse matrices as frames of coordinates, products and residuals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..shape import DistributedShape
from ..sources import matrix_market, poisson
from ..types import FLOAT64, DType, parse_type
from .placement import tile_of
from .tensor import Tensor

#: A vector of up to so many entries of 16 bytes may be broadcast; longer ones are shuffled.
BROADCAST_ROWS = 2_000_000
FORMATS = ("CRS", "LDU", "Triplet", "Dense")


@dataclass
class Matrix:
    """(row, col, val) with duplicates summed; a format is only a view of it."""

    df: DataFrame
    n_rows: int
    n_cols: int
    dtype: DType = FLOAT64
    name: str = ""
    entries: DataFrame | None = None  # as they came, duplicates apart: a product is linear and needs no sums before it

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def from_coo(cls, df: DataFrame, row: str | Column = "row", col: str | Column = "col", val: str | Column = "val", n_rows: int | None = None, n_cols: int | None = None, dtype: DType = FLOAT64, unique: bool = False, name: str = "") -> Matrix:
        """Entries of one place are added; ``unique`` says that there are none."""
        row, col, val = (F.col(x) if isinstance(x, str) else x for x in (row, col, val))
        df = entries = df.select(row.cast("bigint").alias("row"), col.cast("bigint").alias("col"), val.cast(dtype.spark).alias("val"))
        if not unique:
            df = df.groupBy("row", "col").agg(F.sum("val").cast(dtype.spark).alias("val"))
        if n_rows is None or n_cols is None:
            ends = df.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c")).first()
            n_rows, n_cols = n_rows or ends.r or 1, n_cols or ends.c or 1
        return cls(df, n_rows, n_cols, dtype, name, entries if dtype == FLOAT64 and not unique else None)

    @classmethod
    def from_matrix_market(cls, spark: SparkSession, path: str, dtype: DType | str = FLOAT64, name: str = "") -> Matrix:
        frame, header = matrix_market.read_triplets(spark, path)
        return cls.from_coo(frame, n_rows=header.rows, n_cols=header.cols, dtype=parse_type(dtype) if isinstance(dtype, str) else dtype, name=name)

    @classmethod
    def poisson3d(cls, spark: SparkSession, nx: int, ny: int, nz: int, dtype: DType = FLOAT64) -> Matrix:
        n = nx * ny * nz
        return cls.from_coo(poisson.poisson3d(spark, nx, ny, nz), n_rows=n, n_cols=n, dtype=dtype, unique=True, name=f"poisson_{nx}x{ny}x{nz}")

    @classmethod
    def from_ldu(cls, diag: DataFrame, faces: DataFrame, n: int, dtype: DType = FLOAT64) -> Matrix:
        """From face addressing: diag (row, val); faces (lower, upper, upper_val[, lower_val]).

        Without lower coefficients the matrix is symmetric. All are in face order.
        """
        low = F.col("lower_val") if "lower_val" in faces.columns else F.col("upper_val")
        off = faces.select(F.col("lower").alias("row"), F.col("upper").alias("col"), F.col("upper_val").alias("val")).union(faces.select("upper", "lower", low))
        return cls.from_coo(off.union(diag.select("row", F.col("row").alias("col"), "val")), n_rows=n, n_cols=n, dtype=dtype)

    def to_ldu(self) -> tuple[DataFrame, DataFrame]:
        """Diagonal and faces (lower < upper) with both coefficients; a missing one is 0."""
        diag = self.df.where("row = col").select("row", "val")
        off = self.df.where("row <> col").select(F.least("row", "col").alias("lower"), F.greatest("row", "col").alias("upper"), (F.col("row") < F.col("col")).alias("up"), "val")
        part = lambda up: F.coalesce(F.sum(F.when(F.col("up") == up, F.col("val"))), F.lit(0.0))
        return diag, off.groupBy("lower", "upper").agg(part(True).alias("upper_val"), part(False).alias("lower_val"))

    def crs(self) -> DataFrame:
        """Compressed rows: (row, row_ptr, diag, cols, vals), off-diagonal entries in column order.

        The running count of entries is a prefix over blocks of rows, then within blocks.
        """
        from .layout import running_total

        entry = F.when(F.col("row") != F.col("col"), F.struct("col", "val"))
        grouped = self.df.groupBy("row").agg(F.sum(F.when(F.col("row") == F.col("col"), F.col("val"))).alias("diag"), F.array_sort(F.collect_list(entry)).alias("e"))
        rows = self.spark.range(self.n_rows).select(F.col("id").alias("row")).join(grouped, "row", "left")
        rows = rows.select("row", F.coalesce("diag", F.lit(0.0)).alias("diag"), F.coalesce(F.transform("e", lambda e: e["col"]), F.expr("cast(array() as array<bigint>)")).alias("cols"), F.coalesce(F.transform("e", lambda e: e["val"]), F.expr(f"cast(array() as array<{self.dtype.spark}>)")).alias("vals"))
        counted = running_total(rows.withColumn("n", F.size("cols").cast("bigint")), "row", "n", self.n_rows)
        return counted.select("row", (F.col("total") - F.col("n")).alias("row_ptr"), "diag", "cols", "vals")

    def materialize(self) -> Matrix:
        return Matrix(written(self.df), self.n_rows, self.n_cols, self.dtype, self.name)

    def cast(self, dtype: DType) -> Matrix:
        return Matrix(self.df.withColumn("val", F.col("val").cast(dtype.spark)), self.n_rows, self.n_cols, dtype, self.name)

    def diagonal(self) -> DataFrame:
        """(i, v) of all rows; a missing entry is 0."""
        return matrix_market.densify(self.df.where("row = col").select(F.col("row").alias("i"), F.col("val").cast("double").alias("v")), self.n_rows)

    def products(self, x: DataFrame, intermediate: DType | None = None) -> DataFrame:
        """(i, v) of A x as a frame: products joined on the column, summed by row.

        Where the vector is broadcast they are summed before the shuffle too. A shuffled join
        deals a row's entries by column, which leaves next to nothing to sum before the rows
        meet. Every row gets a zero term, so that empty rows are there without another join.
        """
        kind = (intermediate or self.dtype).spark
        x = x.select(F.col("i").alias("col"), F.col("v").alias("x"))
        side = F.broadcast(x) if self.n_cols <= BROADCAST_ROWS else x
        terms = (self.df if self.entries is None else self.entries).join(side, "col").select(F.col("row").alias("i"), (F.col("val").cast(kind) * F.col("x").cast(kind)).cast("double").alias("v"))
        zeros = self.spark.range(self.n_rows).select(F.col("id").alias("i"), F.lit(0.0).alias("v"))
        terms = terms.unionAll(zeros)
        return (terms if side is not x else terms.repartition("i")).groupBy("i").agg(F.sum("v").alias("v"))

    def spmv(self, x: Tensor, dest: DType | None = None, intermediate: DType | None = None) -> Tensor:
        if x.shape.dims[0] != self.n_cols or x.shape.elements != self.n_cols:
            raise ValueError(f"a vector of {x.shape} for {self.n_cols} columns")
        dest = dest or x.dtype
        shape = DistributedShape((self.n_rows,), x.shape.rows) if self.n_rows == x.shape.dims[0] else DistributedShape((self.n_rows,))
        y = self.products(x.df.select("i", "v"), intermediate)
        return Tensor(y.select("i", tile_of(F.col("i"), shape).alias("tile"), F.col("v").cast(dest.spark).alias("v")), shape, dest)

    def __matmul__(self, x: Tensor) -> Tensor:
        return self.spmv(x)

    __mul__ = __matmul__

    def residual(self, x: Tensor, b: Tensor, dest: DType | None = None, intermediate: DType | None = None) -> Tensor:
        """b - A x, computed in the intermediate type and stored in the other."""
        if b.shape.dims[0] != self.n_rows:
            raise ValueError(f"a right-hand side of {b.shape} for {self.n_rows} rows")
        dest = dest or x.dtype
        kind = (intermediate or self.dtype).spark
        ax = self.products(x.df.select("i", "v"), intermediate).withColumnRenamed("v", "ax")
        v = (F.col("v").cast(kind) - F.col("ax").cast(kind)).cast(dest.spark)
        return Tensor(b.df.join(ax, "i").select("i", "tile", v.alias("v")), b.shape, dest)
