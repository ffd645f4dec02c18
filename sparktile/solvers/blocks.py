"""Matrix and vectors of a system in blocks of rows, so that a step moves packed values only.

A tile's rows are cut into chunks; a chunk of a vector is one row of packed numbers, a
chunk of the matrix one row of counts, columns and values. All tables are bucketed by
chunk, and a chunk's key is chosen so that a tile's chunks share one bucket: joins of
them shuffle nothing, and a bucket's task sees its tiles' chunks in order. A product
sends each chunk the distinct values that it needs of others; nothing else moves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators.levels import spans
from ..session import dropped, shared_dir

#: Rows and, on average, entries of a chunk; buckets of a table.
CHUNK_ROWS, CHUNK_ENTRIES, BUCKETS = 65_536, 262_144, 64
#: Rounds in which a chunk's triangle is tried as a whole before it is taken row by row.
ROUNDS = 64
#: A file's row groups stay small, as readers hold a whole one.
_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
_SETTINGS = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
Row = dict[str, Any]


def dtype_of(kind: str) -> np.dtype:
    return np.dtype(np.float32 if kind == "float" else np.float64)


# --- kernels ---------------------------------------------------------------------------
def triangle(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, finish: Callable, x: np.ndarray, backward: bool = False) -> np.ndarray:
    """x with x[i] = finish(i, sum of vals * x[cols] over row i), where rows need earlier (backward: later) rows only.

    All rows at once, again and again: values that no longer change are those that
    substitution gives, whatever it began with, as each row follows from those before it.
    Where they take many rounds to settle, the rows are taken one by one.
    """
    every = slice(None)
    for _ in range(ROUNDS):
        new = finish(every, np.bincount(rows, weights=vals * x[cols], minlength=len(x)))
        if new.tobytes() == x.tobytes():
            return new
        x = new
    ptr = np.searchsorted(rows, np.arange(len(x) + 1))
    cut, at, weight, out = ptr.tolist(), cols.tolist(), vals.tolist(), x.tolist()
    for i in range(len(x) - 1, -1, -1) if backward else range(len(x)):
        out[i] = float(finish(i, sum(weight[e] * out[at[e]] for e in range(cut[i], cut[i + 1]))))
    return np.array(out, x.dtype)


class Factors:
    """Incomplete factors of a tile, ILU(0) or DILU, made chunk by chunk; upper entries of the rows before are kept."""

    def __init__(self, rows: int, diagonal_based: bool, name: Callable[[int], int] = int):
        self.based, self.size, self.diag, self.name = diagonal_based, rows, np.zeros(rows), name
        self.ptr, self.cols, self.vals, self.done = np.zeros(rows + 1, np.int64), np.zeros(0, np.int32), np.zeros(0), 0

    def _room(self, more: int) -> int:
        used = int(self.ptr[self.done])
        if used + more > len(self.cols):
            size = max(used + more, 2 * len(self.cols))
            self.cols, self.vals = np.resize(self.cols, size), np.resize(self.vals, size)
        return used

    def add(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, m: int) -> np.ndarray:
        """Factors of the next ``m`` rows' entries, which are sorted and in the tile's numbers."""
        low, up, on = cols < rows, cols > rows, np.flatnonzero(cols == rows)
        first = self.done
        if len(on) < m or (vals[on] == 0).any():
            there = np.zeros(m, bool)
            there[rows[on[vals[on] != 0]] - first] = True
            raise ZeroDivisionError(f"row {self.name(first + int(np.flatnonzero(~there)[0]))} has no diagonal entry")
        base = self._room(int(up.sum()))
        self.ptr[first + 1 : first + m + 1] = base + np.cumsum(np.bincount(rows[up] - first, minlength=m))
        end, self.done = int(self.ptr[first + m]), first + m
        self.cols[base:end] = cols[up]
        p = np.flatnonzero(low)
        k = cols[p]
        q, source = spans(self.ptr[k], self.ptr[k + 1]), np.repeat(p, self.ptr[k + 1] - self.ptr[k])
        place, target = rows * self.size + cols, rows[source] * self.size + self.cols[q]
        if self.based:  # only the diagonal changes
            target = np.where(self.cols[q] == rows[source], target, -1)
        found = np.minimum(np.searchsorted(place, target), len(place) - 1)
        has = place[found] == target
        q, source, found = q[has], source[has], found[has]

        def put(v: np.ndarray) -> None:
            self.vals[base:end], self.diag[first : first + m] = v[up], v[on]

        v, divisor = vals.astype(np.float64), cols[source]
        put(v)
        with np.errstate(all="ignore"):
            for _ in range(ROUNDS):  # as in a triangle: entries follow from those of earlier rows
                factor = v[source] / self.diag[divisor] if self.based else v[source]
                new = vals - np.bincount(found, weights=factor * self.vals[q], minlength=len(v))
                if not self.based:
                    new[p] /= self.diag[k]
                same = new.tobytes() == v.tobytes()
                v = new
                put(v)
                if same:
                    break
            else:
                self._one_by_one(v, vals, rows, cols, source, q, found, base, put)
        if (v[on] == 0).any():
            raise ZeroDivisionError(f"pivot {self.name(first + int(np.flatnonzero(v[on] == 0)[0]))} is zero")
        return v

    def _one_by_one(self, v: np.ndarray, vals: np.ndarray, rows: np.ndarray, cols: np.ndarray, source: np.ndarray, q: np.ndarray, found: np.ndarray, base: int, put: Callable) -> None:
        """Entry after entry, as each follows from those before it."""
        v[:] = vals
        low, upper, on = cols < rows, np.flatnonzero(cols > rows), np.flatnonzero(cols == rows)
        first, cut = int(rows[on[0]]), np.searchsorted(source, np.arange(len(v) + 1))
        for e in np.flatnonzero(low).tolist():
            k = int(cols[e])
            factor = v[e] / (v[on[k - first]] if k >= first else self.diag[k])
            if not self.based:
                v[e] = factor
            for j in range(cut[e], cut[e + 1]):
                v[found[j]] -= factor * (v[upper[q[j] - base]] if q[j] >= base else self.vals[q[j]])
        put(v)


# --- tables ----------------------------------------------------------------------------
@dataclass(frozen=True)
class Grid:
    """Chunks of rows: a chunk's first row, the row after its last, its tile and its key; tiles' first chunks."""

    n: int
    cell: int
    lo: np.ndarray
    hi: np.ndarray
    tile: np.ndarray
    key: np.ndarray
    bucket: np.ndarray
    first: np.ndarray
    buckets: int
    by_key: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, n: int, starts: np.ndarray, cell: int) -> Grid:
        lo = np.unique(np.concatenate([np.arange(0, n, cell), starts]))
        hi, tile = np.append(lo[1:], n), np.searchsorted(starts, lo, "right") - 1
        buckets = min(len(starts), BUCKETS)
        bucket = tile * buckets // len(starts)
        sizes, tried = np.bincount(bucket, minlength=buckets), 2 * buckets * int(np.bincount(bucket).max()) + 256
        while True:  # numbers whose hash falls into the wanted bucket
            hashed = spark.range(tried).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("b")).toPandas()["b"].to_numpy()
            if (np.bincount(hashed, minlength=buckets) >= sizes).all():
                break
            tried *= 2
        key = np.concatenate([np.flatnonzero(hashed == b)[: sizes[b]] for b in range(buckets)])
        return cls(n, cell, lo, hi, tile, key, bucket, np.searchsorted(tile, np.arange(len(starts) + 1)), buckets, np.argsort(key))

    def number(self, key: int) -> int:
        """A chunk's number by its key."""
        return int(self.by_key[np.searchsorted(self.key, key, sorter=self.by_key)])

    def holding(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lo, rows, "right") - 1

    def tile_rows(self, tile: int) -> tuple[int, int]:
        return int(self.lo[self.first[tile]]), int(self.hi[self.first[tile + 1] - 1])


@dataclass(frozen=True)
class Vector:
    """A column of packed numbers in a table by chunk."""

    df: DataFrame
    column: str
    kind: str


Step = Callable[[Row], list[Row]]


def _mapped(df: DataFrame, make: Callable[[], Step], schema: str) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for k in range(batch.num_rows):
                if out := step(batch.slice(k, 1).to_pylist()[0]):
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if rest := getattr(step, "rest", None):
            rest()

    return df.mapInArrow(run, schema)


class _InOrder:
    """A bucket's rows by ``seq``, whatever files they came from; those that come early wait."""

    def __init__(self, step: Step, wanted: Callable[[int], Iterator[int]]):
        self.step, self.wanted, self.waiting, self.due = step, wanted, {}, None

    def __call__(self, row: Row) -> list[Row]:
        if self.due is None:
            self.left = self.wanted(row["key"])
            self.due = next(self.left)
        self.waiting[row["seq"]] = row
        out = []
        while self.due in self.waiting:
            out += self.step(self.waiting.pop(self.due))
            self.due = next(self.left, -1)
        return out

    def rest(self) -> None:
        if self.waiting or (self.due is not None and self.due != -1):
            raise RuntimeError(f"chunk {self.due} of a tile did not reach its task")


class Blocks:
    """A square matrix in blocks; ``entries`` are (row, col, val), tiles begin at ``starts``."""

    def __init__(self, entries: DataFrame, n: int, count: int, starts: np.ndarray, kind: str):
        self.spark, self.kind, self._made = entries.sparkSession, kind, []
        self._before = {k: self.spark.conf.get(k, None) for k in _SETTINGS}
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        cell = max(1, min(CHUNK_ROWS, CHUNK_ENTRIES * n // max(count, 1)))
        self.grid = grid = Grid.of(self.spark, n, starts, cell)
        number = dtype_of(kind)

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            """Each chunk's entries, with its own columns first and those of others by number, and what it needs of each other chunk."""
            rows, cols, vals = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["val"].to_numpy()
            held, given = np.unique(grid.holding(rows)), cols >= 0
            rows, cols, vals = rows[given], cols[given], vals[given]
            order = np.argsort((rows - rows.min(initial=n)) * n + cols)
            rows, cols, vals = rows[order], cols[order], vals[order].astype(number)
            out = []
            for j in held.tolist():
                lo, hi = int(grid.lo[j]), int(grid.hi[j])
                mine = slice(*np.searchsorted(rows, [lo, hi]))
                c = cols[mine]
                own = (c >= lo) & (c < hi)
                far, place = np.unique(c[~own], return_inverse=True)
                local = (c - lo).astype(np.int32)
                local[~own] = place + hi - lo
                count = np.bincount(rows[mine] - lo, minlength=hi - lo).astype(np.int32)
                out.append((-1, int(grid.key[j]), j, count.tobytes(), local.tobytes(), vals[mine].tobytes(), far.tobytes()))
                source = grid.holding(far)
                for s, a, b in zip(*(x.tolist() for x in _runs(source)), strict=True):
                    out.append((j, int(grid.key[s]), s, (far[a:b] - grid.lo[s]).astype(np.int32).tobytes(), None, None, None))
            return pd.DataFrame(out, columns=["reader", "key", "seq", "cnt", "cols", "vals", "far"])

        parts = max(grid.buckets, count // 500_000 + 1)
        every = self._local(row=grid.lo)  # chunks without entries are there too
        entries = entries.select("row", "col", "val").union(every.select("row", F.lit(-1), F.lit(0.0)))
        cells = entries.withColumn("cell", F.expr(f"row div {cell}")).repartition(parts, "cell")
        made = cells.groupBy("cell").applyInPandas(cut, "reader int, key int, seq int, cnt binary, cols binary, vals binary, far binary")
        made = self._table(made)
        self.matrix = self._keep(made.where("reader < 0").select("key", "seq", "cnt", "cols", "vals", "far").repartition(grid.buckets, "key"), "seq")
        plan = made.where("reader >= 0").select("key", "seq", F.struct("reader", "cnt").alias("to")).repartition(grid.buckets, "key")
        self.plan = self._keep(plan.groupBy("key").agg(F.first("seq").alias("seq"), F.collect_list("to").alias("to")))
        self.drop(made)

    # --- writing --------------------------------------------------------------------
    def _local(self, **columns: np.ndarray) -> DataFrame:
        """A few numbers a chunk, which the JVM takes as they are: rows would go through Python workers."""
        return self.spark.createDataFrame(pa.table(columns))

    def _table(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/tile-{uuid.uuid4().hex}"
        df.write.options(**_FILES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tile_path = path
        return out

    def _keep(self, df: DataFrame, order: str = "key") -> DataFrame:
        name = f"tile_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.options(**_FILES).option("path", path).bucketBy(self.grid.buckets, "key").sortBy(order).saveAsTable(name)
        out = self.spark.table(name)
        out._tile_path, out._tile_name = path, name
        self._made.append(out)
        return out

    def drop(self, *frames: DataFrame | Vector | None) -> None:
        for f in frames:
            df = f.df if isinstance(f, Vector) else f
            if df is not None:
                dropped(df)
                self._made = [x for x in self._made if x is not df]

    def close(self) -> None:
        self.drop(*self._made)
        for k, v in self._before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    # --- vectors --------------------------------------------------------------------
    def vector(self, df: DataFrame, kind: str) -> Vector:
        """(i, v) in chunks; what is missing is 0."""
        grid, number = self.grid, dtype_of(kind)

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            at = grid.holding(pdf["i"].to_numpy())
            held, pdf = np.unique(at), pdf[pdf["given"]]
            at, out = grid.holding(pdf["i"].to_numpy()), []
            for j in held.tolist():
                v, mine = np.zeros(int(grid.hi[j] - grid.lo[j]), number), at == j
                v[pdf["i"].to_numpy()[mine] - grid.lo[j]] = pdf["v"].to_numpy()[mine]
                out.append((int(grid.key[j]), v.tobytes()))
            return pd.DataFrame(out, columns=["key", "v"])

        every = self._local(i=grid.lo)
        df = df.select("i", F.col("v").cast(kind).alias("v"), F.lit(True).alias("given")).union(every.select("i", F.lit(0.0).cast(kind), F.lit(False)))
        cells = df.withColumn("cell", F.expr(f"i div {grid.cell}")).repartition(max(grid.buckets, grid.n // 500_000 + 1), "cell")
        packed = cells.groupBy("cell").applyInPandas(pack, "key int, v binary").repartition(grid.buckets, "key")
        return Vector(self._keep(packed), "v", kind)

    def zeros(self, kind: str) -> Vector:
        grid, number = self.grid, dtype_of(kind)
        keys = self._local(key=grid.key.astype(np.int32), m=grid.hi - grid.lo).repartition(grid.buckets, "key")
        return Vector(self._keep(_mapped(keys, lambda: lambda r: [{"key": r["key"], "v": bytes(r["m"] * number.itemsize)}], "key int, v binary")), "v", kind)

    def frame(self, x: Vector) -> DataFrame:
        """(i, v), v in double."""
        grid, number = self.grid, dtype_of(x.kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    j = grid.number(r["key"])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid.lo[j], grid.hi[j])), pa.array(np.frombuffer(r["v"], number).astype(np.float64))], ["i", "v"])

        return x.df.select("key", F.col(x.column).alias("v")).mapInArrow(run, "i long, v double")

    # --- steps ----------------------------------------------------------------------
    def _joined(self, df: DataFrame, vectors: dict[str, Vector]) -> DataFrame:
        for name, x in vectors.items():
            df = df.join(x.df.select("key", F.col(x.column).alias(name)).hint("shuffle_hash"), "key")
        return df

    def _outputs(self, df: DataFrame, kinds: dict[str, str], dots: tuple[str, ...]) -> tuple[dict[str, Vector], dict[str, float]]:
        table = self._keep(df)
        told = np.array([list(r) for r in table.select(*dots).collect()]).T if dots else ()  # a row a chunk
        return {name: Vector(table, name, kind) for name, kind in kinds.items()}, {d: float(v.max() if d.startswith("max_") else v.sum()) for d, v in zip(dots, told, strict=True)}

    def combine(self, vectors: dict[str, Vector], kinds: dict[str, str], fn: Callable[[dict[str, np.ndarray]], dict[str, Any]], dots: tuple[str, ...] = ()) -> tuple[dict[str, Vector], dict[str, float]]:
        """New vectors chunk by chunk from others, and sums (or, by the name ``max_...``, maxima) over chunks."""
        (first, x), *others = vectors.items()
        df = self._joined(x.df.select("key", F.col(x.column).alias(first)), dict(others))
        types = {name: dtype_of(x.kind) for name, x in vectors.items()}

        def step(row: Row) -> list[Row]:
            return [_packed(row["key"], kinds, fn({name: np.frombuffer(row[name], t) for name, t in types.items()}))]

        return self._outputs(_mapped(df, lambda: step, _schema(kinds, dots)), kinds, dots)

    def _received(self, x: Vector, vectors: dict[str, Vector], more: tuple[str, ...] = ()) -> DataFrame:
        """The matrix with a chunk's own values of x as ``_x``, those that it needs of others as ``got``, and the vectors."""
        grid, mine = self.grid, dtype_of(x.kind)

        def send() -> Step:
            def step(row: Row) -> list[Row]:
                v = np.frombuffer(row["x"], mine)
                return [{"key": int(grid.key[t["reader"]]), "seq": row["seq"], "v": v[np.frombuffer(t["cnt"], np.int32)].tobytes()} for t in row["to"]]

            return step

        sent = self._joined(self.plan, {"x": x})
        sent = _mapped(sent, send, "key int, seq int, v binary").repartition(grid.buckets, "key")
        got = sent.groupBy("key").agg(F.collect_list(F.struct("seq", "v")).alias("got"))
        return self._joined(self.matrix.select("key", "seq", "cnt", "cols", "vals", *more), {"_x": x} | vectors).join(got.hint("shuffle_hash"), "key", "left")

    def product(self, x: Vector, kind: str, vectors: dict[str, Vector], kinds: dict[str, str], fn: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, Any]], dots: tuple[str, ...] = ()) -> tuple[dict[str, Vector], dict[str, float]]:
        """As ``combine``, where ``fn`` is given A x too: products in one type, their sum rounded to it once more."""
        values, number, mine, types = dtype_of(self.kind), dtype_of(kind), dtype_of(x.kind), {name: dtype_of(v.kind) for name, v in vectors.items()}

        def step(row: Row) -> list[Row]:
            return [_packed(row["key"], kinds, fn(_multiplied(row, mine, values, number)[0], {name: np.frombuffer(row[name], t) for name, t in types.items()}))]

        return self._outputs(_mapped(self._received(x, vectors), lambda: step, _schema(kinds, dots)), kinds, dots)

    def sweep(self, x: Vector, b: Vector, kind: str, fn: Callable[[np.ndarray, np.ndarray], dict[str, Any]], dots: tuple[str, ...] = ()) -> tuple[Vector, dict[str, float]]:
        """The vector after x, (L + D)^-1 (b - the rest of A x), where L is the lower triangle inside each tile.

        The same pass tells what ``fn`` makes of A x, with the products in one type, and b: it is of x, not of what follows.
        """
        grid, values, types, number, wide = self.grid, dtype_of(self.kind), dtype_of(b.kind), dtype_of(x.kind), dtype_of(kind)
        kinds = {"v": x.kind}

        def make() -> Step:
            held: dict[str, Any] = {"tile": -1}

            def step(row: Row) -> list[Row]:
                j = row["seq"]
                if grid.tile[j] != held["tile"]:
                    low, end = grid.tile_rows(int(grid.tile[j]))
                    held.update(tile=grid.tile[j], x=np.zeros(end - low, number))
                ax, old, rows, terms = _multiplied(row, number, values, wide)
                right, done = np.frombuffer(row["b"], types), held["x"]
                m, lo, cols, vals = len(right), int(grid.lo[j]), np.frombuffer(row["cols"], np.int32), np.frombuffer(row["vals"], values)
                at, low, near = _tile_columns(grid, j, cols, row["far"], m)
                lower, on = (at >= low) & (at < rows + lo) & near, at == rows + lo
                diag = np.bincount(rows[on], weights=vals[on], minlength=m).astype(values)
                if (diag == 0).any():
                    raise ZeroDivisionError(f"row {lo + int(np.flatnonzero(diag == 0)[0])} has no diagonal entry")
                early, past, inner = ~(lower | on), np.flatnonzero(lower & (at < lo)), np.flatnonzero(lower & (at >= lo))
                rest = right - np.bincount(rows[early], weights=terms[early], minlength=m) - np.bincount(rows[past], weights=vals[past] * done[at[past] - low], minlength=m)
                new = triangle(rows[inner], cols[inner], vals[inner], lambda i, s: ((rest[i] - s) / diag[i]).astype(number), old)
                done[lo - low : lo - low + m] = new
                return [_packed(row["key"], kinds, {"v": new} | fn(ax, right))]

            return _InOrder(step, lambda key: iter(np.flatnonzero(grid.bucket == grid.bucket[grid.number(key)]).tolist()))

        out, told = self._outputs(_mapped(self._received(x, {"b": b}, ("far",)), make, _schema(kinds, dots)), kinds, dots)
        return out["v"], told

    # --- incomplete factors ------------------------------------------------------------
    def factors(self, diagonal_based: bool) -> DataFrame:
        """(key, seq, cnt, cols, vals, inverse) in the order of substitution: a tile's lower chunks up, then its upper ones down."""
        grid, number = self.grid, dtype_of(self.kind)

        def make() -> Step:
            held: dict[str, Any] = {"tile": -1}

            def step(row: Row) -> list[Row]:
                j = row["seq"]
                t = int(grid.tile[j])
                low, end = grid.tile_rows(t)
                if t != held["tile"]:
                    held.update(tile=t, ilu=Factors(end - low, diagonal_based, lambda k: k + low))
                m, lo = int(grid.hi[j] - grid.lo[j]), int(grid.lo[j])
                rows = np.repeat(np.arange(m), np.frombuffer(row["cnt"], np.int32))
                at, _, _ = _tile_columns(grid, j, np.frombuffer(row["cols"], np.int32), row["far"], m)
                inside = (at >= low) & (at < end)
                rows, cols = rows[inside] + lo - low, at[inside] - low
                v = held["ilu"].add(rows, cols, np.frombuffer(row["vals"], number)[inside], m)
                inverse, out = (1 / v[rows == cols]).astype(number).tobytes(), []
                first, last = int(grid.first[t]), int(grid.first[t + 1])
                for keep, seq in ((cols < rows, first + j), (cols > rows, first + 2 * last - 1 - j)):
                    count = np.bincount(rows[keep] + low - lo, minlength=m).astype(np.int32)
                    out.append({"key": row["key"], "seq": seq, "cnt": count.tobytes(), "cols": cols[keep].astype(np.int32).tobytes(), "vals": v[keep].astype(number).tobytes(), "inverse": inverse})
                return out

            return _InOrder(step, lambda key: iter(np.flatnonzero(grid.bucket == grid.bucket[grid.number(key)]).tolist()))

        made = _mapped(self.matrix, make, "key int, seq int, cnt binary, cols binary, vals binary, inverse binary")
        return self._keep(made, "seq")

    def substitute(self, factors: DataFrame, b: Vector, diagonal_based: bool) -> Vector:
        """Forward and backward substitution, tile by tile; a task holds a tile's vector and one chunk of the factors."""
        grid, number, given = self.grid, dtype_of(self.kind), dtype_of(b.kind)

        def wanted(key: int) -> Iterator[int]:
            chunks = np.flatnonzero(grid.bucket == grid.bucket[grid.number(key)])
            return iter(range(2 * int(chunks[0]), 2 * int(chunks[-1]) + 2))

        def make() -> Step:
            held: dict[str, Any] = {"tile": -1}

            def step(row: Row) -> list[Row]:
                j = grid.number(row["key"])
                t = int(grid.tile[j])
                low, end = grid.tile_rows(t)
                if t != held["tile"]:
                    held.update(tile=t, x=np.zeros(end - low, number))
                x, m, lo = held["x"], int(grid.hi[j] - grid.lo[j]), int(grid.lo[j]) - low
                mine = slice(lo, lo + m)
                cols, vals = np.frombuffer(row["cols"], np.int32).astype(np.int64), np.frombuffer(row["vals"], number)
                rows, inverse = np.repeat(np.arange(m), np.frombuffer(row["cnt"], np.int32)), np.frombuffer(row["inverse"], number)
                forward = row["seq"] < int(grid.first[t]) + int(grid.first[t + 1])
                inner = (cols >= lo) & (cols < lo + m)
                past = np.bincount(rows[~inner], weights=vals[~inner] * x[cols[~inner]], minlength=m)
                right = np.frombuffer(row["b"], given).astype(number) if forward else x[mine].copy()
                if forward:
                    finish = (lambda i, s: ((right[i] - (s + past[i])) * inverse[i]).astype(number)) if diagonal_based else (lambda i, s: (right[i] - (s + past[i])).astype(number))
                else:
                    finish = (lambda i, s: (right[i] - (s + past[i]) * inverse[i]).astype(number)) if diagonal_based else (lambda i, s: ((right[i] - (s + past[i])) * inverse[i]).astype(number))
                x[mine] = triangle(rows[inner], cols[inner] - lo, vals[inner], finish, right, not forward)
                return [] if forward else [{"key": row["key"], "v": x[mine].tobytes()}]

            return _InOrder(step, wanted)

        made = _mapped(self._joined(factors, {"b": b}), make, "key int, v binary")
        return Vector(self._keep(made), "v", self.kind)


def _multiplied(row: Row, given: np.dtype, values: np.dtype, number: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A x of a chunk in one type, its own values of x, and the entries' rows and terms."""
    own = np.frombuffer(row["_x"], given)
    far = [np.frombuffer(m["v"], given) for m in sorted(row["got"] or [], key=lambda m: m["seq"])]
    rows = np.repeat(np.arange(len(own)), np.frombuffer(row["cnt"], np.int32))
    terms = np.frombuffer(row["vals"], values).astype(number) * np.concatenate([own, *far]).astype(number)[np.frombuffer(row["cols"], np.int32)]
    return np.bincount(rows, weights=terms, minlength=len(own)).astype(number), own, rows, terms


def _tile_columns(grid: Grid, j: int, cols: np.ndarray, far: bytes, m: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Entries' columns by their number in the matrix, the tile's first row, and which columns are the tile's."""
    low, end = grid.tile_rows(int(grid.tile[j]))
    at = np.concatenate([np.arange(grid.lo[j], grid.hi[j]), np.frombuffer(far, np.int64)])[cols]
    return at, low, (at >= low) & (at < end)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array with where they begin and end."""
    values, begin = np.unique(x, return_index=True)
    return values, begin, np.append(begin, len(x))[1:]


def _packed(key: int, kinds: dict[str, str], out: dict[str, Any]) -> Row:
    return {"key": key} | {k: v.astype(dtype_of(kinds[k])).tobytes() if k in kinds else float(v) for k, v in out.items()}


def _schema(kinds: dict[str, str], dots: tuple[str, ...]) -> str:
    return ", ".join(["key int", *(f"{k} binary" for k in kinds), *(f"{d} double" for d in dots)])
