"""Queries of shapes, placement, reductions, row products, kernels and control flow."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, kernel
from ..operators.expression import Constant
from ..operators.tensor import REDUCTIONS, Tensor
from ..session import shared_dir
from ..shape import DistributedShape
from ..sources.host import HostTensor, RemoteTensor, format_tensor
from ..streaming.streams import spmv_stream
from ..types import FLOAT32, FLOAT64, INT32, INT64
from .tables import embeddings, part_vector, supplier_part, table

TILES = 4
DEVICE = 1472  # tiles of a device
_N = "(SELECT count(*) FROM part)"
#: The tile of row i of n over four tiles: equal parts, the rest on the last.
_TILE = f"least(p_partkey // greatest({_N} // {TILES}, 1), {TILES - 1})"


def _price(spark: SparkSession, sf_dir: str, tiles: int = TILES) -> Tensor:
    return part_vector(spark, sf_dir, F.col("p_retailprice"), FLOAT64, tiles)


def _size(spark: SparkSession, sf_dir: str, tiles: int = TILES) -> Tensor:
    return part_vector(spark, sf_dir, F.col("p_size"), INT64, tiles)


def _values(t: Tensor, *keys: str, digits: int = 4) -> DataFrame:
    v = F.round("v", digits) if dict(t.df.dtypes)["v"] in ("double", "float") else F.col("v")
    return t.df.select(*keys, v.alias("v"))


def _elements(t: Tensor, digits: int = 4) -> DataFrame:
    """Every element of a tensor of rank 2 or more, with its flat place in the row."""
    return t.df.select("i", F.posexplode("v").alias("k", "e")).select("i", "k", (F.round(F.col("e").cast("double"), digits) + 0.0).alias("v"))


# --- reductions ---------------------------------------------------------------------
#: kind: (SQL of the aggregate over p_size-based input, input SQL)
_REDUCE = {
    "add": ("sum(x)::BIGINT", "p_size"),
    "mul": ("product(x)", "1 + p_size / 1000.0::DOUBLE"),
    "square_add": ("sum(x * x)::BIGINT", "p_size"),
    "logical_and": ("bool_and(x)", "p_size > 0"),
    "logical_or": ("bool_or(x)", "p_size > 49"),
    "min": ("min(x)::BIGINT", "p_size"),
    "max": ("max(x)::BIGINT", "p_size"),
}


def _reduce_input(kind: str, spark: SparkSession, sf_dir: str) -> Tensor:
    if kind == "mul":
        return part_vector(spark, sf_dir, F.lit(1.0) + F.col("p_size") / 1000.0, FLOAT64, TILES)
    if kind.startswith("logical"):
        from ..types import BOOL

        return part_vector(spark, sf_dir, F.col("p_size") > (0 if kind == "logical_and" else 49), BOOL, TILES)
    return _size(spark, sf_dir)


def _log_product(t: Tensor) -> DataFrame:
    """A product compared by its logarithm: it spans many orders of magnitude."""
    return t.df.select(*[c for c in t.df.columns if c != "v"], F.round(F.log("v"), 6).alias("v"))


def _reduce(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reduce_input(kind, spark, sf_dir).reduce(0, kind)
    return (_log_product(out) if kind == "mul" else out.df).select("v")


def _reduce_tile(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reduce_input(kind, spark, sf_dir).reduce_per_tile(0, kind)
    return (_log_product(out) if kind == "mul" else out.df).select("tile", "v")


def _reduce_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir).reduce_per_worker("add").df.select("i", "tile", "v")


def _reduce_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir).reduce_grouped(2, "add").df.select("tile", "v")


# Orders' prices over a device's tiles, and over four devices'; the distribution is regular, or a table of its own.
def _orders(spark: SparkSession, sf_dir: str, tiles: int) -> Tensor:
    orders = table(spark, sf_dir, "orders")
    return Tensor.from_dataframe(orders, F.col("o_custkey").cast("bigint"), F.col("o_orderkey"), (orders.count(),), tiles, INT64)


def _reduce_tile_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, DEVICE).reduce_per_tile().df.select("i", "tile", "v")


def _reduce_worker_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, DEVICE).reduce_per_worker("max").df.select("i", "tile", "v")


def _reduce_group_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 4 * DEVICE).reduce_grouped(DEVICE).df.select("i", "tile", "v")


def _reduce_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile t holds t % 5 + 1 rows of 3 * DEVICE, and the last one the rest: no two neighbours alike."""
    n = 3 * DEVICE
    rows = {t: t % 5 + 1 for t in range(DEVICE - 1)}
    rows[DEVICE - 1] = n + 2 * DEVICE - sum(rows.values())
    shape = DistributedShape.on_tiles((n + 2 * DEVICE,), rows)
    return Tensor.iota(spark, shape, INT64).reduce_per_tile().df.select("i", "tile", "v")


def _slice_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, 4 * DEVICE).slice_device(2, DEVICE).df.select("i", "tile", "v")


def _stream_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-part products of a vector that comes in several micro-batches, added up."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    part_vector(spark, sf_dir, F.col("p_size").cast("double"), FLOAT64).df.select("i", "v").repartition(3).write.parquet(f"{base}/in")
    vectors = spark.readStream.schema("i long, v double").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sink = lambda df, epoch: df.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
    spmv_stream(supplier_part(spark, sf_dir), vectors, sink, f"{base}/checkpoint", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("i").agg(F.round(F.sum("v"), 2).alias("v"))


def _reduce_trailing(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(embeddings(spark, sf_dir).reduce(1, kind))


def _reduce_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings(spark, sf_dir).reduce(0, "add")
    return out.df.select(F.posexplode("v").alias("k", "e")).select("k", (F.round(F.col("e").cast("double"), 2) + 0.0).alias("v"))


def _norm(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(part_vector(spark, sf_dir, F.col("p_retailprice") - 1500.0, FLOAT64, TILES).norm(kind), digits=3).select("v")


# --- shapes and placement -----------------------------------------------------------
def _broadcast_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = Constant([float(k) for k in range(64)], FLOAT32, (1, 64))
    return _elements((embeddings(spark, sf_dir) + row).lazy())


def _broadcast_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _elements((e * e.reduce(1, "max")).lazy())


def _broadcast_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _price(spark, sf_dir)
    column = Tensor(v.df.select("i", "tile", F.array("v").alias("v")), v.shape.push_back(1), FLOAT64)
    return _elements(column.broadcast((v.shape.dims[0], 3)).lazy())


def _permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    cube = Tensor(e.df, DistributedShape((e.shape.dims[0], 4, 16), e.shape.rows), e.dtype)
    return _elements(cube.permute(0, 2, 1).lazy())


def _rearrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _size(spark, sf_dir, 1)
    return v.rearrange(DistributedShape.linear(v.shape.dims, TILES)).df.select("i", "tile", "v")


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir).slice_tile(2).df.select("i", "v")


def _assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float vector assigned to an integer one: cast on the way."""
    v = _price(spark, sf_dir)
    return Tensor.uninitialised(spark, v.shape, INT32).assign(v).df.select("i", "v")


def _constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tensor.with_initial_value(spark, 2.5, DistributedShape.linear((1000,), TILES), FLOAT64).df.select("i", "tile", "v")


def _iota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(Tensor.iota(spark, DistributedShape.linear((8, 2), TILES)).reduce(1))


def _dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _elements(e.dot(e * 2.0).lazy(), 3)


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    part = lambda a, b: Tensor(e.df.withColumn("v", F.slice("v", a, b)), e.shape.with_trailing((3,)), e.dtype)
    a, b = part(1, 3), part(4, 3)
    return _elements(a.cross(b).lazy())


def _host_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host to remote to tile to host and back: the same values."""
    t = Tensor.iota(spark, DistributedShape.linear((8, 2), TILES))
    remote = RemoteTensor.of(HostTensor.of(t).to_tensor(spark))
    return _elements(remote.to_tile())


def _print(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = format_tensor(Tensor.iota(spark, DistributedShape.linear((8, 2), TILES)), "tensor")
    return spark.range(1).select(F.lit(text).alias("text"))


# --- kernels and control flow -------------------------------------------------------
def _centre(x):
    return {"y": x - x.mean()}


def _udf_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile's values about the tile's mean."""
    out = kernel.execute(_centre, x=kernel.In(_price(spark, sf_dir)), y=kernel.Out(FLOAT64))["y"]
    return _values(out, "i")


def _udf_threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernel.execute_threaded(lambda x, worker: {"y": x + worker}, x=kernel.In(_price(spark, sf_dir)), y=kernel.Out(FLOAT64))["y"]
    return _values(out, "i")


def _udf_single_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernel.execute_on_single_tile(lambda x, by: {"x": x * by}, 1, x=kernel.InOut(_price(spark, sf_dir)), by=kernel.Member(3.0))["x"]
    return _values(out, "i")


def _udf_tile_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kernel.execute(lambda x, tile: {"y": x * 0 + tile}, x=kernel.In(_price(spark, sf_dir)), y=kernel.Out(FLOAT64))["y"]
    return _values(out, "i")


def _subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return (e.element(5) - e.element(6)).lazy().df.select("i", (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _size(spark, sf_dir).narrow()
    return t.df.select("i", "v", F.lit(t.dtype.name).alias("type"))


def _reinterpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.reinterpret(_price(spark, sf_dir), INT64).df.select("i", "v")


def _repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of x <- x / 2 + 1."""
    out = control.repeat(3, lambda s: {"x": s["x"] * 0.5 + 1.0}, {"x": _price(spark, sf_dir)})
    return _values(out["x"], "i")


def _while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halve until the largest value is below 1."""
    out = control.while_(lambda s: s["x"].reduce(0, "max") >= 1.0, lambda s: {"x": s["x"] * 0.5}, {"x": _price(spark, sf_dir)})
    return _values(out["x"], "i", digits=6)


def _if(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _price(spark, sf_dir)
    return _values(control.if_(x.reduce(0, "max") > 0.0, lambda: x * 2.0, lambda: x).lazy(), "i")


QUERIES = (
    {f"reduce_{k}": partial(_reduce, k) for k in REDUCTIONS}
    | {f"reduce_tile_{k}": partial(_reduce_tile, k) for k in REDUCTIONS}
    | {f"reduce_trailing_{k}": partial(_reduce_trailing, k) for k in ("add", "square_add", "min", "max")}
    | {f"norm_{k.lower()}": partial(_norm, k) for k in ("L1", "L2", "LINF")}
    | {
        "reduce_worker": _reduce_worker,
        "reduce_group": _reduce_group,
        "reduce_tile_1472": _reduce_tile_device,
        "reduce_worker_1472": _reduce_worker_device,
        "reduce_group_5888": _reduce_group_devices,
        "reduce_irregular_1472": _reduce_irregular,
        "slice_device": _slice_device,
        "stream_products": _stream_products,
        "reduce_embeddings": _reduce_embeddings,
        "broadcast_row": _broadcast_row,
        "broadcast_col": _broadcast_col,
        "broadcast_to": _broadcast_to,
        "permute_021": _permute,
        "rearrange_tiles": _rearrange,
        "slice_tile": _slice,
        "assign_cast": _assign,
        "constant_tensor": _constant,
        "iota_reduce": _iota,
        "dot_embeddings": _dot,
        "cross_embeddings": _cross,
        "host_round_trip": _host_copy,
        "print_tensor": _print,
        "udf_per_tile": _udf_per_tile,
        "udf_threaded": _udf_threaded,
        "udf_single_tile": _udf_single_tile,
        "udf_tile_id": _udf_tile_id,
        "subscript": _subscript,
        "narrow_index": _narrow,
        "reinterpret_cast": _reinterpret,
        "control_repeat": _repeat,
        "control_while": _while,
        "control_if": _if,
    }
)


def _tile_sql(kind: str) -> str:
    sql, value = _REDUCE[kind]
    v = f"round(ln({sql}), 6)" if kind == "mul" else sql
    return f"SELECT tile::INTEGER AS tile, {v} AS v FROM (SELECT {_TILE} AS tile, {value} AS x FROM part) GROUP BY tile"


def _reduce_sql(kind: str) -> str:
    sql, value = _REDUCE[kind]
    return f"SELECT {f'round(ln({sql}), 6)' if kind == 'mul' else sql} AS v FROM (SELECT {value} AS x FROM part)"


def _orders_sql(tiles: int) -> str:
    n = "(SELECT count(*) FROM orders)"
    return f"SELECT least(o_orderkey // greatest({n} // {tiles}, 1), {tiles - 1}) AS tile, o_orderkey AS i, o_custkey AS x FROM orders"


_E = "(SELECT vec_id AS i, unnest(embedding)::DOUBLE AS e, unnest(range(64))::INTEGER AS k FROM embeddings)"
_PART = {"add": "sum(e)", "square_add": "sum(e * e)", "min": "min(e)", "max": "max(e)"}
_WORKER = f"""
WITH t AS (SELECT {_TILE} AS tile, p_partkey AS i, p_size AS x FROM part),
s AS (SELECT tile, min(i) AS first, count(*) AS n FROM t GROUP BY tile),
w AS (
  SELECT t.tile, x, CASE WHEN (n // 6) // 4 = 0 THEN 5 ELSE least((i - first) // (((n // 6) // 4) * 4), 5) END AS worker FROM t JOIN s USING (tile)
), every AS (SELECT tile, unnest(range(6)) AS worker FROM s)
SELECT (every.tile * 6 + every.worker)::BIGINT AS i, every.tile::INTEGER AS tile, coalesce(sum(x), 0)::BIGINT AS v
FROM every LEFT JOIN w ON w.tile = every.tile AND w.worker = every.worker GROUP BY every.tile, every.worker
"""
ORACLE = (
    {f"reduce_{k}": _reduce_sql(k) for k in REDUCTIONS}
    | {f"reduce_tile_{k}": _tile_sql(k) for k in REDUCTIONS}
    | {f"reduce_trailing_{k}": f"SELECT i, 0::INTEGER AS k, round({_PART[k]}::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS v FROM {_E} GROUP BY i" for k in _PART}
    | {
        "norm_l1": "SELECT round(sum(abs(p_retailprice - 1500)), 3) AS v FROM part",
        "norm_l2": "SELECT round(sqrt(sum((p_retailprice - 1500) * (p_retailprice - 1500))), 3) AS v FROM part",
        "norm_linf": "SELECT round(max(abs(p_retailprice - 1500)), 3) AS v FROM part",
        "reduce_worker": _WORKER,
        "reduce_group": f"SELECT (tile - tile % 2)::INTEGER AS tile, sum(x)::BIGINT AS v FROM (SELECT {_TILE} AS tile, p_size AS x FROM part) GROUP BY ALL",
        "reduce_tile_1472": f"SELECT tile AS i, tile::INTEGER AS tile, sum(x)::BIGINT AS v FROM ({_orders_sql(DEVICE)}) GROUP BY tile",
        "reduce_worker_1472": f"""
WITH t AS ({_orders_sql(DEVICE)}), s AS (SELECT tile, min(i) AS first, count(*) AS n FROM t GROUP BY tile),
w AS (SELECT t.tile, x, CASE WHEN (n // 6) // 4 = 0 THEN 5 ELSE least((i - first) // (((n // 6) // 4) * 4), 5) END AS worker FROM t JOIN s USING (tile)),
every AS (SELECT tile, unnest(range(6)) AS worker FROM s)
SELECT (every.tile * 6 + every.worker)::BIGINT AS i, every.tile::INTEGER AS tile, coalesce(max(x), -9223372036854775808)::BIGINT AS v
FROM every LEFT JOIN w ON w.tile = every.tile AND w.worker = every.worker GROUP BY every.tile, every.worker""",
        "reduce_group_5888": f"SELECT tile // {DEVICE} AS i, (tile - tile % {DEVICE})::INTEGER AS tile, sum(x)::BIGINT AS v FROM ({_orders_sql(4 * DEVICE)}) GROUP BY ALL",
        "reduce_irregular_1472": f"""
WITH t AS (SELECT range AS tile, range % 5 + 1 AS n FROM range({DEVICE - 1})),
every AS (SELECT tile, n FROM t UNION ALL SELECT {DEVICE - 1}, {5 * DEVICE} - (SELECT sum(n) FROM t)),
s AS (SELECT tile, n, sum(n) OVER (ORDER BY tile) - n AS first FROM every)
SELECT tile AS i, tile::INTEGER AS tile, (n * first + n * (n - 1) // 2)::BIGINT AS v FROM s""",
        "slice_device": f"SELECT i, tile::INTEGER AS tile, x::BIGINT AS v FROM ({_orders_sql(4 * DEVICE)}) WHERE tile // {DEVICE} = 2",
        "stream_products": "SELECT s_suppkey AS i, round(coalesce(sum(l_extendedprice * p_size), 0), 2) AS v FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL",
        "reduce_embeddings": f"SELECT k, round(sum(e)::FLOAT::DOUBLE, 2) + 0.0::DOUBLE AS v FROM {_E} GROUP BY k",
        "broadcast_row": f"SELECT i, k, round((e::FLOAT + k::FLOAT)::DOUBLE, 4) + 0.0::DOUBLE AS v FROM {_E}",
        "broadcast_col": f"SELECT i, k, round((e::FLOAT * (max(e) OVER (PARTITION BY i))::FLOAT)::DOUBLE, 4) + 0.0::DOUBLE AS v FROM {_E}",
        "broadcast_to": "SELECT p_partkey AS i, unnest(range(3))::INTEGER AS k, round(p_retailprice, 4) AS v FROM part",
        "permute_021": f"SELECT i, ((k % 16) * 4 + k // 16)::INTEGER AS k, round(e, 4) + 0.0::DOUBLE AS v FROM {_E}",
        "rearrange_tiles": f"SELECT p_partkey AS i, {_TILE}::INTEGER AS tile, p_size::BIGINT AS v FROM part",
        "slice_tile": f"SELECT p_partkey AS i, p_size::BIGINT AS v FROM part WHERE {_TILE} = 2",
        "assign_cast": "SELECT p_partkey AS i, trunc(p_retailprice)::INTEGER AS v FROM part",
        "constant_tensor": "SELECT range AS i, (range // 250)::INTEGER AS tile, 2.5::DOUBLE AS v FROM range(1000)",
        "iota_reduce": "SELECT range AS i, 0::INTEGER AS k, (4 * range + 1)::DOUBLE AS v FROM range(8)",
        "dot_embeddings": f"SELECT i, 0::INTEGER AS k, round(sum((e::FLOAT * (e * 2)::FLOAT)::DOUBLE)::FLOAT::DOUBLE, 3) AS v FROM {_E} GROUP BY i",
        "cross_embeddings": "SELECT vec_id AS i, k, round(((a[(k + 1) % 3 + 1] * b[(k + 2) % 3 + 1]) - (a[(k + 2) % 3 + 1] * b[(k + 1) % 3 + 1]))::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS v FROM (SELECT vec_id, embedding[1:3] AS a, embedding[4:6] AS b, unnest(range(3))::INTEGER AS k FROM embeddings)",
        "host_round_trip": "SELECT range // 2 AS i, (range % 2)::INTEGER AS k, range::DOUBLE AS v FROM range(16)",
        "print_tensor": "SELECT 'tensor<8x2xfloat> tensor = [\n' || string_agg('  [' || 2 * range || ', ' || 2 * range + 1 || ']', '\n' ORDER BY range) || '\n]\n' AS text FROM range(8)",
        "udf_per_tile": f"SELECT p_partkey AS i, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY {_TILE}), 4) AS v FROM part",
        "udf_threaded": "SELECT p_partkey AS i, round(p_retailprice + p_partkey % 6, 4) AS v FROM part",
        "udf_single_tile": f"SELECT p_partkey AS i, round(p_retailprice * 3, 4) AS v FROM part WHERE {_TILE} = 1",
        "reinterpret_cast": "SELECT p_partkey AS i, (p_retailprice::DOUBLE)::BIT::BIGINT AS v FROM part",
        "udf_tile_id": f"SELECT p_partkey AS i, {_TILE}::DOUBLE AS v FROM part",
        "subscript": "SELECT vec_id AS i, round((embedding[6] - embedding[7])::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS v FROM embeddings",
        "narrow_index": "SELECT p_partkey AS i, p_size::SMALLINT AS v, 'uint8' AS type FROM part",
        "control_repeat": "SELECT p_partkey AS i, round(p_retailprice / 8 + 1.75, 4) AS v FROM part",
        "control_while": "SELECT p_partkey AS i, round(p_retailprice / pow(2, floor(log2((SELECT max(p_retailprice) FROM part))) + 1), 6) AS v FROM part",
        "control_if": "SELECT p_partkey AS i, round(p_retailprice * 2, 4) AS v FROM part",
    }
)
