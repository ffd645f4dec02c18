"""Driver tables as tensors and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sparse import Matrix
from ..operators.tensor import Tensor
from ..types import FLOAT32, DType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_vector(spark: SparkSession, sf_dir: str, value: Column, dtype: DType, tiles: int = 1) -> Tensor:
    """A vector over parts, whose keys are dense from 0."""
    part = table(spark, sf_dir, "part")
    return Tensor.from_dataframe(part, value, F.col("p_partkey"), (part.count(),), tiles, dtype)


def embeddings(spark: SparkSession, sf_dir: str, tiles: int = 1) -> Tensor:
    """All embeddings as an (n, 64) tensor."""
    e = table(spark, sf_dir, "embeddings")
    return Tensor.from_dataframe(e, "embedding", "vec_id", (e.count(), 64), tiles, FLOAT32)


def customer_part(spark: SparkSession, sf_dir: str) -> Matrix:
    """A[customer, part]: the quantity ordered."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    entries = items.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n_rows, n_cols = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count()
    return Matrix.from_coo(entries, F.col("o_custkey"), F.col("l_partkey"), "l_quantity", n_rows, n_cols)


def supplier_part(spark: SparkSession, sf_dir: str) -> Matrix:
    """A[supplier, part]: the extended price."""
    items = table(spark, sf_dir, "lineitem")
    n_rows, n_cols = table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()
    return Matrix.from_coo(items, F.col("l_suppkey"), F.col("l_partkey"), "l_extendedprice", n_rows, n_cols)


def user_hour(spark: SparkSession, sf_dir: str) -> Matrix:
    """A[user, hour of day]: events counted."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.max("user_id") + 1).first()[0] or 1
    return Matrix.from_coo(events, "user_id", F.hour("ts"), F.lit(1.0), n, 24)
