"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import elementwise, matrices, tensors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = matrices.QUERIES | elementwise.QUERIES | tensors.QUERIES
ORACLE: dict[str, str] = matrices.ORACLE | elementwise.ORACLE | tensors.ORACLE
