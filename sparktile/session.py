"""A Spark session for the engine, and the tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "sparktile", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, one is made for a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tile-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tile-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tile_path = path
    return out


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """A table in the shared folder whose rows are dealt to ``n`` buckets by a key: what groups by it later does not move it."""
    spark = df.sparkSession
    name = f"tile_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.option("path", path).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out._tile_path, out._tile_name = path, name
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Delete tables that ``written`` or ``bucketed`` made."""
    for df in frames:
        path = getattr(df, "_tile_path", None)
        if name := getattr(df, "_tile_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
