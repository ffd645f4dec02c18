"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once inside a Python worker
BATCH_BYTES = 8 << 20  # of one Arrow batch, unless the session says otherwise
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so that rows of long texts do not add up in a worker.

    Set on the session, as plans read it when they run; a smaller setting is kept.
    """
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, one is made for a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[Scratch] = []


def clean() -> None:
    """Delete every table that operators have written for this driver, once their results are no longer read."""
    while _MADE:
        _MADE.pop().drop()


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.name = f"llm_{uuid.uuid4().hex}"
        self.spark, self.root = spark, f"{shared_dir(spark)}/{self.name}"
        self.named: dict[str, str] = {}  # tables that the catalogue knows
        _MADE.append(self)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, tag: str, key: str, n: int) -> DataFrame:
        """A table whose rows are dealt to ``n`` buckets by a key: what groups by it later moves only the other side."""
        self.named[tag] = f"{self.name}_{tag}"
        df.write.mode("overwrite").option("path", f"{self.root}/{tag}").bucketBy(n, key).saveAsTable(self.named[tag])
        return self.spark.table(self.named[tag])

    def drop(self, *tags: str) -> None:
        """Delete tables of this scratch; without a tag, all of it."""
        for tag in tags or tuple(self.named):
            if tag in self.named:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(tag)}")
        jvm = self.spark.sparkContext._jvm
        for tag in tags or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back to the system: Python workers live on, and what they hold adds up beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A mapper of batches that releases memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with its columns named by place, and their names: so no name can clash with an operator's own."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), df.columns


def place(names: list[str], column: str) -> str:
    """What ``positional`` calls a column."""
    low = [n.lower() for n in names]
    return f"c{names.index(column) if column in names else low.index(column.lower())}"


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame without columns that an operator is about to add: its own output replaces them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of text each (one longer text stands alone)."""
    column = batch.column(batch.schema.get_field_index(text_col))
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(column).to_pylist()], dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def pack_array(values: np.ndarray) -> bytes:
    """Bytes of an integer array, byte planes apart and compressed."""
    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return b"".join(
        len(c).to_bytes(4, "little") + c for c in (pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in planes)
    )


def unpack_array(blob: bytes, dtype, n: int) -> np.ndarray:
    """The array of ``n`` values that pack_array made."""
    dtype = np.dtype(dtype)
    if not n:
        return np.empty(0, dtype)
    planes, at = np.empty((dtype.itemsize, n), np.uint8), 0
    for p in planes:
        size = int.from_bytes(blob[at : at + 4], "little")
        p[:] = np.frombuffer(pa.decompress(blob[at + 4 : at + 4 + size], decompressed_size=n, codec="zstd"), np.uint8)
        at += 4 + size
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser's published constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
