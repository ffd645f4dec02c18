"""Matrix Market files as frames of coordinates; nothing but the header goes to the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Header:
    object: str
    format: str
    field: str
    symmetry: str
    rows: int
    cols: int
    entries: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())


def read_header(spark: SparkSession, path: str) -> tuple[Header, int]:
    """The header, and the place of the line that holds the sizes."""
    lines = _lines(spark, path)
    banner = lines.where(F.lower("value").startswith("%%matrixmarket")).orderBy("at").first()
    if banner is None:
        raise ValueError(f"{path} has no Matrix Market banner")
    words = [*banner.value.lower().split()[1:], "general"]
    kind, form, field, symmetry = (words[0], words[1], words[2], words[3])
    if kind not in ("matrix", "vector") or form not in ("coordinate", "array") or field not in ("real", "double", "integer", "pattern"):
        raise ValueError(f"unsupported Matrix Market header {banner.value!r}")
    # The sizes follow the banner; of a folder's other files nothing is known about their order.
    sizes = lines.where(~F.trim("value").startswith("%") & (F.trim("value") != "") & (F.col("at") > banner["at"])).orderBy("at").first()
    n = [int(x) for x in sizes.value.split()]
    if kind == "vector":
        n = [n[0], 1, *n[1:]]
    entries = n[2] if len(n) > 2 else n[0] * n[1]
    return Header(kind, form, field, symmetry, n[0], n[1], entries), sizes["at"]


def read_triplets(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """(row, col, val), 0-based; symmetric halves are mirrored, patterns are ones. A vector's entries have their line's place, at."""
    header, sizes_at = read_header(spark, path)
    lines = _lines(spark, path).where(~F.trim("value").startswith("%") & (F.trim("value") != "") & (F.col("at") != sizes_at))
    if header.format == "array":
        # Lines count through the file's splits, in order; a split is one row here, of which there are few.
        part = F.shiftright("at", 33)
        parts = lines.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = parts.select("part", (before - F.col("first")).alias("shift"))
        lines = lines.withColumn("part", part).join(F.broadcast(places), "part")
        at = F.col("at") + F.col("shift")
        # Comments stand before the sizes, so entries are consecutive lines of a split.
        frame = lines.select(at.alias("k"), F.trim("value").cast("double").alias("val"))
        frame = frame.select((F.col("k") % header.rows).alias("row"), F.floor(F.col("k") / header.rows).cast("bigint").alias("col"), "val")
        return frame, header
    f = F.split(F.trim("value"), r"\s+")
    row = F.get(f, F.lit(0)).cast("bigint") - 1
    if header.object == "vector":
        col, value = F.lit(0).cast("bigint"), F.get(f, F.lit(1))
    else:
        col, value = F.get(f, F.lit(1)).cast("bigint") - 1, F.get(f, F.lit(2))
    val = F.lit(1.0) if header.field == "pattern" else value.cast("double")
    frame = lines.select(row.alias("row"), col.alias("col"), val.alias("val"), *(["at"] if header.object == "vector" else []))
    if header.symmetry in ("symmetric", "skew-symmetric", "hermitian"):
        sign = -1.0 if header.symmetry == "skew-symmetric" else 1.0
        frame = frame.select("row", "col", "val")
        frame = frame.union(frame.where("row <> col").select(F.col("col"), F.col("row"), F.col("val") * sign))
    elif header.symmetry != "general":
        raise ValueError(f"unsupported symmetry {header.symmetry!r}")
    return frame, header


def read_vector(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(i, v) of a vector file, or of the first column of a matrix file; and its length. Gaps are not filled.

    Of entries with one index the later line's value counts.
    """
    frame, header = read_triplets(spark, path)
    first = frame.where("col = 0")
    if "at" in frame.columns:
        first = first.groupBy("row").agg(F.max_by("val", "at").alias("val"))
    return first.select(F.col("row").alias("i"), F.col("val").alias("v")), header.rows


def densify(vector: DataFrame, n: int) -> DataFrame:
    """(i, v) with a row for every index: 0 where the vector has none, and the largest value where it has several."""
    vector = vector.groupBy("i").agg(F.max("v").alias("v"))
    return vector.sparkSession.range(n).select(F.col("id").alias("i")).join(vector, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def write_triplets(frame: DataFrame, path: str, rows: int, cols: int) -> None:
    """A folder of part files that ``read_triplets`` reads: the banner in one, entries in the others."""
    entries = frame.select(F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("val").cast("string")).alias("value"))
    n = frame.count()
    spark = frame.sparkSession
    head = spark.range(1, numPartitions=1).select(F.lit(f"%%MatrixMarket matrix coordinate real general\n{rows} {cols} {n}").alias("value"))
    head.union(entries).write.mode("overwrite").text(path)
