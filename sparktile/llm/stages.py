"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Cases, beside those that the operators' own modules state: a document without an id is
kept by every stage that its text passes; null and empty texts are scored like empty
ones, are linked with nothing, hold no passage and no personal data, and are packed as
their end token; very long texts are read whole; rows that share an id are told apart by
their texts; of repeated rows with an id one stays after near_dedup; ties go to the
smallest id, then to the first text in hash order; an empty table gives no rows and the
same columns; further columns, whatever they are called, keep their values up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dedup as near, rule_ensemble
from . import packing as packing_op
from . import pii as pii_op
from .common import Scratch, fold, place, positional, table
from .queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score falls short of the threshold go."""
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (five words, 0.8) stays, with the smallest id; rows without an id or words stay.

    Rows are told apart by id and text, as ids may be shared; of equal rows one stays.
    """
    scratch, key = Scratch(spark), ["doc", "th"]
    rows = near.judged(docs).where("doc_id is not null and label is not null").withColumnRenamed("doc_id", "doc")
    rows = scratch.write(rows.select(*key, "label", "kept"), "rows")
    # Rows of the smallest id may be several: those of the first text stay, and of them one.
    many = rows.where("kept").groupBy("label").agg(F.count("*").alias("n"), F.min("th").alias("first")).where("n > 1")
    many = scratch.write(many, "many")
    others = rows.where("kept").join(many, "label").where("th <> first")
    gone = scratch.write(rows.where("not kept").select(*key).union(others.select(*key)).distinct(), "gone")
    few = lambda df: F.broadcast(df) if df.count() <= near.BROADCAST_ROWS else df
    inner, names = positional(docs)
    marked = inner.withColumn("doc", F.col(place(names, "doc_id")).cast("long")).withColumn("th", F.xxhash64(F.col(place(names, "text")).cast("string")))
    left = marked.join(few(gone), key, "left_anti")
    if not many.isEmpty():
        again = scratch.write(rows.where("kept").join(many.select("label", F.col("first").alias("th")), ["label", "th"]).select(*key).distinct(), "again")
        left = left.join(few(again), key, "left_anti").unionByName(left.join(few(again), key, "left_semi").dropDuplicates(key))
    return left.select(*inner.columns).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that is nothing else goes."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and disclosing terms are generalised or removed."""
    return pii_op.sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its sequence and offset."""
    return packing_op.pack(docs, tokenizer_path())
