"""Connected components of an edge table: minimum labels spread along edges, then jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(v, label) for every end of an edge (a, b); label is the smallest end reachable.

    Each round is written to the shared folder: labels and edges join as plain
    exchanges of tables, so that a hub's rows can be split, and minima are
    combined before they move.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    sym = scratch.write(both.where("u <> v").distinct(), f"{tag}_edges")
    labels = scratch.write(sym.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), f"{tag}_0")
    turn = 0
    while True:
        turn += 1
        near = labels.select(F.col("v").alias("u"), F.col("label").alias("near"))
        spread = sym.join(near, "u").select("v", F.col("near").alias("label")).union(labels)
        step = scratch.write(spread.groupBy("v").agg(F.min("label").alias("label")), f"{tag}_{turn}_spread")
        up = step.select(F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = scratch.write(step.join(up, "label").select("v", F.least("label", "top").alias("label")), f"{tag}_{turn}")
        before, after = (x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0] for x in (labels, jumped))
        scratch.drop(f"{tag}_{turn - 1}", f"{tag}_{turn}_spread")
        labels = jumped
        if before == after:  # labels only ever fall
            scratch.drop(f"{tag}_edges")
            return labels
