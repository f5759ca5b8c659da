"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.store import Staged


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``u, v``.

    Every node first goes to its smallest neighbour and edges become edges of these, so that the many
    edges of a dense group are one node before the rounds read them again and again.
    """
    both = Staged(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct(), "components-edges")
    first = Staged(both.df.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("root")), "components-first")
    ends = both.df.where("u < v").join(first.df.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
    ends = ends.join(first.df.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
    between = Staged(ends.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "components-between")
    both.discard()
    merged = _settled(between.df).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return first.df.join(merged, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def _settled(edges: DataFrame) -> DataFrame:
    """The components by rounds. Each round takes the smallest label among neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a component's length. Labels are written after each
    round; the files of the round before are deleted.
    """
    both = Staged(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct(), "components-edges")
    labels = Staged(both.df.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("root")), "components-labels")
    while True:
        old = labels.df
        near = (
            both.df.join(old.select(F.col("node").alias("v"), F.col("root").alias("other")), "v")
            .groupBy("u").agg(F.min("other").alias("other"))
        )
        step = old.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", "root", F.least("root", "other").alias("to"))
        jump = old.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        new = Staged(
            step.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("root"), F.col("root").alias("was")),
            "components-labels")
        moved = not new.df.where("root != was").isEmpty()
        labels.discard()
        labels = Staged.of(new, new.df.drop("was"))
        if not moved:
            return labels.df
