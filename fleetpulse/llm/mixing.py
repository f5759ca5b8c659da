"""Mixing sources to target weights by Efraimidis-Spirakis keys.

Each source gets a target in words. A target is met by complete epochs over the source first and
then by a fraction of one more: documents take exponential keys divided by their quality weight,
are sorted by key within the source, and a prefix sum of their sizes runs up to the rest of the
budget; the document on the edge is in if that brings the total nearer. Keys come from a hash of
the id, so a rerun gives the same mix. Sorting happens inside key ranges of a source
(``store.prefix_sums``), so a source with a third of all documents is spread over many tasks.

Defined results: a null text has size 0 and is never taken. Null sources are one source, the last.
Rows that are equal are separate documents. Without any words all targets are 0. An empty table
gives an empty table. The document's own columns stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.expressions import n_words, uniform, whole
from fleetpulse.llm.store import prefix_sums, stage

ODD = r"[0-9#*$%&|<>]"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 as digits and symbols take over."""
    odd = F.regexp_count(whole(text), F.lit(ODD)).cast("double")
    return F.lit(1.0) - F.lit(0.9) * F.least(F.lit(1.0), F.lit(4.0) * odd / F.greatest(F.length(whole(text)), F.lit(1)))


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Add ``target`` to a table with one row per source (``source``, ``source_size``).

    Sources in code point order, null last, take the weights in turn and share the whole size. A
    target stops at ``cap`` times the source; the excess goes to the others by weight, which ends
    where one level times weight holds for all that are not capped. The level is found by running
    sums over sources in the order in which they would be capped.
    """
    place = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("__rank", F.row_number().over(place) - 1)
    df = df.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")))
    df = df.withColumn("__limit", F.lit(float(cap)) * F.col("source_size")).withColumn("__ratio", F.col("__limit") / F.col("__w"))
    everything = Window.partitionBy()
    order = everything.orderBy("__ratio", "__rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything)
    level = (total - F.coalesce(F.sum("__limit").over(earlier), F.lit(0.0))) / F.sum("__w").over(later)
    df = df.withColumn("__level", level)
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__rank", "__level"))).over(everything)
    df = df.withColumn("__final", first["__level"])
    target = F.least(F.col("__limit"), F.coalesce(F.col("__final") * F.col("__w"), F.col("__limit")))
    return df.select(*sources.columns, F.round(target, 6).alias("target"))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: int = 7,
    rows_per_bucket: int = 5_000,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_text: bool = True,
) -> DataFrame:
    """Every document (inside ``row``) with ``size``, ``source_size``, ``target``, ``epochs``, ``extra`` and ``taken``."""
    col = lambda c: docs[f"`{c}`"]
    row = F.struct(*[col(c) for c in docs.columns if keep_text or c != text])
    df = docs.select(
        row.alias("row"), col(doc_id).alias("__id"), col(source).cast("string").alias("source"), n_words(col(text)).alias("size"),
        quality_weight(col(text)).alias("weight"), uniform(seed, col(doc_id)).alias("__u"))
    df = stage(df.withColumn("key", -F.log("__u") / F.col("weight")), "mixing-documents")
    sources = df.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("__docs"), F.avg("weight").alias("__avg_weight"))
    targets = stage(source_targets(sources, weights, cap).coalesce(1), "mixing-targets")
    df = df.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    df = df.withColumns({"__null": F.col("source").isNull(), "__source": F.coalesce("source", F.lit(""))})
    ranges = F.ceil(F.col("__docs") / F.lit(rows_per_bucket))
    share = F.lit(1.0) - F.exp(-F.col("key") * F.col("__avg_weight"))  # grows with the key, even over [0, 1)
    df = df.withColumn("__bucket", F.least(F.floor(share * ranges), ranges - 1))
    df = prefix_sums(df, ["__null", "__source"], ["__bucket"], [F.col("key"), F.col("__id"), F.col("size")], "size", "__earlier", "__all")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    df = df.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("epochs") < cap) & (F.col("__earlier") + F.col("size") / F.lit(2.0) <= rest)
    df = df.withColumn("extra", extra.cast("long"))
    return df.select(
        "row", "source", "size", "source_size", "target", "weight", "key", "epochs", "extra",
        ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"))


def copies(mix: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as it is taken."""
    n = F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(F.lit(0))
    return mix.where(n > 0).select("row", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("__copy")).select("row.*")
