"""Shards of documents along a Hilbert curve over their metadata.

Each dimension is quantised into ``2**bits`` ranges of about equally many documents, the ranges give
a cell, and cells are ordered by their place on the Hilbert curve, so that a run of neighbouring
cells is a compact box: files cut from the order have narrow ranges in every dimension, and readers
skip files by any of them. Runs are cut by equal rows or equal bytes.

Places in the order are prefix sums over buckets inside a cell (``store.prefix_sums``); no task sorts
a whole cell, and no range is sampled, so a recomputed task finds the same order.

Defined results: nulls are the lowest value of a dimension. A null text has size 16. Equal rows are
placed one after the other. An empty table gives an empty table; with fewer rows than shards some
shards are empty. The document's own columns stay inside ``row``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.expressions import coarse, uniform, whole
from fleetpulse.llm.store import prefix_sums, stage

HEADER = 16


def hilbert_index(coordinates: pd.DataFrame, bits: int) -> pd.Series:
    """Place on the Hilbert curve of points with ``bits`` bits per dimension (Skilling 2004)."""
    x = [coordinates.iloc[:, d].to_numpy(dtype="int64", copy=True) for d in range(coordinates.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo excess rotations and reflections
        q, below = 1 << level, (1 << level) - 1
        for d in range(n):
            high = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & below
            x[0] ^= (high * below) | (~high * swap)
            if d:
                x[d] ^= ~high * swap
    for d in range(1, n):  # Gray code
        x[d] ^= x[d - 1]
    flip = x[-1] * 0
    for level in range(bits - 1, 0, -1):
        flip ^= ((x[-1] >> level) & 1) * ((1 << level) - 1)
    index = flip * 0
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            index = (index << 1) | (((x[d] ^ flip) >> level) & 1)
    return pd.Series(index)


def _ranges(df: DataFrame, name: str, bits: int) -> DataFrame:
    """Distinct values of a dimension with the range of each: the share of documents below it, scaled."""
    counts = df.groupBy(F.col(name).alias(f"__v_{name}")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("n").over(everything.orderBy(F.col(f"__v_{name}").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = below + F.col("n") / F.lit(2.0)
    place = F.floor(F.lit(float(2**bits)) * middle / F.sum("n").over(everything))
    return counts.select(f"__v_{name}", F.least(place, F.lit(2**bits - 1)).cast("long").alias(f"__q_{name}"))


def text_bytes(text: Column) -> Column:
    """Size of a document in a shard: its UTF-8 bytes and a fixed header."""
    return F.octet_length(whole(text)).cast("long") + F.lit(HEADER)


def sharded(
    docs: DataFrame,
    shards: int = 40,
    law: str = "rows",
    bits: int = 4,
    rows_per_bucket: int = 20_000,
    doc_id: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang"),
    keep_text: bool = True,
) -> DataFrame:
    """Every document (inside ``row``) with ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Dimensions are the named columns and the size of the text. ``law`` is ``rows`` (counts of shards
    differ by one at most) or ``bytes`` (a shard takes the documents whose middle byte lies in its
    share of all bytes).
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    col = lambda c: docs[f"`{c}`"]
    row = F.struct(*[col(c) for c in docs.columns if keep_text or c != text])
    size = text_bytes(col(text))
    dims = {f"__d{i}": col(c).cast("string") for i, c in enumerate(dimensions)} | {f"__d{len(dimensions)}": coarse(size, 4)}
    df = docs.select(
        row.alias("row"), col(doc_id).alias("__id"), size.alias("size"), F.crc32(whole(col(text))).alias("text_crc32"),
        *[c.alias(n) for n, c in dims.items()])
    if not keep_text:
        df = stage(df, "sharding-documents")
    names = list(dims)
    for n in names:
        cut = stage(_ranges(df, n, bits).coalesce(1), "sharding-ranges")
        df = df.join(cut, F.col(n).eqNullSafe(F.col(f"__v_{n}"))).drop(f"__v_{n}", n)
    # the curve has 2 ** (bits * dimensions) cells: their counts are a table of bounded size
    curve = F.pandas_udf(lambda p: hilbert_index(p, bits), "long")
    df = df.withColumn("curve", curve(F.struct(*[F.col(f"__q_{n}") for n in names]))).drop(*[f"__q_{n}" for n in names])
    df = df.withColumn("__u", uniform(11, F.col("__id"), F.col("text_crc32")))
    cells = df.groupBy("curve").agg(F.count("*").alias("__n"))
    df = df.join(F.broadcast(cells), "curve")
    parts = F.ceil(F.col("__n") / F.lit(rows_per_bucket))
    df = df.withColumn("__bucket", F.least(F.floor(F.col("__u") * parts), parts - 1)).drop("__n")
    order = [F.col("__u"), F.col("__id"), F.col("text_crc32"), F.col("size")]
    df = df.withColumn("__one", F.lit(1).cast("long"))
    df = prefix_sums(df, [], ["curve", "__bucket"], order, "__one", "__place", "__rows")
    if law == "rows":
        shard = f"((__place * {shards}) div __rows)"  # the first place of shard s is ceil(s * rows / shards)
        slot = F.expr(f"__place - ({shard} * __rows + {shards - 1}) div {shards}")
        return df.select("row", "size", "text_crc32", "curve", F.expr(shard).cast("int").alias("shard"), slot.alias("slot"))
    df = prefix_sums(df, [], ["curve", "__bucket"], order, "size", "__offset", "__bytes")
    shard = F.least(F.expr(f"((2 * __offset + size) * {shards}) div (2 * __bytes)"), F.lit(shards - 1)).cast("int")
    df = stage(df.withColumn("shard", shard), "sharding-places")
    firsts = df.groupBy("shard").agg(F.min("__place").alias("__first"))  # one row per shard
    return df.join(F.broadcast(firsts), "shard").select(
        "row", "size", "text_crc32", "curve", "shard", (F.col("__place") - F.col("__first")).alias("slot"))
