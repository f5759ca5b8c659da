"""Global orderings without a single-task sort.

Every operator here works in two levels: totals per bucket of the order (a table of
bounded size), then a window inside each bucket. No window ever holds a whole table or a
whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import stable_hash
from fleetpulse.session import staged

DIGITS = 3  # hexadecimal digits by which radix selection lengthens a prefix
RANKED = 50_000  # rows that it leaves to one ranking


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each non-null value occurs in each column."""
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = numeric.unpivot([], list(cols), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, totals: bool = False
) -> DataFrame:
    """Inclusive running totals ``cum_<s>`` along ``order`` inside each ``by`` group, and with ``totals`` the
    group's sum ``all_<s>``.

    ``df`` holds one row per (by, order) value, i.e. it is already aggregated. It is range-partitioned by
    group and order and written with the number of its range; Spark samples the cut points and merges small
    ranges. A range's offset comes from the table of sums per group and range, so a group of any size is
    spread over many tasks and no row carries more than its own columns. Exact whatever the cut points.
    """
    by = list(by)
    ranges = staged(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = W.partitionBy(*by)
    nth = F.col("_range").desc() if descending else F.col("_range").asc()
    before = group.orderBy(nth).rowsBetween(W.unboundedPreceding, -1)
    parts = ranges.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = parts.select(
        *by, "_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *([F.sum(s).over(group).alias(f"all_{s}") for s in sums] if totals else []),
    )
    key = F.col(order).desc() if descending else F.col(order).asc()
    inside = W.partitionBy(*by, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranges.join(offsets, [*by, "_range"])
        .withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"_off_{s}") for s in sums})
        .drop("_range", *[f"_off_{s}" for s in sums])
    )


def dense_index(df: DataFrame, ids: Sequence[str], name: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Gap-free numbers 1..n inside each ``by`` group, in the order of a stable hash of ``ids``.

    The ranges of hashes follow the rows, so none grows with the table."""
    marked = df.withColumn("_h", stable_hash(*ids, seed=seed)).withColumn("_one", F.lit(1).cast("long"))
    return running_totals(marked, "_h", ["_one"], by).withColumnRenamed("cum__one", name).drop("_h", "_one")


def kth_hash(df: DataFrame, ids: Sequence[str], k: Column, seed: int = 0) -> DataFrame:
    """One row: the k-th smallest stable hash of ``ids`` (``k`` may be a scalar subquery).

    Radix selection: counts per prefix find the prefix that holds the k-th value, and longer prefixes are
    counted inside it until at most ``RANKED`` rows are left, which are ranked.
    """
    spark = df.sparkSession
    hashes = staged(df.select(stable_hash(*ids, seed=seed).alias("h")), "hashes")
    need, prefix, n = spark.range(1).select(k.cast("long")).first()[0], "", None
    while need is not None and (n is None or n > RANKED) and len(prefix) < 32:
        part = hashes.where(F.startswith("h", F.lit(prefix))).groupBy(F.substring("h", 1, len(prefix) + DIGITS).alias("b"))
        hit = None
        for r in sorted(part.agg(F.count("*").alias("n")).collect()):  # at most 16 ** DIGITS rows
            if 0 < need <= r.n:
                hit = r
                break
            need -= r.n
        if hit is None:
            need = None
        else:
            prefix, n = hit.b, hit.n
    left = hashes.where(F.startswith("h", F.lit(prefix))) if need is not None else hashes.where("false")
    ranked = left.groupBy("h").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("h")))  # at most RANKED rows
    return ranked.where(F.col("upto") >= F.lit(need)).agg(F.min("h").alias("cut"))


def kth_hashes(hashes: DataFrame, need: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(grp, cut): in each group the ``need``-th smallest hash; groups with too few hashes, or no need, have no row.

    ``hashes`` has (cell, h), ``need`` one row per group (grp, need), and ``cells`` tells which cells a group
    consists of (cell, grp); without it each cell is a group. Radix selection for all groups at once: hashes are
    counted per cell and prefix, only the counts are spread over groups, and prefixes get longer until each
    group has at most ``RANKED`` hashes left, which are ranked.
    """
    spread = lambda t: t.withColumnRenamed("cell", "grp") if cells is None else t.join(cells, "cell")
    spots, inside, depth = need.where("need > 0"), hashes, 0
    while True:
        depth += DIGITS
        counts = inside.groupBy("cell", F.substring("h", 1, depth).alias("p")).agg(F.count("*").alias("n"))
        sums = spread(counts).groupBy("grp", "p").agg(F.sum("n").alias("n"))
        if depth > DIGITS:  # a cell may have been counted for another of its groups
            sums = sums.join(spots.select("grp", F.col("p").alias("head")), "grp").where(F.startswith("p", "head")).drop("head")
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("grp").orderBy("p"))).join(spots.select("grp", "need"), "grp")
        hit = run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        spots = staged(hit.select("grp", "p", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need")), "prefixes")
        members = spots.withColumnRenamed("grp", "cell") if cells is None else cells.join(spots, "grp")
        heads = members.select("cell", F.col("p").alias("head")).distinct()
        inside = hashes.join(heads, "cell").where(F.startswith("h", "head")).select("cell", "h")
        if depth >= 32 or (spots.agg(F.max("n")).first()[0] or 0) <= RANKED:
            break
    last = spread(inside.groupBy("cell", "h").agg(F.count("*").alias("n"))).join(spots.drop("n"), "grp").where(F.startswith("h", "p"))
    last = last.groupBy("grp", "need", "h").agg(F.sum("n").alias("n"))
    ranked = last.withColumn("upto", F.sum("n").over(W.partitionBy("grp").orderBy("h")))  # at most RANKED rows a group
    return ranked.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("grp", F.col("h").alias("cut"))


def hash_sample(df: DataFrame, ids: Sequence[str], k: Column, seed: int = 0) -> DataFrame:
    """Exactly min(k, n) rows, drawn without replacement in stable-hash order; ``ids`` must be unique.

    The wide rows are only filtered against one threshold; nothing wide is shuffled.
    """
    n = df.agg(F.count("*").alias("n")).scalar()
    cut = kth_hash(df, ids, F.least(k.cast("long"), n), seed).scalar()
    return df.where((k > 0) & (stable_hash(*ids, seed=seed) <= cut))


def top_by_score(df: DataFrame, score: str, row_id: str, k: Column, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best-scored rows (of each ``by`` group), all scored rows if there are fewer; ties at the last
    place go to the smaller id. Rows with a NULL score are never among them. ``k`` may use ``n_rows``, the
    number of rows of the group, with or without a score.

    The cut score comes from counts per distinct score, the cut id from the rows tied at
    that score; the rows themselves are only filtered.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count(score).alias("scored"))
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum("scored").alias("scored"))
    wanted = sizes.select(*by, F.least(k.cast("long"), F.col("scored")).alias("k"))
    curve = running_totals(counts.where(F.col("s").isNotNull()).drop("scored"), "s", ["n"], by, descending=True)
    curve = curve.join(wanted, by) if by else curve.withColumn("k", wanted.select("k").scalar())
    edge = curve.where((F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
    edge = edge.select(*by, F.col("s").alias("_cut"), (F.col("k") - F.col("cum_n") + F.col("n")).alias("_need"))
    if by:
        edge = staged(edge, "edges")  # a row a group
        cut = df.join(edge, by)
    else:
        cut = df.withColumn("_e", edge.select(F.struct("_cut", "_need")).scalar()).withColumns({"_cut": F.col("_e._cut"), "_need": F.col("_e._need")}).drop("_e")
    tied = cut.where(F.col(score) == F.col("_cut")).select(*by, F.col(row_id).alias("i"), "_need", F.lit(1).alias("one"))
    last = running_totals(tied, "i", ["one"], by).where(F.col("cum_one") == F.col("_need")).select(*by, F.col("i").alias("_last"))
    cut = cut.join(last, by) if by else cut.withColumn("_last", last.select("_last").scalar())
    kept = (F.col(score) > F.col("_cut")) | ((F.col(score) == F.col("_cut")) & (F.col(row_id) <= F.col("_last")))
    return cut.where(kept).drop("_cut", "_need", "_last")


def exact_percentiles(counts: DataFrame, points: Sequence[float], by: Sequence[str] = ("column",)) -> DataFrame:
    """(by..., p, percentile): exact linearly interpolated percentiles from value counts.

    The built-in ``percentile`` keeps every distinct value of a group in one task; this one
    finds the two order statistics around each position from running counts.
    """
    by = list(by)
    run = running_totals(counts, "value", ["n"], by=by, totals=True)
    # each value covers the zero-based ranks [cum - n, cum - 1]
    lo, hi = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    spots = F.array(*[F.struct(F.lit(float(p)).alias("p"), (p * (F.col("all_n") - 1)).alias("pos")) for p in points])
    inside = F.filter(spots, lambda s: (F.ceil(s["pos"]) >= lo) & (F.floor(s["pos"]) <= hi))
    hits = run.select(*by, "value", lo.alias("lo"), hi.alias("hi"), F.explode(inside).alias("s")).select(*by, "value", "lo", "hi", "s.p", "s.pos")
    low, high = F.floor("pos"), F.ceil("pos")
    return (
        hits.groupBy(*by, "p", "pos")
        .agg(
            F.max(F.when((low >= F.col("lo")) & (low <= F.col("hi")), F.col("value"))).alias("a"),
            F.max(F.when((high >= F.col("lo")) & (high <= F.col("hi")), F.col("value"))).alias("b"),
        )
        .select(*by, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("percentile"))
    )


def average_ranks(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``rank``: the mean rank shared by all rows with that value, inside each group."""
    run = running_totals(counts, "value", ["n"], by=by)
    return run.withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).drop("cum_n")
