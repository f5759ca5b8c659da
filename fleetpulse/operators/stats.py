"""Distribution tables: column reports, Kolmogorov-Smirnov, histograms, distribution functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import equal_width_bin
from fleetpulse.operators.ranking import exact_percentiles, running_totals, value_counts

KS_TERMS = 100


# ---- column reports -------------------------------------------------------------------------


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of the non-null values."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, cols: Sequence[str], below: int | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_distinct), optionally only the columns with fewer than ``below`` values.

    The exact form counts per (column, value) first, so no task holds a column's values;
    the approximate form is one pass with sketches.
    """
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        out = wide.unpivot([], list(cols), "column", "n_distinct")
    else:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
        out = (
            text.where(F.col("value").isNotNull()).select("column", "value").distinct()
            .groupBy("column").agg(F.count("*").alias("n_distinct"))
        )
    return out if below is None else out.where(F.col("n_distinct") < below)


def null_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, null_pct): NULLs as a percentage of the non-null count."""
    wide = df.agg(*[
        (100.0 * F.count_if(F.col(c).isNull()) / F.nullif(F.count(c), F.lit(0))).alias(c) for c in cols
    ])
    return wide.unpivot([], list(cols), "column", "null_pct")


def column_summary(df: DataFrame, cols: Sequence[str], points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, count, mean, std, min, p<percent>..., max), with exact percentiles."""
    # all but the percentiles straight from the rows: one pass, stable
    number = lambda c: F.col(c).cast("double")
    wide = df.agg(F.explode_outer(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(number(c)).alias("min"), F.max(number(c)).alias("max")) for c in cols
    ])).alias("s")).select("s.*").where("count > 0")
    pct = exact_percentiles(value_counts(df, cols), points)
    names = {p: f"p{round(p * 100):d}" for p in points}
    quantiles = pct.groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("percentile"))).alias(name) for p, name in names.items()
    ])
    return wide.join(quantiles, "column").select(
        "column", "count", "mean", "std", "min", *names.values(), "max"
    )


def box_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, lowest, q1, median, q3, highest), exact."""
    pct = exact_percentiles(value_counts(df, cols), [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "lowest", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "highest"}
    return pct.groupBy("column").agg(*[
        F.max(F.when(F.col("p") == p, F.col("percentile"))).alias(n) for p, n in names.items()
    ])


def composition(df: DataFrame, label: str = "milestone_name") -> DataFrame:
    """(n_total, dimensions, n_sick, n_healthy) of a labelled sample."""
    return df.agg(F.count("*").alias("n_total"), F.count(label).alias("n_sick")).select(
        "n_total", F.lit(len(df.columns)).alias("dimensions"), "n_sick", (F.col("n_total") - F.col("n_sick")).alias("n_healthy")
    )


def share_within(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, category, n, pct): share of each category inside its group, in percent."""
    cells = df.groupBy(group, category).agg(F.count("*").alias("n"))
    totals = cells.groupBy(group).agg(F.sum("n").alias("_t"))
    return cells.join(totals, group).select(group, category, "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"))


def mean_positives_per_day(df: DataFrame, day: str, label: str) -> DataFrame:
    """(mean_per_day, days): the positives of each day, averaged over days."""
    daily = df.groupBy(day).agg(F.sum(label).alias("n"))
    return daily.agg(F.avg("n").alias("mean_per_day"), F.count("*").alias("days"))


# ---- two-sample Kolmogorov-Smirnov ----------------------------------------------------------


def ks_p_value(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic (with the small-sample correction)."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + F.lit(0.12) + F.lit(0.11) / root) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    # the series does not settle for tiny arguments, where the probability is 1
    return F.when(lam < 0.1, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_two_sample(df: DataFrame, grp: str, first: object, measures: Sequence[str], with_missing_shares: bool = True) -> DataFrame:
    """(measurement, statistic, p_value, n1, n2) of the rows with ``grp == first`` against the rest.

    Both samples are counted per distinct value, then one distributed pass of running totals
    gives both distribution functions. Sorting by p-value is left to the reader.
    """
    measures = [m for m in measures if with_missing_shares or "miss" not in m.lower()]
    wide = df.select(
        (F.col(grp) == first).cast("long").alias("_x"), *[F.col(m).cast("double").alias(m) for m in measures]
    )
    counts = (
        wide.unpivot(["_x"], measures, "measurement", "value").where(F.col("value").isNotNull())
        .groupBy("measurement", "value").agg(F.sum("_x").alias("x"), F.sum(1 - F.col("_x")).alias("y"))
    )
    gap = F.abs(F.col("cum_x") / F.col("n1") - F.col("cum_y") / F.col("n2"))
    run = running_totals(counts, "value", ["x", "y"], by=["measurement"], totals=True).withColumnsRenamed({"all_x": "n1", "all_y": "n2"})
    stats = run.groupBy("measurement", "n1", "n2").agg(F.max(gap).alias("statistic"))
    return stats.select("measurement", "statistic", ks_p_value(F.col("statistic"), F.col("n1"), F.col("n2")).alias("p_value"), "n1", "n2")


def best_first(results: DataFrame, n: int, key: str = "p_value", tie: str = "measurement") -> DataFrame:
    """The first n results by a key (a top-k report)."""
    return results.orderBy(key, tie).limit(n)


# ---- histograms and distribution functions --------------------------------------------------


def _span(df: DataFrame, col: str) -> Column:
    return df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()


def binned(df: DataFrame, col: str, n_bins: int, name: str = "bin") -> DataFrame:
    """Adds the right-closed equal-width bin of a column over its own range."""
    x = F.col(col).cast("double")
    marked = df.withColumn("_s", _span(df, col))
    return marked.withColumn(
        name, equal_width_bin(x, F.col("_s.lo").cast("double"), F.col("_s.hi").cast("double"), n_bins)
    ).drop("_s")


def class_histogram(df: DataFrame, col: str, label: str, n_bins: int = 10) -> DataFrame:
    """(bin, sick_pct, healthy_pct): share of each class per bin, in percent; NULL for a class without rows."""
    cells = binned(df, col, n_bins).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count_if(F.col(label) == 1).alias("s"), F.count_if(F.col(label) == 0).alias("h")
    )
    totals = cells.agg(F.struct(F.sum("s").alias("s"), F.sum("h").alias("h")).alias("t"))
    return cells.withColumn("t", totals.scalar()).select(
        "bin", F.try_divide(100.0 * F.col("s"), F.col("t.s")).alias("sick_pct"), F.try_divide(100.0 * F.col("h"), F.col("t.h")).alias("healthy_pct")
    )


def grid_density(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """(gx, gy, n, log_n): counts and their decimal logarithm on a square grid."""
    cells = df.dropna(subset=[x, y]).groupBy(
        F.floor(F.col(x) / x_width).alias("gx"), F.floor(F.col(y) / y_width).alias("gy")
    ).agg(F.count("*").alias("n"))
    return cells.withColumn("log_n", F.log10("n"))


def cumulative_distribution(df: DataFrame, col: str) -> DataFrame:
    """(value, share): share of the non-null rows at or below each distinct value."""
    counts = (
        df.select(F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count("*").alias("n"))
    )
    return running_totals(counts, "value", ["n"], totals=True).select("value", (F.col("cum_n") / F.col("all_n")).alias("share"))


def shown_range(df: DataFrame, col: str, weekend: str, ratio: float = 0.9) -> DataFrame:
    """(low, high): the range that shows ``ratio`` of both the week and the weekend rows."""
    edge = (1 - ratio) / 2
    counts = (
        df.select(F.col(weekend).alias("grp"), F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull())
        .groupBy("grp", "value").agg(F.count("*").alias("n"))
    )
    pct = exact_percentiles(counts, [edge, 1 - edge], by=["grp"])
    return pct.agg(
        F.min(F.when(F.col("p") == edge, F.col("percentile"))).alias("low"),
        F.max(F.when(F.col("p") == 1 - edge, F.col("percentile"))).alias("high"),
    )


def week_histogram(df: DataFrame, col: str, weekend: str, n_bins: int = 1000) -> DataFrame:
    """(weekend, bin, n, density): normed histogram of each population over its own range.

    Bins are ``[lo + k w, lo + (k + 1) w)``, the last one closed.
    """
    base = df.select(F.col(weekend).alias("grp"), F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    span = base.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    slot = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width) + 1, F.lit(n_bins))
    ).cast("int")
    cells = base.join(span, "grp").groupBy("grp", slot.alias("bin"), "lo", "hi", "total").agg(F.count("*").alias("n"))
    return cells.select("grp", "bin", "n", F.when(width > 0, F.col("n") / F.col("total") / width).alias("density"))


def week_frequencies(df: DataFrame, col: str, weekend: str) -> DataFrame:
    """(weekend, value, freq): relative frequency of each value in each population."""
    cells = df.where(F.col(col).isNotNull()).groupBy(F.col(weekend).alias("grp"), F.col(col).alias("value")).agg(F.count("*").alias("n"))
    totals = cells.groupBy("grp").agg(F.sum("n").alias("total"))
    return cells.join(totals, "grp").select("grp", "value", (F.col("n") / F.col("total")).alias("freq"))
