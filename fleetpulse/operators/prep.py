"""Feature preparation: column selection, one-hot columns, imputation, scaling, balancing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import hash_number, stable_hash
from fleetpulse.operators.ranking import dense_index, exact_percentiles, hash_sample, value_counts


def feature_part(df: DataFrame, non_features: Sequence[str] = S.NON_FEATURES) -> DataFrame:
    """Feature columns only."""
    return df.select(*[c for c in df.columns if c not in non_features])


def drop_redundant(df: DataFrame) -> DataFrame:
    """Without the 54 features known to repeat another one (absent names are ignored)."""
    return df.drop(*S.redundant_features())


def with_suffixes(df: DataFrame, suffixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus the columns that end in one of the time suffixes, such as ``1d``."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.endswith(tuple(suffixes))])


def one_hot(df: DataFrame, categories: Mapping[str, tuple[str, Sequence[int]]]) -> DataFrame:
    """0/1 columns ``<prefix>_<value>`` in place of each column; NULL gives all zeros.

    ``categories`` maps a column to its prefix and values, so that no pass over the data is
    needed and training and scoring always agree on the columns.
    """
    dummies = [
        F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{prefix}_{v}")
        for c, (prefix, values) in categories.items()
        for v in values
    ]
    return df.select(*[c for c in df.columns if c not in categories], *dummies)


MODEL_AND_WEEKDAY = {"hardware_model": ("model", range(len(S.MODEL_IDS))), "weekday": ("wk", range(7))}


def undo_one_hot(prefix: str, values: Sequence[int]) -> Column:
    """The value whose 0/1 column is set; -1 when none is."""
    branches = reduce(
        lambda acc, v: acc.when(F.col(f"{prefix}_{v}") == 1, F.lit(v)),
        list(values)[1:],
        F.when(F.col(f"{prefix}_{values[0]}") == 1, F.lit(values[0])),
    )
    return branches.otherwise(F.lit(-1))


def _wide_percentiles(df: DataFrame, cols: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """One row of structs: for each point a struct with the percentile of every column."""
    long = exact_percentiles(value_counts(df, cols), list(points.values()))
    picks = [
        F.struct(
            *[F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("percentile"))).alias(c) for c in cols]
        ).alias(name)
        for name, p in points.items()
    ]
    return long.agg(*picks)


def impute(df: DataFrame, cols: Sequence[str], method: str = "zero") -> DataFrame:
    """NULLs of the columns replaced by 0, the column's mean or its exact median."""
    if method == "zero":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})
    if method == "mean":
        fill = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("fill"))
    elif method == "median":
        fill = _wide_percentiles(df, cols, {"fill": 0.5})
    else:
        raise ValueError(f"unknown method {method!r}")
    out = df.withColumn("_fill", fill.scalar())
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill.{c}")) for c in cols}).drop("_fill")


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    stats = df.agg(
        F.struct(
            F.struct(*[F.avg(c).alias(c) for c in cols]).alias("mean"),
            F.struct(*[F.stddev_pop(c).alias(c) for c in cols]).alias("std"),
        ).alias("s")
    )
    out = df.withColumn("_s", stats.scalar())

    def scaled(c: str) -> Column:
        std = F.col(f"_s.std.{c}")
        return (F.col(c) - F.col(f"_s.mean.{c}")) / F.when(std == 0, F.lit(1.0)).otherwise(std)

    return out.withColumns({c: scaled(c) for c in cols}).drop("_s")


def robust_scale(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(x - median) / (high percentile - low percentile), with exact percentiles."""
    stats = _wide_percentiles(df, cols, {"lo": low, "mid": 0.5, "hi": high}).select(F.struct("lo", "mid", "hi").alias("s"))
    out = df.withColumn("_s", stats.scalar())

    def scaled(c: str) -> Column:
        width = F.col(f"_s.hi.{c}") - F.col(f"_s.lo.{c}")
        return (F.col(c) - F.col(f"_s.mid.{c}")) / F.when(width == 0, F.lit(1.0)).otherwise(width)

    return out.withColumns({c: scaled(c) for c in cols}).drop("_s")


def balance(df: DataFrame, label: str, ids: Sequence[str], replace: bool = True, seed: int = 0) -> DataFrame:
    """All positive rows and as many negative ones.

    Without replacement the negatives pass a hash threshold. With replacement each positive
    row makes one draw: a hash of it picks a dense number among the negatives, and an
    equi-join on that number fetches the row, so no draw list passes through the driver.
    """
    sick, healthy = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    if not replace:
        n_sick = sick.agg(F.count("*").alias("n")).scalar()
        return sick.unionByName(hash_sample(healthy, ids, n_sick, seed))
    n_healthy = healthy.agg(F.count("*").alias("n")).scalar()
    draws = sick.select((hash_number(stable_hash(*ids, seed=seed)) % n_healthy + 1).alias("_i"))
    picked = dense_index(healthy, ids, "_i", seed=seed).join(draws, "_i").drop("_i")
    return sick.unionByName(picked.select(*df.columns))


def balance_within(df: DataFrame, label: str, ids: Sequence[str], by: Sequence[str], seed: int = 0) -> DataFrame:
    """Per group: all positive rows and as many negatives, drawn without replacement."""
    n_sick = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_n"))
    ranked = dense_index(df.where(F.col(label) == 0), ids, "_r", by=by, seed=seed)
    kept = ranked.join(n_sick, list(by)).where(F.col("_r") <= F.col("_n")).select(*df.columns)
    return df.where(F.col(label) == 1).unionByName(kept)


def disjoint_halves(df: DataFrame, ids: Sequence[str], size: Column, seed: int = 0) -> DataFrame:
    """Two disjoint random samples of ``size`` rows each, marked in column ``half`` (0 or 1)."""
    ranked = dense_index(df, ids, "_r", seed=seed)
    return ranked.where(F.col("_r") <= 2 * size).withColumn("half", (F.col("_r") > size).cast("int")).drop("_r")
