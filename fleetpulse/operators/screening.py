"""Column screening: near-zero variance, pair correlations and their groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ranking import average_ranks, value_counts
from fleetpulse.session import staged

MOMENT_SLOTS = 256


def near_zero_variance(
    df: DataFrame, cols: Sequence[str], freq_cut: float = 99.0, ratio_cut: float = 19.0, unique_cut: float = 10.0
) -> DataFrame:
    """(column, top_pct, ratio, unique_pct, flagged) for every column.

    Flagged when the commonest value's share reaches ``freq_cut``, or when it outweighs the
    second by ``ratio_cut`` and distinct values are at most ``unique_cut`` percent. A constant
    column has no second value and is flagged.
    """
    counts = value_counts(df, cols)
    # how many values occur n times: about sqrt(2 * rows) rows per column, so the window is small
    tally = counts.groupBy("column", "n").agg(F.count("*").alias("m"))
    best = W.partitionBy("column").orderBy(F.col("n").desc())
    ranked = tally.withColumns({"r": F.row_number().over(best), "next": F.lead("n").over(best)})
    second = F.when(F.col("m") > 1, F.col("n")).otherwise(F.col("next"))
    top = ranked.where("r = 1").select("column", F.col("n").alias("first"), second.alias("second"))
    size = tally.groupBy("column").agg(F.sum("m").alias("values"), F.sum(F.col("n") * F.col("m")).alias("total"))
    out = top.join(size, "column").select(
        "column",
        (100.0 * F.col("first") / F.col("total")).alias("top_pct"),
        (F.col("first") / F.col("second")).alias("ratio"),
        (100.0 * F.col("values") / F.col("total")).alias("unique_pct"),
    )
    skewed = F.coalesce((F.col("ratio") >= ratio_cut) & (F.col("unique_pct") <= unique_cut), F.lit(False))
    return out.withColumn("flagged", (F.col("top_pct") >= freq_cut) | F.col("ratio").isNull() | skewed)


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every column pair i < j over rows where both are known.

    Columns are centred on their overall mean first, so the sums do not cancel. Each task
    multiplies its batches into d x d matrices and emits them once, packed as one row per matrix
    row; those are added up over ``MOMENT_SLOTS`` groups of tasks, then over the groups, and only
    the d * (d - 1) / 2 totals become rows of their own. What is shuffled depends on the number of
    columns and tasks, not on rows.
    """
    cols = list(cols)
    d = len(cols)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = wide.agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in cols]).alias("m"))
    centred = wide.withColumn("_m", means.scalar()).select(
        (F.spark_partition_id() % MOMENT_SLOTS).alias("_slot"),
        *[(F.col(c) - F.col("_m")[k]).alias(f"c{k}") for k, c in enumerate(cols)]
    )

    def packed(slot: int, parts: Sequence[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)  # row i: counts, sums, squares and products of column i with each j
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, slot), pa.int32()), pa.array(np.arange(d), pa.int32()), flat], names=["slot", "i", "v"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((d, d)) for _ in range(4)]
        slot = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(0)[0].as_py()
            x = np.column_stack([
                np.asarray(batch.column(k + 1).to_numpy(zero_copy_only=False), dtype=float) for k in range(d)
            ])
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            parts[0] += known.T @ known
            parts[1] += x.T @ known
            parts[2] += (x * x).T @ known
            parts[3] += x.T @ x
        yield packed(slot, parts)

    def added(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py()], pa.int32()),
                         "i": pa.array([table.column("i")[0].as_py()], pa.int32()), "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "slot int, i int, v array<double>"
    parts = centred.mapInArrow(sums, schema).groupBy("slot", "i").applyInArrow(added, schema)
    rows = parts.groupBy("i").applyInArrow(added, schema).select("i", "v")
    at = lambda block, j: F.get("v", j + block * d)
    # (i, j) holds the sums of column i where j is known, (j, i) those of column j
    cell = rows.select("i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(
        j.alias("j"), at(0, j).alias("n"), at(1, j).alias("s"), at(2, j).alias("q"), at(3, j).alias("xy")))).alias("c")).select("i", "c.*")
    upper = cell.where("i < j").select("i", "j", "n", F.col("s").alias("sx"), F.col("q").alias("sxx"), F.col("xy").alias("sxy"))
    lower = cell.where("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("sy"), F.col("q").alias("syy"))
    return upper.join(lower, ["i", "j"]).select("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy")


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, corr): Pearson correlation of every column pair over rows where both are known.

    NULL where a column is constant there, or where no row knows both.
    """
    m = pair_moments(df, cols)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    over = lambda x: F.try_divide(x, n)  # noqa: E731  NULL for columns that are never known together
    vx, vy = F.col("sxx") - over(sx * sx), F.col("syy") - over(sy * sy)
    cov = F.col("sxy") - over(sx * sy)
    # a constant column leaves only rounding noise in its variance
    flat = (vx <= 1e-12 * F.col("sxx")) | (vy <= 1e-12 * F.col("syy")) | (vx <= 0) | (vy <= 0)
    names = F.array(*[F.lit(c) for c in cols])
    return m.select(
        names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), n.cast("long").alias("n"),
        F.when(~flat, F.try_divide(cov, F.sqrt(vx * vy))).alias("corr"),
    )


def null_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of the missing-value flags of every column pair."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in cols])
    return pair_correlations(flags, cols)


def _identity_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict[tuple[str, str], bool]:
    if not pairs:
        return {}
    same = [F.min(F.coalesce(F.col(a) == F.col(b), F.lit(False))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]
    row = df.agg(*same).first()
    return {p: bool(row[f"p{k}"]) for k, p in enumerate(pairs)}


def strong_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """(a, b, corr, identical): pairs with absolute correlation above the threshold.

    ``identical`` is checked only where one name contains the other. The pair list is bounded
    by the number of columns squared, so it may visit the driver; all rows stay in Spark.
    """
    rows = pair_correlations(df, cols).where(F.abs("corr") > threshold).select("a", "b", "corr").collect()
    nested = [(r.a, r.b) for r in rows if r.a in r.b or r.b in r.a]
    same = _identity_counts(df, nested)
    data = [(r.a, r.b, r.corr, same.get((r.a, r.b), False)) for r in rows]
    return df.sparkSession.createDataFrame(data, "a string, b string, corr double, identical boolean")


def group_pairs(pairs: DataFrame) -> DataFrame:
    """(kind, head, member): every column of a strong pair under the head it can be replaced by.

    The head of a column is the smallest name among its partners of the same kind; columns that
    have no smaller partner are heads themselves and are not listed as members.
    """
    kind = F.when(F.col("identical"), "identical").otherwise("correlated")
    ends = F.explode(F.array(F.struct(F.col("a").alias("member"), F.col("b").alias("head")), F.struct(F.col("b").alias("member"), F.col("a").alias("head"))))
    sides = pairs.select(kind.alias("kind"), ends.alias("e")).select("kind", "e.*")
    return sides.groupBy("kind", "member").agg(F.min("head").alias("head")).where("head < member").select("kind", "head", "member")


def identical_to_drop(pairs: DataFrame) -> DataFrame:
    """The longer-named column of each identical pair (on equal length the later name)."""
    longer = F.when(F.length("a") > F.length("b"), F.col("a")).when(
        F.length("b") > F.length("a"), F.col("b")
    ).otherwise(F.greatest("a", "b"))
    return pairs.where("identical").select(longer.alias("column")).distinct()


def rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, pearson, spearman) of the listed column pairs over rows where both are known.

    Rows are first counted per (pair, x, y); ranks come from distributed running counts. A constant
    column has no correlation (NULL).
    """
    entries = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for k, (a, b) in enumerate(pairs)
    ])
    cells = (
        df.select(F.explode(entries).alias("e")).select("e.*").dropna()
        .groupBy("k", "x", "y").agg(F.count("*").alias("w"))
    )
    cells = staged(cells, "cells")

    def ranks(v: str) -> DataFrame:
        counts = cells.groupBy("k", F.col(v).alias("value")).agg(F.sum("w").alias("n"))
        return average_ranks(counts, ["k"]).select("k", F.col("value").alias(v), F.col("rank").alias(f"r{v}"))

    both = cells.join(ranks("x"), ["k", "x"]).join(ranks("y"), ["k", "y"])

    # weighted centring first, then the correlation of the centred values; mean ranks of n rows average (n + 1) / 2
    n = F.sum("w")
    mean = cells.groupBy("k").agg(
        *[(F.sum(F.col("w") * F.col(v)) / n).alias(f"m_{v}") for v in ["x", "y"]],
        *[((n + 1) / 2).alias(f"m_{v}") for v in ["rx", "ry"]],
    )

    def corr(a: str, b: str):
        p, q = F.col(a) - F.col(f"m_{a}"), F.col(b) - F.col(f"m_{b}")
        return F.try_divide(F.sum(F.col("w") * p * q), F.sqrt(F.sum(F.col("w") * p * p) * F.sum(F.col("w") * q * q)))

    left, right = F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[F.lit(b) for _, b in pairs])
    # a row a pair, broadcast: a join by pair would send all cells of a pair to one task
    out = both.join(F.broadcast(mean), "k").groupBy("k").agg(corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"))
    return out.select(left[F.col("k")].alias("a"), right[F.col("k")].alias("b"), "pearson", "spearman")


def key_correlations(df: DataFrame, key: str, candidates: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """(suffix, candidate, pearson, spearman) of a key measure with each candidate, per time suffix.

    Columns are named ``<measure>_<suffix>``; measures without a column for a suffix are left out.
    """
    have = set(df.columns)
    listed = [(f"{key}_{s}", f"{c}_{s}", s, c) for s in suffixes for c in candidates if c != key and {f"{key}_{s}", f"{c}_{s}"} <= have]
    names = df.sparkSession.createDataFrame([(a, b, s, c) for a, b, s, c in listed], "a string, b string, suffix string, candidate string")
    return rank_correlations(df, [(a, b) for a, b, _, _ in listed]).join(names, ["a", "b"]).select("suffix", "candidate", "pearson", "spearman")
