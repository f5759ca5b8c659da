"""Evaluation of scored rows: curves, areas, recall at precision, confusion and cluster tables.

Rows are reduced to counts per distinct score first; curves come from distributed running
totals over the distinct scores, and areas need no ordering at all because each curve
point carries its own step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.ranking import running_totals, top_by_score

GRID_POINTS = 100


def top_metrics(df: DataFrame, score: str, label: str, row_id: str, ratio: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_top, precision, recall, f1) in percent among the top share of rows by score (of each group).

    A row counts as predicted positive above 0.5; recall is over the positives in the top
    only. The share is rounded half to even.
    """
    by = list(by)
    top = top_by_score(df, score, row_id, F.bround(F.col("n_rows") * F.lit(float(ratio)), 0), by)
    sums = top.groupBy(*by).agg(
        F.count("*").alias("n_top"),
        F.count_if((F.col(score) > 0.5) & (F.col(label) == 1)).alias("tp"),
        F.count_if(F.col(score) > 0.5).alias("predicted"),
        F.count_if(F.col(label) == 1).alias("positive"),
    )

    def share(num: Column, den: Column) -> Column:
        return F.when(den > 0, 100.0 * num / den).otherwise(F.lit(0.0))

    return sums.select(
        *by, "n_top",
        share(F.col("tp"), F.col("predicted")).alias("precision"),
        share(F.col("tp"), F.col("positive")).alias("recall"),
        share(2.0 * F.col("tp"), F.col("predicted") + F.col("positive")).alias("f1"),
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, in percent rounded to 3 digits."""
    cells = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    # each cell counts towards its true class and towards its predicted class
    sides = F.explode(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col(prediction).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    ))
    tp = F.when((F.col("s.class") == F.col(label)) & (F.col(label) == F.col(prediction)), F.col("s.support")).otherwise(0)
    sums = cells.withColumn("s", sides).groupBy(F.col("s.class").alias("class")).agg(
        F.sum(tp).alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted")
    )

    def pct(num: Column, den: Column) -> Column:
        return F.when(den > 0, F.round(100.0 * num / den, 3)).otherwise(F.lit(0.0))

    return sums.select(
        "class",
        pct(F.col("tp"), F.col("predicted")).alias("precision"),
        pct(F.col("tp"), F.col("support")).alias("recall"),
        pct(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, p, n): positives and negatives at each distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    )


def cumulative_hits(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with true and false positives at or above them (``tp``, ``fp``),
    their own counts (``p``, ``n``) and the class totals (``pos``, ``neg``)."""
    by = list(by)
    run = running_totals(score_counts(df, score, label, by), "score", ["p", "n"], by=by, descending=True, totals=True)
    return run.withColumnsRenamed({"cum_p": "tp", "cum_n": "fp", "all_p": "pos", "all_n": "neg"})


def precision_recall_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, precision, recall): one point per distinct score, plus the end point
    (recall 0, precision 1) with a NULL threshold."""
    by = list(by)
    hits = cumulative_hits(df, score, label, by)
    points = hits.select(
        *by, F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(F.lit(1.0)).alias("recall"),
    )
    ends = score_counts(df, score, label, by).groupBy(*by).agg(F.lit(None).cast("double").alias("threshold"))
    ends = ends.select(*by, "threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def _steps(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Curve points with the previous point's precision and recall on the same row."""
    tp0, fp0 = F.col("tp") - F.col("p"), F.col("fp") - F.col("n")
    return cumulative_hits(df, score, label, by).select(
        *by,
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "pos").alias("recall"),
        F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0)).alias("precision0"),
        F.try_divide(tp0, F.col("pos")).alias("recall0"),
    )


def pr_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): trapezoid area under the precision-recall curve; NULL without positives."""
    area = (F.col("recall") - F.col("recall0")) * (F.col("precision") + F.col("precision0")) / 2
    return _steps(df, score, label, by).groupBy(*by).agg(F.sum(area).alias("auc"))


def partial_pr_auc(df: DataFrame, score: str, label: str, min_precision: float = 0.7, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): area of the curve's segments whose both ends lie above a precision; 0 without positives."""
    area = (F.col("recall") - F.col("recall0")) * (F.col("precision") + F.col("precision0")) / 2
    inside = (F.col("precision") > min_precision) & (F.col("precision0") > min_precision)
    return _steps(df, score, label, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(inside, area)), F.lit(0.0)).alias("auc")
    )


def recall_at_precision(df: DataFrame, score: str, label: str, levels: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., level, recall, threshold): highest recall whose precision reaches each level.

    Among points of equal recall the lowest threshold; recall 0 and cut-off 1 when only the
    end point qualifies.
    """
    by = list(by)
    points = cumulative_hits(df, score, label, by).select(
        *by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "pos").alias("recall")
    )
    best = points.groupBy(*by).agg(*[
        F.max(F.when((F.col("precision") >= level) & F.col("recall").isNotNull(), F.struct("recall", (-F.col("score")).alias("t")))).alias(f"l{k}")
        for k, level in enumerate(levels)
    ])
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(float(level)).alias("level"), F.coalesce(F.col(f"l{k}.recall"), F.lit(0.0)).alias("recall"),
            F.coalesce(-F.col(f"l{k}.t"), F.lit(1.0)).alias("threshold"),
        )
        for k, level in enumerate(levels)
    ]))
    return best.select(*by, rows.alias("r")).select(*by, "r.*")


def fold_report(df: DataFrame, score: str, label: str, fold: str, levels: Sequence[float]) -> DataFrame:
    """(level, recall, threshold, auc): averages over folds, with the area of the pooled scores."""
    each = recall_at_precision(df, score, label, levels, by=[fold])
    means = each.groupBy("level").agg(F.avg("recall").alias("recall"), F.avg("threshold").alias("threshold"))
    return means.withColumn("auc", pr_auc(df, score, label).scalar())


def auc_over_folds(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """(mean_auc, std_auc): precision-recall area per fold, averaged (population deviation)."""
    return pr_auc(df, score, label, by=[fold]).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def roc_points(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, fpr, tpr): one point per distinct score (the origin is implied). A rate of a
    class without rows is NULL."""
    return cumulative_hits(df, score, label, by).select(
        *by, F.col("score").alias("threshold"), F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr")
    )


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): area under the ROC curve; NULL if a class has no rows."""
    by = list(by)
    hits = cumulative_hits(df, score, label, by)
    area = F.try_divide("n", "neg") * F.try_divide(2 * F.col("tp") - F.col("p"), F.col("pos")) / 2
    return hits.groupBy(*by).agg(F.sum(area).alias("auc"))


def mean_roc(df: DataFrame, score: str, label: str, fold: str, points: int = GRID_POINTS) -> DataFrame:
    """(fpr, mean_tpr, std_tpr, low, high): fold curves interpolated on an even grid.

    A curve segment knows which grid points fall into it, so it emits them itself: at most
    ``points`` rows per fold, and no range join.
    """
    last = points - 1
    hits = cumulative_hits(df.select(F.col(fold).alias("_fold"), F.col(score).alias("_score"), F.col(label).alias("_label")), "_score", "_label", ["_fold"])
    hits, fold = hits.where("pos > 0 AND neg > 0"), "_fold"  # a fold without one of the classes has no curve
    n, neg, fp0 = F.col("n"), F.col("neg"), F.col("fp") - F.col("n")
    start = F.expr(f"({last} * (fp - n) + neg - 1) div neg")
    stop = F.expr(f"({last} * fp + neg - 1) div neg") - 1
    inner = hits.where((n > 0) & (start <= stop)).select(
        fold, F.explode(F.sequence(start, stop)).alias("g"), fp0.alias("fp0"), "n", "neg", "p", "tp", "pos"
    )
    along = (F.col("g") * neg / F.lit(float(last)) - F.col("fp0")) / n
    tpr = (F.col("tp") - F.col("p") + along * F.col("p")) / F.col("pos")
    curve = inner.select("g", F.when(F.col("g") == 0, F.lit(0.0)).otherwise(tpr).alias("tpr"))
    ends = hits.select(fold).distinct().select(F.lit(last).cast("long").alias("g"), F.lit(1.0).alias("tpr"))
    stats = curve.unionByName(ends).groupBy("g").agg(F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"))
    return stats.select(
        (F.col("g") / F.lit(float(last))).alias("fpr"), "mean_tpr", "std_tpr",
        F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)).alias("low"),
        F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)).alias("high"),
    )


def cluster_table(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(cluster, label, description, n, label_pct, cluster_pct) of a two-cluster result.

    The cluster with the larger positive share is 'sick' (cluster 0 on a tie).
    """
    cells = df.groupBy(F.col(cluster).alias("c"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    shares = cells.groupBy("c").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("s"), F.sum("n").alias("in_cluster"))
    sick = shares.agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("c")).scalar()
    by_label = cells.groupBy("y").agg(F.sum("n").alias("in_label"))
    named = cells.join(shares, "c").join(by_label, "y").withColumn("kind", F.when(F.col("c") == sick, "sick").otherwise("healthy"))
    description = (
        F.when((F.col("kind") == "sick") & (F.col("y") == 1), "True positives")
        .when(F.col("kind") == "sick", "False positives")
        .when(F.col("y") == 1, "False negatives").otherwise("True negatives")
    )
    return named.select(
        F.col("kind").alias("cluster"), F.col("y").alias("label"), description.alias("description"), "n",
        (100.0 * F.col("n") / F.col("in_label")).alias("label_pct"), (100.0 * F.col("n") / F.col("in_cluster")).alias("cluster_pct"),
    )


def cluster_scores(table: DataFrame) -> DataFrame:
    """(precision, recall) in percent, rounded to 3 digits, from ``cluster_table``."""
    def count(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("description") == name, F.col("n"))), F.lit(0))

    sums = table.agg(
        count("True positives").alias("tp"), count("False positives").alias("fp"), count("False negatives").alias("fn")
    )
    tp = 100.0 * F.col("tp")
    return sums.select(
        F.when(F.col("tp") + F.col("fp") > 0, F.round(tp / (F.col("tp") + F.col("fp")), 3)).alias("precision"),
        F.when(F.col("tp") + F.col("fn") > 0, F.round(tp / (F.col("tp") + F.col("fn")), 3)).alias("recall"),
    )
