"""Fitted models: rows-only queries, since another engine would fit other models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.catalog.inputs import DAY, Inputs
from fleetpulse.catalog.registry import query
from fleetpulse.functions.scalars import binary_label
from fleetpulse.operators import folds as FD
from fleetpulse.operators import models as M
from fleetpulse.operators import pairs as PR
from fleetpulse.operators.evaluate import precision_recall_points
from fleetpulse.operators.stats import ks_two_sample
from fleetpulse.session import new_table_path, staged
from fleetpulse.sources.sinks import overwrite

FEATURES = [*S.DEVICE_DAILY, "offline_pct"]
IDS = ["seq_id"]


def days(t: Inputs) -> DataFrame:
    """Labelled device days, written once per query since fits read them repeatedly."""
    rows = t.device_day.withColumn("label", binary_label("milestone_name").cast("double"))
    return staged(rows.select("seq_id", "mac", "day_0", "label", *FEATURES), "device-days")


def halves(t: Inputs) -> tuple[DataFrame, DataFrame]:
    d = days(t)
    early = F.col("day_0") < F.lit(DAY)
    return d.where(early), d.where(~early)


def stages(**kwargs) -> list:
    return M.feature_stages(FEATURES, **kwargs)


def forest(trees: int = 100) -> M.Plain:
    return M.Plain([*stages(scale=False), M.random_forest(trees, max_depth=10)])


def boosting(learning_rate: float = 0.1, trees: int = 50, max_depth: int = 3) -> M.Plain:
    return M.Plain([*stages(scale=False), M.gradient_boosting(learning_rate, trees, max_depth)])


# --- fixed values: the tuning grid of gradient boosting ----------------------------------------
LEARNING_RATES = [0.05, 0.1125, 0.175, 0.2375, 0.3]
ROUNDS = [20, 28, 37, 46, 55, 64, 73, 82, 91, 100]
# ---------------------------------------------------------------------------------------------


def boosted(learning_rate: float) -> M.Boosted:
    """One fit for all of ``ROUNDS``."""
    return M.Boosted([*stages(scale=False), M.gradient_boosting(learning_rate, max(ROUNDS), 3)], ROUNDS)


def logistic(c: float = 1.0) -> M.Plain:
    return M.Plain([*stages(), M.logistic(c)])


def stacked(c: float = 1.0) -> M.Stacked:
    return M.stacked_logistic(FEATURES, c)


def outcome(scores: DataFrame) -> DataFrame:
    return scores.select("seq_id", "day_0", "label", "score")


@query("ml1_scaled_features")
def _(t: Inputs) -> DataFrame:
    d = days(t)
    fitted = M.Pipeline(stages=stages(components=4)).fit(d)
    return fitted.transform(d).select("seq_id", "day_0", "features")


@query("ml1_logistic_on_variance_share")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(M.Plain([*stages(components=0.7), M.logistic(1.0)]).fit(train).score(test))


@query("ml1_logistic_on_discriminant")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(M.Plain([*stages(discriminant=True), M.logistic(1.0)]).fit(train).score(test))


@query("ml2_explained_variance")
def _(t: Inputs) -> DataFrame:
    d = days(t)
    scaled = M.Pipeline(stages=stages()).fit(d).transform(d)
    return M.variance_table(scaled, "features")[1]


@query("ml2_projected_to_variance_share")
def _(t: Inputs) -> DataFrame:
    d = days(t)
    scaled = M.Pipeline(stages=stages()).fit(d).transform(d)
    model, table = M.variance_table(scaled, "features")
    k = M.components_for(table, 0.7)
    return M.project(scaled, model, "features", k).select("seq_id", "pca", F.lit(k).alias("components"))


@query("ml3_linear_discriminant")
def _(t: Inputs) -> DataFrame:
    return M.discriminant(t.clustered, "v", "label").select("id", "label", "lda")


@query("ml4_random_forest")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(forest().fit(train).score(test))


@query("ml5_gradient_boosting")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(boosting().fit(train).score(test))


@query("ml6_logistic_regression")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(logistic().fit(train).score(test))


@query("ml7_calibrated_linear_svm")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    model = M.Calibrated([*stages(), M.sparse_svm(1.0)], IDS)
    return outcome(model.fit(train).score(test))


@query("ml8_calibrated_ridge")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    model = M.Calibrated([*stages(), M.ridge(1.0)], IDS)
    return outcome(model.fit(train).score(test))


@query("ml9_out_of_fold_calibration")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    fitted = M.Calibrated([*stages(), M.ridge(10.0)], IDS).fit(train)
    raw = M.scored(fitted.model, test, "margin").select("seq_id", "margin")
    return raw.join(fitted.score(test).select("seq_id", "label", "score"), "seq_id")


@query("ml11_feature_importances")
def _(t: Inputs) -> DataFrame:
    d = days(t)
    return M.importances(forest().fit(d).model, FEATURES, d)


@query("srt4_top_importances")
def _(t: Inputs) -> DataFrame:
    d = days(t)
    table = M.importances(forest().fit(d).model, FEATURES, d)
    zero = M.unused_features(table).scalar()
    return M.top_importances(table).withColumn("n_zero", zero)


@query("ml12_newest_days_scored")
def _(t: Inputs) -> DataFrame:
    train, rest = halves(t)
    unseen = FD.unseen_days(rest, train)
    return outcome(boosting().fit(train).score(FD.latest_day(unseen)))


@query("flt10_probability_cut")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return outcome(boosting().fit(train).score(test)).where(F.col("score") >= 0.45)


@query("snk8_saved_model")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    model = logistic().fit(train)
    path = new_table_path(t.spark, "model")
    M.save_model(model.model, path)
    again = M.Plain([], M.load_model(path)).score(test, "again").select("seq_id", "again")
    return outcome(model.score(test)).join(again, "seq_id").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("score") - F.col("again"))).alias("largest_change")
    )


# ---- what must hold whatever the fit: rows, labels, ranges and totals -----------------------

_TEST_ROWS = f"""SELECT count(*) AS n, count(milestone_name) AS positives, true AS in_range
 FROM device_day WHERE day_0 >= DATE '{DAY}'"""


def in_range(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"),
        ((F.min("score") >= 0) & (F.max("score") <= 1)).alias("in_range"),
    )


@query("ml2_variance_checks", f"SELECT CAST({len(FEATURES)} AS BIGINT) AS components, 1.0::DOUBLE AS total, true AS falling", ["total"])
def _(t: Inputs) -> DataFrame:
    d = days(t)
    table = M.variance_table(M.Pipeline(stages=stages()).fit(d).transform(d), "features")[1]
    following = table.select((F.col("component") - 1).alias("component"), F.col("share").alias("next"))
    pairs = table.join(following, "component", "left")
    return pairs.agg(
        F.count("*").alias("components"), F.sum("share").alias("total"),
        F.min(F.coalesce(F.col("share") >= F.col("next") - 1e-9, F.lit(True))).alias("falling"),
    )


@query("ml3_discriminant_checks", "SELECT count(*) AS n, 1.0::DOUBLE AS within_variance FROM clustered", ["within_variance"])
def _(t: Inputs) -> DataFrame:
    # the axis is scaled to a pooled within-class variance of one
    out = M.discriminant(t.clustered, "v", "label")
    each = out.groupBy("label").agg(F.count("*").alias("n"), F.var_samp("lda").alias("v"))
    return each.agg(F.sum("n").alias("n"), (F.sum(F.col("v") * (F.col("n") - 1)) / (F.sum("n") - 2)).alias("within_variance"))


@query("ml4_forest_checks", _TEST_ROWS)
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return in_range(outcome(forest().fit(train).score(test)))


@query("ml6_logistic_checks", _TEST_ROWS)
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return in_range(outcome(logistic().fit(train).score(test)))


@query("ml8_calibration_checks", _TEST_ROWS)
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    return in_range(outcome(M.Calibrated([*stages(), M.ridge(1.0)], IDS).fit(train).score(test)))


@query("ml11_importance_checks", f"SELECT CAST({len(FEATURES)} AS BIGINT) AS features, 1.0::DOUBLE AS total, CAST(0 AS BIGINT) AS negative", ["total"])
def _(t: Inputs) -> DataFrame:
    d = days(t)
    table = M.importances(forest().fit(d).model, FEATURES, d)
    return table.agg(F.count("*").alias("features"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


@query("cl1_cluster_checks", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS clusters FROM clustered")
def _(t: Inputs) -> DataFrame:
    points = t.clustered.drop("cluster")
    return M.clustered(M.k_means(points, "v", 2), points, "v").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


MODELS = {
    "logistic": stacked,
    "linear_svm": lambda: M.stacked_svm(FEATURES, IDS),
    "ridge": lambda: M.stacked_ridge(FEATURES, IDS),
    "forest": forest,
}
C_GRID = [float(10.0**k) for k in range(-5, 3)]


def splits(t: Inputs, k: int = 5) -> DataFrame:
    return FD.day_splits(days(t), "label", IDS, k=k)


@query("cv3_top_share_over_folds")
def _(t: Inputs) -> DataFrame:
    return M.top_metrics_cv(M.fold_scores(splits(t), stacked), "seq_id", 0.2)


@query("cv3_top_share_over_plain_folds")
def _(t: Inputs) -> DataFrame:
    return M.top_metrics_cv(M.fold_scores(M.plain_splits(days(t), "seq_id"), stacked), "seq_id", 0.2)


@query("cv9_best_of_models")
def _(t: Inputs) -> DataFrame:
    return M.compare_roc(days(t), MODELS, IDS, "seq_id")


@query("cv5_grid_search")
def _(t: Inputs) -> DataFrame:
    return M.grid_search(days(t), stacked, {"c": C_GRID}, IDS, k=5)


@query("snk10_stored_grid_results")
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "grid")
    overwrite(M.boosting_search(days(t), boosted, {"learning_rate": [LEARNING_RATES[0], LEARNING_RATES[-1]]}, IDS, k=5), path)
    return t.spark.read.parquet(path)


@query("cv6_hold_out_metrics")
def _(t: Inputs) -> DataFrame:
    return M.hold_out_metrics(days(t), logistic, IDS, 3, 5)


@query("cv7_gap_study")
def _(t: Inputs) -> DataFrame:
    # all gaps of a window are scored with its one fit
    return M.gap_study(days(t), stacked, [0, 2, 20], ratio_testing=0.25)


@query("cv8_weekday_study")
def _(t: Inputs) -> DataFrame:
    return M.weekday_study(days(t), stacked, IDS)


@query("cv9_compared_models")
def _(t: Inputs) -> DataFrame:
    return M.compare_models(days(t), MODELS, IDS, [0.4, 0.5, 0.6])


@query("cv9_pooled_curves")
def _(t: Inputs) -> DataFrame:
    scores = M.fold_scores(splits(t), stacked)
    return precision_recall_points(scores, "score", "label", ["split"])


@query("cl1_k_means")
def _(t: Inputs) -> DataFrame:
    return M.clustered(M.k_means(t.clustered, "v", 2), t.clustered.drop("cluster"), "v").select("id", "label", "cluster")


@query("cl3_silhouette_by_k")
def _(t: Inputs) -> DataFrame:
    return M.silhouette_by_k(t.clustered.drop("cluster"), "id", "v", [2, 3, 4])


@query("cl4_inertia_by_k")
def _(t: Inputs) -> DataFrame:
    return M.silhouette_by_k(t.clustered.drop("cluster"), "id", "v", [2, 3, 4, 5, 6]).select("k", "sse", "silhouette")


@query("cl5_silhouette_by_variance_share")
def _(t: Inputs) -> DataFrame:
    return M.silhouette_by_variance(t.clustered.drop("cluster"), "id", "v", [0.3, 0.7, 0.95], [2, 3, 4])


@query("st15_mahalanobis_to_centres")
def _(t: Inputs) -> DataFrame:
    moments = M.class_moments(t.clustered, "v", "cluster")
    precision = np.linalg.pinv(M.pooled_covariance(moments))
    centres = PR.centres_of(t.clustered, "v", "cluster")
    return PR.distances_to_centres(t.clustered, "v", centres, precision).select("id", "cluster", "centre_id", "mahalanobis")


@query("st5_score_shift_between_halves")
def _(t: Inputs) -> DataFrame:
    train, test = halves(t)
    scores = logistic().fit(train).score(train.unionByName(test)).withColumn("late", (F.col("day_0") >= F.lit(DAY)).cast("int"))
    return ks_two_sample(scores, "late", 1, ["score"])
