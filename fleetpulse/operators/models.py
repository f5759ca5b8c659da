"""Models: feature stages, classifiers, calibration, cross-validation, projection, clustering.

Fitting is Spark ML's distributed fitting; what reaches the driver is model-sized (d x d
matrices, k centres, fold metrics). Scored rows stay DataFrames and are evaluated with the
operators of ``evaluate``.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Imputer, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import stable_hash
from fleetpulse.operators.evaluate import pr_auc, recall_at_precision, roc_auc, top_metrics
from fleetpulse.operators.folds import contiguous_folds, day_splits, gap_hold_out, gap_schedule
from fleetpulse.operators.pairs import silhouettes_of
from fleetpulse.operators.prep import balance
from fleetpulse.operators.stacked import Setting, Stacked, margin_weights, packed_sums, sliding_ridge
from fleetpulse.session import new_table_path, staged

LABEL = "label"
SEED = 42


# ---- feature stages and classifiers ---------------------------------------------------------


class _Stored(DefaultParamsReadable, DefaultParamsWritable):
    """A stage written in Python that is saved and loaded with its parameters, inside a pipeline or alone."""

    def _with(self, **values: object) -> _Stored:
        return self._set(**{k: v for k, v in values.items() if v is not None})


class VariancePCA(Estimator, HasInputCol, HasOutputCol, _Stored):
    """Projection on as few components as explain a share of the variance."""

    share = Param(Params._dummy(), "share", "share of the variance", TypeConverters.toFloat)

    def __init__(self, share: float | None = None, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._with(share=share, inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> ProjectionModel:
        first = dataset.select(F.array_size(vector_to_array(self.getInputCol()))).first()
        full = PCA(k=first[0], inputCol=self.getInputCol(), outputCol=self.getOutputCol()).fit(dataset)
        k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), self.getOrDefault("share") - 1e-12)) + 1
        return ProjectionModel(full.pc.toArray()[:, :k].T, self.getInputCol(), self.getOutputCol())


class Discriminant(Estimator, HasInputCol, HasOutputCol, _Stored):
    """Projection on the axis of the two-class linear discriminant, a vector of one number."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._with(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> ProjectionModel:
        arrays = dataset.select(vector_to_array(self.getInputCol()).alias("v"), F.col(LABEL).cast("int").alias("y"))
        return ProjectionModel(discriminant_axis(arrays, "v", "y")[None], self.getInputCol(), self.getOutputCol())


class ProjectionModel(Model, HasInputCol, HasOutputCol, _Stored):
    """Inner products of a vector with fitted axes, as a vector."""

    axes = Param(Params._dummy(), "axes", "axes one after the other", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "numbers of an axis", TypeConverters.toInt)

    def __init__(self, axes: np.ndarray | None = None, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        flat = None if axes is None else np.asarray(axes, float).reshape(-1).tolist()
        self._with(axes=flat, width=None if axes is None else int(axes.shape[1]), inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, flat = self.getOrDefault("width"), self.getOrDefault("axes")
        rows = [flat[k : k + d] for k in range(0, len(flat), d)]
        axes = dataset.sparkSession.createDataFrame([(rows,)], "w array<array<double>>").scalar()
        product = lambda axis: F.aggregate(F.zip_with("_v", axis, lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
        made = dataset.withColumn("_w", axes).withColumn("_v", vector_to_array(self.getInputCol()))
        return made.withColumn(self.getOutputCol(), array_to_vector(F.transform("_w", product))).drop("_w", "_v")


class SparseSVC(Estimator, HasFeaturesCol, HasLabelCol, _Stored):
    """Linear support vectors with squared hinge loss and an L1 penalty: ``c * losses + |w|``, without the intercept."""

    c = Param(Params._dummy(), "c", "inverse penalty summed over rows", TypeConverters.toFloat)

    def __init__(self, c: float | None = None, featuresCol: str = "features", labelCol: str = "label") -> None:
        super().__init__()
        self._with(c=c, featuresCol=featuresCol, labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> SparseSVCModel:
        vector, label = vector_to_array(self.getFeaturesCol()), F.col(self.getLabelCol())
        w = margin_weights(dataset, vector, label, Setting("hinge", l1=1.0 / self.getOrDefault("c")))
        return SparseSVCModel(w, self.getFeaturesCol())


class SparseSVCModel(Model, HasFeaturesCol, _Stored):
    """Fitted weights; the margin is ``rawPrediction[1]``."""

    weights = Param(Params._dummy(), "weights", "weights, intercept last", TypeConverters.toListFloat)

    def __init__(self, weights: np.ndarray | None = None, featuresCol: str = "features") -> None:
        super().__init__()
        self._with(weights=None if weights is None else [float(w) for w in weights], featuresCol=featuresCol)

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.getOrDefault("weights")[:-1])

    @property
    def intercept(self) -> float:
        return self.getOrDefault("weights")[-1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        *w, b = self.getOrDefault("weights")
        weights = dataset.sparkSession.createDataFrame([(list(w),)], "w array<double>").scalar()
        product = F.zip_with(vector_to_array(self.getFeaturesCol()), "_w", lambda x, k: x * k)
        margin = F.aggregate(product, F.lit(float(b)), lambda a, v: a + v)
        out = dataset.withColumn("_w", weights).withColumn("_m", margin)
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-F.col("_m"), F.col("_m"))), "prediction": (F.col("_m") > 0).cast("double")}).drop("_w", "_m")


def feature_stages(
    columns: Sequence[str], fill: str | None = "mean", scale: bool = True, components: int | float | None = None,
    discriminant: bool = False,
) -> list:
    """Imputation, assembly, scaling and projection as pipeline stages ending in ``features``.

    ``components`` is a number of principal components, or below 1 a share of the variance;
    ``discriminant`` projects on the discriminant axis instead.
    """
    stages: list = []
    names = list(columns)
    if fill is not None:
        filled = [f"{c}__filled" for c in names]
        stages.append(Imputer(strategy=fill, inputCols=names, outputCols=filled))
        names = filled
    projected = bool(components) or discriminant
    last = "assembled" if scale or projected else "features"
    stages.append(VectorAssembler(inputCols=names, outputCol=last, handleInvalid="keep"))
    if scale:
        out = "scaled" if projected else "features"
        stages.append(StandardScaler(inputCol=last, outputCol=out, withMean=True, withStd=True))
        last = out
    if discriminant:
        stages.append(Discriminant(last, "features"))
    elif components and components < 1:
        stages.append(VariancePCA(components, last, "features"))
    elif components:
        stages.append(PCA(k=int(components), inputCol=last, outputCol="features"))
    return stages


def random_forest(trees: int = 100, max_depth: int = 10, seed: int = SEED) -> RandomForestClassifier:
    """Rows keep the node they have reached in each tree, so a level does not send them down from the root."""
    return RandomForestClassifier(
        labelCol=LABEL, numTrees=trees, maxDepth=max_depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1
    )


def gradient_boosting(
    learning_rate: float = 0.1, trees: int = 100, max_depth: int = 3, min_split: int = 2, seed: int = SEED
) -> GBTClassifier:
    """``min_split`` rows needed to split a node become half as many per child."""
    return GBTClassifier(
        labelCol=LABEL, stepSize=learning_rate, maxIter=trees, maxDepth=max_depth,
        minInstancesPerNode=max(1, min_split // 2), seed=seed,
    )


@dataclass(frozen=True)
class Penalised:
    """A linear estimator whose penalty is summed over rows; Spark's is per row, so it is set by the
    number of training rows of each fit."""

    estimator: Estimator
    penalty: float

    def sized(self, n_rows: int) -> Estimator:
        return self.estimator.copy({self.estimator.regParam: self.penalty / max(n_rows, 1)})


def sized(stages: Sequence, df: DataFrame) -> list:
    """The stages with penalties for the rows of ``df``, which are counted if any stage needs it."""
    n = df.count() if any(isinstance(s, Penalised) for s in stages) else 0
    return [s.sized(n) if isinstance(s, Penalised) else s for s in stages]


def logistic(c: float, max_iter: int = 500) -> Penalised:
    """``c`` is the inverse penalty summed over rows."""
    return Penalised(LogisticRegression(labelCol=LABEL, maxIter=max_iter), 1.0 / c)


def linear_svm(c: float, max_iter: int = 100) -> Penalised:
    """Linear support vectors with an L2 penalty; give it probabilities with ``Calibrated``."""
    return Penalised(LinearSVC(labelCol=LABEL, maxIter=max_iter), 1.0 / c)


def sparse_svm(c: float) -> SparseSVC:
    """Linear support vectors with an L1 penalty, which leaves out columns; give it probabilities with ``Calibrated``."""
    return SparseSVC(c, labelCol=LABEL)


def stacked_logistic(columns: Sequence[str], c: float = 1.0) -> Stacked:
    """Scaled logistic regression that is fitted for all splits, and all values of a grid, at once."""
    return Stacked(columns, (Setting("logistic", l2=1.0 / c),))


def stacked_svm(columns: Sequence[str], ids: Sequence[str], c: float = 1.0) -> Stacked:
    """The same for calibrated linear support vectors with an L1 penalty."""
    return Stacked(columns, (Setting("hinge", l1=1.0 / c),), calibrated=True, ids=tuple(ids))


def stacked_ridge(columns: Sequence[str], ids: Sequence[str], alpha: float = 1.0) -> Stacked:
    """The same for a calibrated ridge classifier."""
    return Stacked(columns, (Setting("squares", l2=alpha),), calibrated=True, ids=tuple(ids))


def ridge(alpha: float) -> Penalised:
    """Ridge classifier: least squares on -1/+1 targets (column ``signed``)."""
    return Penalised(LinearRegression(labelCol="signed", elasticNetParam=0.0), alpha)


def with_signed_label(df: DataFrame) -> DataFrame:
    return df.withColumn("signed", 2.0 * F.col(LABEL) - 1.0)


def scored(model: Transformer, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the model's positive score: a probability if it has one, else its raw margin."""
    out = model.transform(with_signed_label(df))
    if "probability" in out.columns:
        value = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        value = vector_to_array("rawPrediction")[1]
    else:
        value = F.col("prediction")
    return out.select(*df.columns, value.alias(name))


def fitted(stages: Sequence, df: DataFrame) -> PipelineModel:
    """The fitted pipeline, without training summaries.

    A summary holds the session, and scoring sends a model to the tasks together with its summary; once any
    write of the session was observed (``sinks.counted``) the session can't be sent. A copy of a forest has no
    summary; a logistic model has none after it was stored and read.
    """
    model = Pipeline(stages=list(stages)).fit(df)
    for i, stage in enumerate(model.stages):
        if isinstance(stage, RandomForestClassificationModel):
            model.stages[i] = stage.copy()
        elif isinstance(stage, LogisticRegressionModel) and stage.hasSummary:
            path = new_table_path(df.sparkSession, "model")
            stage.write().save(path)
            model.stages[i] = LogisticRegressionModel.load(path)
    return model


@dataclass
class Calibrated:
    """A model whose margin is mapped to a probability by a sigmoid fitted out of fold."""

    stages: list
    ids: Sequence[str]
    folds: int = 3
    model: PipelineModel | None = None
    sigmoid: PipelineModel | None = None

    def fit(self, df: DataFrame) -> Calibrated:
        signed = with_signed_label(df)
        marked = signed.withColumn("_cf", F.conv(F.substring(stable_hash(*self.ids), 1, 6), 16, 10).cast("long") % self.folds)
        margins = None
        for f in range(self.folds):
            rest = marked.where(F.col("_cf") != f)
            part = fitted(sized(self.stages, rest), rest)
            one = scored(part, marked.where(F.col("_cf") == f), "margin").select(LABEL, "margin")
            margins = one if margins is None else margins.unionByName(one)
        platt = [
            VectorAssembler(inputCols=["margin"], outputCol="margin_vec"),
            LogisticRegression(labelCol=LABEL, featuresCol="margin_vec"),
        ]
        self.sigmoid = fitted(platt, margins)
        self.model = fitted(sized(self.stages, signed), signed)
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return scored(self.sigmoid, scored(self.model, df, "margin"), name).drop("margin")


@dataclass
class Plain:
    """Feature stages and a classifier, fitted and scored as they are."""

    stages: list
    model: PipelineModel | None = field(default=None)

    def fit(self, df: DataFrame) -> Plain:
        self.model = fitted(sized(self.stages, df), with_signed_label(df))
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return scored(self.model, df, name)


@dataclass
class Boosted:
    """Gradient boosting that is scored after several numbers of rounds.

    Boosting adds its trees one after the other, so the first m trees of a long fit are the model of m rounds:
    one fit serves every number of rounds, and each tree looks at a row once.
    """

    stages: list
    rounds: Sequence[int]
    model: PipelineModel | None = field(default=None)

    def fit(self, df: DataFrame) -> Boosted:
        *features, classifier = self.stages
        longest = classifier.copy({classifier.maxIter: max(self.rounds)})
        return replace(self, model=Pipeline(stages=[*features, longest]).fit(df))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """The rows once per number of rounds, with ``rounds`` and the probability after so many."""
        *features, boosted = self.model.stages
        out = PipelineModel(features).transform(df)
        for i, tree in enumerate(boosted.trees):
            out = tree.copy().setPredictionCol(f"_t{i}").transform(out)
        # weights and columns travel as one array; sums run over its first entries
        votes = F.array(*[F.col(f"_t{i}") * float(w) for i, w in enumerate(boosted.treeWeights)])
        margin = F.aggregate(F.slice("_votes", 1, F.col("rounds")), F.lit(0.0), lambda a, v: a + v)
        each = out.select(*df.columns, votes.alias("_votes"), F.explode(F.array(*[F.lit(int(m)) for m in self.rounds])).alias("rounds"))
        return each.select(*df.columns, "rounds", (1.0 / (1.0 + F.exp(-2.0 * margin))).alias(name))


Maker = Callable[[], Plain | Calibrated | Stacked]
PARALLEL = 4  # separate fits that share the cluster at a time
FIT_ROWS = 4_000_000  # training rows of separate fits that are held at a time, at least one fit's


def importances(model: PipelineModel, columns: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted tree model; as many rows as features."""
    values = model.stages[-1].featureImportances.toArray()
    data = [(c, float(v)) for c, v in zip(columns, values)]
    return df.sparkSession.createDataFrame(data, "feature string, importance double")


def top_importances(table: DataFrame, n: int = 4) -> DataFrame:
    """The n most important features (a top-k report)."""
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def unused_features(table: DataFrame) -> DataFrame:
    """(n_zero): features with no importance at all."""
    return table.agg(F.count_if(F.col("importance") == 0).alias("n_zero"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- cross-validation -----------------------------------------------------------------------


def fold_scores(splits: DataFrame, make: Maker, stage: bool = True) -> DataFrame:
    """Scored test rows of every split (columns ``split``, ``score`` and the row's own).

    ``splits`` has ``split`` and ``role``. ``Stacked`` models are fitted for all splits in the same passes;
    other models of different splits share nothing and are fitted a few at a time, fewer if they hold many
    rows. The fits read the splits repeatedly, so they are written first (``stage=False`` if the caller did).
    """
    splits = staged(splits, "splits") if stage else splits
    one = make()
    if isinstance(one, Stacked):
        return one.fit(splits.where("role = 'train'")).score(splits.where("role = 'test'")).drop("setting")
    sizes = {r[0]: r[1] for r in splits.groupBy("split").agg(F.count_if(F.col("role") == "train")).collect()}
    numbers = sorted(sizes)
    parallel = max(1, min(PARALLEL, len(numbers), FIT_ROWS // max([1, *sizes.values()])))

    def scored_split(s: int) -> DataFrame:
        part = splits.where(F.col("split") == s)
        return make().fit(part.where("role = 'train'")).score(part.where("role = 'test'"))

    with ThreadPool(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(splits.sparkSession)(scored_split), numbers, chunksize=1))


def plain_splits(df: DataFrame, row_id: str, k: int = 5) -> DataFrame:
    """``split`` and ``role`` over contiguous folds of the rows in order of ``row_id``, for ``fold_scores``."""
    folds = contiguous_folds(df.select(row_id), row_id, k)
    marked = df.join(folds, row_id).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("split") == F.col("fold"), "test").otherwise("train")
    return marked.withColumn("role", role).drop("fold")


def top_metrics_cv(scores: DataFrame, row_id: str, ratio: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., precision, recall, f1): top-share metrics averaged over splits."""
    each = top_metrics(staged(scores, "scores"), "score", LABEL, row_id, ratio, [*by, "split"])
    return each.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ["precision", "recall", "f1"]])


def grid(params: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    names = list(params)
    return [dict(zip(names, values)) for values in itertools.product(*params.values())]


def grid_search(
    df: DataFrame, make: Callable[..., Plain | Calibrated], params: Mapping[str, Sequence],
    ids: Sequence[str], day: str = "day_0", k: int = 5, balanced: bool = True,
) -> DataFrame:
    """(params, mean_auc, std_auc, best): every combination on the same day-disjoint splits."""
    splits = staged(day_splits(df, LABEL, ids, day, k, balanced), "splits")
    combos = [(json.dumps(combo, sort_keys=True), make(**combo)) for combo in grid(params)]
    if all(isinstance(m, Stacked) for _, m in combos):
        together = replace(combos[0][1], settings=tuple(c for _, m in combos for c in m.settings))
        scores = together.fit(splits.where("role = 'train'")).score(splits.where("role = 'test'"))
    else:
        each = [fold_scores(splits, lambda m=model: m, stage=False).withColumn("setting", F.lit(i)) for i, (_, model) in enumerate(combos)]
        scores = reduce(DataFrame.unionByName, each)
    return _grid_results(scores, [name for name, _ in combos])


def boosting_search(
    df: DataFrame, make: Callable[..., Boosted], params: Mapping[str, Sequence],
    ids: Sequence[str], day: str = "day_0", k: int = 5, balanced: bool = True,
) -> DataFrame:
    """``grid_search`` over numbers of rounds (those of the models that ``make`` gives) and other parameters of
    boosting; ``params`` in the result has the rounds as ``rounds``. One fit per split and combination of the
    other parameters; fits are independent and run a few at a time."""
    splits = staged(day_splits(df, LABEL, ids, day, k, balanced), "splits")
    models = [(combo, make(**combo)) for combo in grid(params)]
    names = [json.dumps({**combo, "rounds": int(m)}, sort_keys=True) for combo, model in models for m in model.rounds]
    number = {name: i for i, name in enumerate(names)}

    def scored_fit(task: tuple[int, int]) -> DataFrame:
        (combo, model), s = models[task[0]], task[1]
        part = splits.where(F.col("split") == s)
        out = model.fit(part.where("role = 'train'")).score(part.where("role = 'test'"))
        first = number[json.dumps({**combo, "rounds": int(model.rounds[0])}, sort_keys=True)]
        place = F.array_position(F.array(*[F.lit(int(m)) for m in model.rounds]), F.col("rounds"))
        # written by its own thread: the sum over trees is long, and many of them in one plan are slow to plan
        return staged(out.select((place - 1 + first).cast("int").alias("setting"), "split", LABEL, "score"), "boosted")

    tasks = list(itertools.product(range(len(models)), sorted(r[0] for r in splits.select("split").distinct().collect())))
    with ThreadPool(PARALLEL) as pool:
        scores = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(scored_fit), tasks, chunksize=1))
    return _grid_results(scores, names)


def _grid_results(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """(params, mean_auc, std_auc, best) from scores by ``setting``, the place of its name in ``names``."""
    aucs = pr_auc(staged(scores.select("setting", "split", LABEL, "score"), "scores"), "score", LABEL, ["setting", "split"])
    found = aucs.groupBy("setting").agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s")).collect()  # a row a combination
    by_setting = {r.setting: (r.m, r.s) for r in found}
    results = [(name, *by_setting.get(i, (None, None))) for i, name in enumerate(names)]
    top = max(results, key=lambda r: -1.0 if r[1] is None else r[1])[0]
    data = [(p, m, s, p == top) for p, m, s in results]
    return scores.sparkSession.createDataFrame(data, "params string, mean_auc double, std_auc double, best boolean")


def _scores_of(splits: DataFrame, makers: Mapping[str, Maker], columns: Sequence[str]) -> DataFrame:
    """Scores of all models. Their fits share nothing: what one leaves idle between its passes another uses."""

    def one(maker: tuple[str, Maker]) -> DataFrame:
        return fold_scores(splits, maker[1], stage=False).select(F.lit(maker[0]).alias("model"), *columns)

    with ThreadPool(max(1, min(PARALLEL, len(makers)))) as pool:
        each = pool.map(inheritable_thread_target(splits.sparkSession)(one), makers.items(), chunksize=1)
    return staged(reduce(DataFrame.unionByName, each), "scores")


def compare_models(
    df: DataFrame, makers: Mapping[str, Maker], ids: Sequence[str], levels: Sequence[float], day: str = "day_0", k: int = 5
) -> DataFrame:
    """(model, auc, level, recall, threshold): several classifiers on the same splits, from pooled scores."""
    out = _scores_of(staged(day_splits(df, LABEL, ids, day, k), "splits"), makers, [LABEL, "score"])
    return recall_at_precision(out, "score", LABEL, levels, ["model"]).join(pr_auc(out, "score", LABEL, ["model"]), "model")


def compare_roc(
    df: DataFrame, makers: Mapping[str, Maker], ids: Sequence[str], row_id: str, ratio: float = 0.2, day: str = "day_0", k: int = 5
) -> DataFrame:
    """(model, auc, precision, recall, f1, best): area under the ROC curve from pooled scores and top-share
    metrics of several classifiers on the same splits; the best has the highest F1 (first name on a tie)."""
    scores = _scores_of(staged(day_splits(df, LABEL, ids, day, k), "splits"), makers, [row_id, "split", LABEL, "score"])
    tops = top_metrics_cv(scores, row_id, ratio, ["model"])
    out = staged(tops.join(roc_auc(scores, "score", LABEL, ["model"]), "model").select("model", "auc", "precision", "recall", "f1"), "models")
    top = out.agg(F.min_by("model", F.struct(-F.coalesce("f1", F.lit(-1.0)), "model")).alias("m")).scalar()
    return out.withColumn("best", F.col("model") == top)


def hold_out_metrics(
    df: DataFrame, make: Maker, ids: Sequence[str], hold_days: int, gap_days: int, ratio: float = 0.2
) -> DataFrame:
    """Top-share metrics on the last days, trained on days that end a gap before them; both
    parts balanced by drawing negatives with replacement."""
    parts = staged(gap_hold_out(df, hold_days, gap_days), "parts")
    train = staged(balance(parts.where("role = 'train'").drop("role"), LABEL, ids), "train")
    held = balance(parts.where("role = 'hold_out'").drop("role"), LABEL, ids, seed=1)
    # a negative drawn twice needs its own row number for the tie order
    return top_metrics(
        make().fit(train).score(held).withColumn("_row", F.monotonically_increasing_id()), "score", LABEL, "_row", ratio
    )


def gap_study(df: DataFrame, make: Maker, gaps: Sequence[int], ratio_testing: float = 0.25) -> DataFrame:
    """(gap, auc): pooled precision-recall area by the days between training and test.

    One fit per training window; all gaps are scored with it.
    """
    df = staged(df, "rows")
    schedule = staged(gap_schedule(df, gaps, ratio_testing), "schedule")
    tests = schedule.where("role = 'test'").select("round", "gap", F.col("day").alias("day_0"))
    windows: dict[int, list[int]] = {}
    for r in schedule.where("role = 'train'").select("round", F.unix_date("day").alias("d")).collect():  # rounds x days
        windows.setdefault(r["round"], []).append(r.d)
    day = F.unix_date(F.col("day_0").cast("date"))
    one = make()
    if isinstance(one, Stacked):
        if not one.calibrated and len(one.settings) == 1 and one.settings[0].loss == "squares" and not one.settings[0].l1 and one.scale:
            fitted = sliding_ridge(df, one.columns, windows, one.settings[0].l2, day)
        else:
            members: dict[int, list[int]] = {}
            for number, days in windows.items():
                for d in days:
                    members.setdefault(d, []).append(number)
            fitted = one.fit(df.withColumn("_day", day), "_day", members)
        out = fitted.score(df.join(tests, "day_0"), "round").select("gap", LABEL, "score")
        return pr_auc(staged(out, "scores"), "score", LABEL, ["gap"])
    out = None
    for i, days in sorted(windows.items()):
        fitted = make().fit(df.where(day.isin(days)))
        part = fitted.score(df.join(tests.where(F.col("round") == i), "day_0")).select("gap", LABEL, "score")
        out = part if out is None else out.unionByName(part)
    return pr_auc(staged(out, "scores"), "score", LABEL, ["gap"])


def weekday_study(df: DataFrame, make: Maker, ids: Sequence[str], k: int = 3) -> DataFrame:
    """(weekday, auc): trained and tested on the same weekday only."""
    df = staged(df, "rows")
    of = lambda w: day_splits(df.where(F.weekday("day_0") == w), LABEL, ids, k=k)
    each = [of(w).withColumns({"weekday": F.lit(w), "split": F.col("split") + w * k}) for w in range(7)]
    scores = fold_scores(reduce(DataFrame.unionByName, each), make)
    return pr_auc(staged(scores.select("weekday", LABEL, "score"), "scores"), "score", LABEL, ["weekday"])


# ---- projections ----------------------------------------------------------------------------


def variance_table(df: DataFrame, vec: str) -> tuple[PCAModel, DataFrame]:
    """Full PCA and (component, share, cumulative) of the variance each component explains."""
    d = df.select(F.array_size(vector_to_array(vec))).first()[0]
    model = PCA(k=d, inputCol=vec, outputCol="pca").fit(df)
    shares = model.explainedVariance.toArray()
    total = np.cumsum(shares)
    data = [(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(shares, total))]
    return model, df.sparkSession.createDataFrame(data, "component int, share double, cumulative double")


def components_for(table: DataFrame, share: float) -> int:
    """Smallest number of components whose variance adds up to a share."""
    hit = table.where(F.col("cumulative") >= share - 1e-12).agg(F.min("component")).first()[0]
    return hit if hit is not None else table.count()


def project(df: DataFrame, model: PCAModel, vec: str, k: int) -> DataFrame:
    """Adds ``pca``: the first k components (array)."""
    return model.setInputCol(vec).setOutputCol("_p").transform(df).withColumn(
        "pca", F.slice(vector_to_array("_p"), 1, k)
    ).drop("_p")


def class_moments(df: DataFrame, vec: str, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, vector sum and d x d product sum around the overall mean.

    One pass: tasks add up a packed row per class (rows, mean, products around that mean), which are merged
    over groups of tasks; the driver receives a fixed number of rows per class.
    """

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = math.isqrt(len(a) - 1)  # 1 + d + d * d numbers
        n, step = a[0] + b[0], b[1 : d + 1] - a[1 : d + 1]
        products = a[d + 1 :] + b[d + 1 :] + np.outer(step, step).reshape(-1) * (a[0] * b[0] / n)
        return np.concatenate([[n], a[1 : d + 1] + step * b[0] / n, products])

    def part(c: int, _: np.ndarray, x: np.ndarray, sums: dict[int, np.ndarray]) -> None:
        centred = x - x.mean(0)
        new = np.concatenate([[len(x)], x.mean(0), (centred.T @ centred).reshape(-1)])
        sums[c] = merge(sums[c], new) if c in sums else new

    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("long").alias("_key"), F.lit(0.0).alias("_y"), F.col(vec).cast("array<double>").alias("_v"))
    found = packed_sums(rows, part, merge)
    total = sum(a[0] for a in found.values())
    d = math.isqrt(len(next(iter(found.values()))) - 1) if found else 0
    overall = sum((a[0] * a[1 : d + 1] for a in found.values()), np.zeros(d)) / max(total, 1)
    out = {}
    for c, a in found.items():
        away = a[1 : d + 1] - overall
        out[c] = (float(a[0]), a[0] * away, a[d + 1 :].reshape(d, d) + a[0] * np.outer(away, away))
    return out


def pooled_covariance(moments: Mapping[int, tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Covariance of all rows (sample form)."""
    n = sum(m[0] for m in moments.values())
    s = sum(m[1] for m in moments.values())
    q = sum(m[2] for m in moments.values())
    return (q - np.outer(s, s) / n) / (n - 1)


def discriminant_axis(df: DataFrame, vec: str, label: str) -> np.ndarray:
    """Direction of the two-class linear discriminant (unit within-class variance)."""
    moments = class_moments(df, vec, label)
    (n0, s0, q0), (n1, s1, q1) = moments[0], moments[1]
    within = (q0 - np.outer(s0, s0) / n0 + q1 - np.outer(s1, s1) / n1) / (n0 + n1 - 2)
    axis = np.linalg.lstsq(within, s1 / n1 - s0 / n0, rcond=None)[0]
    return axis / np.sqrt(axis @ within @ axis)


def discriminant(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Adds ``lda``: the projection on the discriminant direction."""
    axis = [float(w) for w in discriminant_axis(df, vec, label)]
    weights = df.sparkSession.createDataFrame([(axis,)], "w array<double>").scalar()
    product = F.aggregate(F.zip_with(vec, "_w", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn("_w", weights).withColumn("lda", product).drop("_w")


# ---- clustering -----------------------------------------------------------------------------


def k_means(df: DataFrame, vec: str, k: int, seed: int = SEED) -> KMeansModel:
    """K-means over an array column."""
    prepared = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return KMeans(k=k, seed=seed).fit(prepared)


def clustered(model: KMeansModel, df: DataFrame, vec: str) -> DataFrame:
    """Adds ``cluster``."""
    prepared = df.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return model.transform(prepared).withColumnRenamed("prediction", "cluster").drop("features")


def silhouette_by_k(df: DataFrame, row_id: str, vec: str, ks: Sequence[int], seed: int = SEED) -> DataFrame:
    """(k, sse, silhouette): inertia and mean exact silhouette of each k, over all rows; one pass over the pairs."""
    marked, costs = df, []
    for q, k in enumerate(ks):
        model = k_means(df, vec, k, seed)
        marked = clustered(model, marked, vec).withColumnRenamed("cluster", f"_k{q}")
        costs.append((q, k, float(model.summary.trainingCost)))
    means = silhouettes_of(marked, row_id, vec, [f"_k{q}" for q in range(len(ks))]).groupBy("nth").agg(F.avg("silhouette").alias("silhouette"))
    table = df.sparkSession.createDataFrame(costs, "nth int, k int, sse double")  # a row a k
    return table.join(means, "nth", "left").select("k", "sse", "silhouette")


def silhouette_by_variance(
    df: DataFrame, row_id: str, vec: str, shares: Sequence[float], ks: Sequence[int]
) -> DataFrame:
    """(retained, components, k, sse, silhouette) for several shares of retained variance."""
    prepared = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model, table = variance_table(prepared, "_v")
    out = None
    for share in shares:
        n = components_for(table, share)
        low = staged(project(prepared, model, "_v", n).select(row_id, "pca"), "projected")
        one = silhouette_by_k(low, row_id, "pca", ks)
        one = one.select(F.lit(float(share)).alias("retained"), F.lit(n).alias("components"), "k", "sse", "silhouette")
        out = one if out is None else out.unionByName(one)
    return out
