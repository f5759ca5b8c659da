"""Stacked fits against separate ones, optimality of sparse models, stored stages."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import models as M
from fleetpulse.operators import stacked as ST
from fleetpulse.sources.sinks import counted, overwrite

COLUMNS = ["a", "b", "c", "d"]
SCHEMA = "id long, day_0 date, label double, a double, b double, c double, d double"


def made(n: int = 600, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [0, 5, -1, 100]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=n) > 0.6).astype(float)
    x[rng.random((n, 4)) < 0.05] = np.nan
    start = datetime.date(2017, 3, 1)
    values = [[None if np.isnan(v) and i % 2 else float(v) for v in row] for i, row in enumerate(x)]
    return [(i, start + datetime.timedelta(days=i % 12), float(y[i]), *values[i]) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3).cache()


def filled(df, columns=COLUMNS):
    data = df.select("label", *columns).toPandas().astype(float)
    x = data[columns].to_numpy()
    mean = np.nanmean(x, 0)
    x = np.where(np.isnan(x), mean, x)
    deviation = x.std(0, ddof=1)
    return (x - mean) / deviation, 2 * data.label.to_numpy() - 1, mean, deviation


def test_stacked_folds_equal_separate_fits(spark, rows):
    folds = rows.withColumn("fold", (F.col("id") % 3).cast("int"))
    members = {f: [s for s in range(3) if s != f] for f in range(3)}
    settings = (ST.Setting("logistic", l2=1.0), ST.Setting("logistic", l2=100.0), ST.Setting("squares", l2=2.0), ST.Setting("hinge", l2=0.5))
    fitted = ST.Stacked(COLUMNS, settings).fit(folds, "fold", members)
    for s in range(3):
        train = folds.where(F.col("fold") != s)
        x, sign, mean, deviation = filled(train)
        ones = np.hstack([x, np.ones((len(x), 1))])
        for k, setting in enumerate(settings):
            w = fitted.weights[s][k]
            _, first, _ = ST.loss_terms(setting.loss, sign, ones @ w)
            gradient = ones.T @ first + setting.l2 * np.append(w[:-1], 0)
            assert np.abs(gradient).max() < 1e-5 * len(x), (s, setting)
        plain = M.Plain([*M.feature_stages(COLUMNS), M.logistic(1.0)]).fit(train)
        theirs = {r.id: r.score for r in plain.score(folds.where(F.col("fold") == s)).collect()}
        mine = {r.id: r.score for r in fitted.score(folds.where(F.col("fold") == s), "fold").where("setting = 0").collect()}
        assert mine.keys() == theirs.keys() and max(abs(mine[i] - theirs[i]) for i in mine) < 1e-3


def test_sparse_weights_meet_their_conditions(rows):
    x, sign, _, _ = filled(rows)
    ones = np.hstack([x, np.ones((len(x), 1))])
    zeros = []
    for l1 in (0.5, 20.0, 150.0, 1e5):
        setting = ST.Setting("hinge", l1=l1)
        w = ST.Stacked(COLUMNS, (setting,)).fit(rows.withColumn("split", F.lit(0))).weights[0][0]
        _, first, _ = ST.loss_terms("hinge", sign, ones @ w)
        g = ones.T @ first
        assert abs(g[-1]) < 1e-3
        for slope, value in zip(g[:-1], w[:-1], strict=True):
            assert abs(slope) <= l1 + 1e-3 if value == 0 else abs(slope + l1 * np.sign(value)) < 1e-3
        zeros.append(int((w[:-1] == 0).sum()))
    assert zeros == sorted(zeros) and zeros[0] < zeros[-1] == 4


def test_sliding_windows_equal_separate_ridges(rows):
    day = F.unix_date("day_0")
    numbers = sorted(r[0] for r in rows.select(day.alias("d")).distinct().collect())
    windows = {k: numbers[k : k + 5] for k in range(6)} | {9: numbers[:1] + numbers[-1:]}
    slid = ST.sliding_ridge(rows, COLUMNS, windows, 3.0, day)
    for k, days in windows.items():
        x, sign, mean, deviation = filled(rows.where(day.isin(days)))
        w = np.linalg.solve(x.T @ x + 3.0 * np.eye(4), x.T @ (sign - sign.mean())) / deviation
        mine, b = slid.plain_weights(k)
        assert mine == pytest.approx(w, rel=1e-6) and b == pytest.approx(sign.mean() - w @ mean, rel=1e-6)
        assert slid.scales[k].mean == pytest.approx(mean)
    members: dict = {}
    for k, days in windows.items():
        for d in days:
            members.setdefault(d, []).append(k)
    newton = ST.Stacked(COLUMNS, (ST.Setting("squares", l2=3.0),)).fit(rows.withColumn("_d", day), "_d", members)
    for k in windows:
        assert newton.plain_weights(k)[0] == pytest.approx(slid.plain_weights(k)[0], rel=1e-5)


def test_calibrated_stacks_give_probabilities(rows):
    splits = rows.withColumn("split", (F.col("id") % 2).cast("int"))
    fitted = M.stacked_svm(COLUMNS, ["id"], c=0.1).fit(splits)
    scores = fitted.score(splits).toPandas()
    assert len(scores) == 600 and scores.score.between(0, 1).all()
    assert scores[scores.label == 1].score.mean() > scores[scores.label == 0].score.mean() + 0.2
    assert abs(scores.score.mean() - scores.label.mean()) < 0.05
    raw = fitted.score(splits, raw=True).toPandas()
    a, b = scores.sort_values("id").score.to_numpy(), raw.sort_values("id").score.to_numpy()
    for s in (0, 1):
        mine = scores.sort_values("id").split.to_numpy() == s
        assert (np.argsort(a[mine], kind="stable") == np.argsort(b[mine], kind="stable")).mean() > 0.99


def test_degenerate_sets(spark, rows):
    """A constant or missing column, one class only, and no rows at all."""
    odd = rows.where("id < 40").withColumns({"a": F.lit(2.0), "b": F.lit(None).cast("double"), "split": F.lit(0)})
    scores = ST.Stacked(COLUMNS, (ST.Setting("logistic", l2=1.0),)).fit(odd).score(odd).toPandas().score
    assert scores.between(0, 1).all()
    one = odd.withColumn("label", F.lit(1.0))
    assert (ST.Stacked(COLUMNS, (ST.Setting("logistic", l2=1.0),)).fit(one).score(one).toPandas().score > 0.9).all()
    none = odd.where("false")
    assert ST.Stacked(COLUMNS, (ST.Setting(),)).fit(none).score(none).count() == 0
    with pytest.raises(ValueError):
        ST.Setting("other")


def test_grid_is_one_fit(rows):
    table = M.grid_search(rows, lambda c: M.stacked_logistic(COLUMNS, c), {"c": [1e-4, 1.0]}, ["id"], k=3).toPandas()
    assert list(table.params) == ['{"c": 0.0001}', '{"c": 1.0}'] and table.best.sum() == 1
    splits = M.day_splits(rows, "label", ["id"], k=3)
    one = M.pr_auc(M.fold_scores(splits, lambda: M.stacked_logistic(COLUMNS, 1.0)), "score", "label", ["split"]).toPandas()
    assert table.mean_auc[1] == pytest.approx(one.auc.mean(), abs=1e-9)


def test_gap_and_weekday_studies(rows):
    stacked = M.gap_study(rows, lambda: M.stacked_logistic(COLUMNS), [0, 2], 0.4).toPandas().set_index("gap").auc
    alone = M.gap_study(rows, lambda: M.Plain([*M.feature_stages(COLUMNS), M.logistic(1.0)]), [0, 2], 0.4).toPandas().set_index("gap").auc
    assert stacked.to_dict() == pytest.approx(alone.to_dict(), abs=0.01)
    ridge = M.gap_study(rows, lambda: ST.Stacked(COLUMNS, (ST.Setting("squares", l2=1.0),)), [0, 2], 0.4).count()
    assert ridge == 2 and M.weekday_study(rows, lambda: M.stacked_logistic(COLUMNS), ["id"], k=2).count() >= 5


@pytest.mark.parametrize("kind", ["discriminant", "share", "sparse"])
def test_stored_pipelines_score_the_same(spark, rows, tmp_path, kind):
    last = M.sparse_svm(1.0) if kind == "sparse" else M.logistic(1.0)
    options = {"discriminant": {"discriminant": True}, "share": {"components": 0.7}, "sparse": {}}[kind]
    fitted = M.Plain([*M.feature_stages(COLUMNS, **options), last]).fit(rows)
    M.save_model(fitted.model, str(tmp_path / "model"))
    again = M.load_model(str(tmp_path / "model"))
    scores = lambda model: {r.id: r.score for r in M.scored(model, rows).collect()}
    assert scores(again) == scores(fitted.model) and len(set(scores(again).values())) > 100


def test_first_trees_of_a_long_boosting_fit_are_the_short_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=400) * 0.3 > 0).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")
    stages = lambda n: [*M.feature_stages(["a", "b", "c"], scale=False), M.gradient_boosting(0.2, n, 3)]
    many = M.Boosted(stages(1), [2, 5, 8]).fit(df).score(df)
    got = {(r.id, r.rounds): r.score for r in many.collect()}
    assert len(got) == 1200
    for n in (2, 8):
        short = M.Plain(stages(n)).fit(df).score(df)
        assert max(abs(got[r.id, n] - r.score) for r in short.collect()) < 1e-9


def test_boosting_search_lists_every_combination(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"2024-01-{1 + i % 6:02d}", float(rng.normal()), float(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, d string, a double, label double").select("id", F.to_date("d").alias("day_0"), "a", "label")
    make = lambda learning_rate: M.Boosted([*M.feature_stages(["a"], scale=False), M.gradient_boosting(learning_rate, 1, 2)], [1, 3])
    table = M.boosting_search(df, make, {"learning_rate": [0.1, 0.5]}, ["id"], k=2).collect()
    assert len(table) == 4 and sum(r.best for r in table) == 1 and all(0 < r.mean_auc <= 1 for r in table)
    plain = lambda learning_rate, rounds: M.Plain([*M.feature_stages(["a"], scale=False), M.gradient_boosting(learning_rate, rounds, 2)])
    want = {r.params: r.mean_auc for r in M.grid_search(df, plain, {"learning_rate": [0.5], "rounds": [3]}, ["id"], k=2).collect()}
    assert all(abs(r.mean_auc - want[r.params]) < 1e-9 for r in table if r.params in want) and len(want) == 1


@pytest.mark.parametrize("kind", ["logistic", "forest", "calibrated"])
def test_models_score_after_an_observed_write(spark, rows, tmp_path, kind):
    """Counted writes leave an observation in the session, which can't be sent to tasks with a model."""
    assert counted(overwrite, rows.select("id"), str(tmp_path / "written"))["n_rows"] == rows.count()
    model = {
        "logistic": lambda: M.Plain([*M.feature_stages(COLUMNS), M.logistic(1.0)]),
        "forest": lambda: M.Plain([*M.feature_stages(COLUMNS, scale=False), M.random_forest(3, 3)]),
        "calibrated": lambda: M.Calibrated([*M.feature_stages(COLUMNS), M.ridge(1.0)], ["id"]),
    }[kind]()
    scores = model.fit(rows).score(rows).toPandas().score
    assert len(scores) == rows.count() and scores.between(0, 1).all()


def test_packed_blocks_hold_every_row(spark, rows, monkeypatch):
    """Blocks are of one key and give the sums of plain rows, also if many blocks are open in a task."""
    plain = ST._values(rows.withColumn("k", F.col("id") % 7), COLUMNS, F.col("k"))

    def part(key, y, values, sums):
        new = np.concatenate([[len(y), y.sum()], np.nansum(values, 0), np.isnan(values).sum(0)])
        sums[key] = sums[key] + new if key in sums else new

    want = ST.packed_sums(plain, part, np.add)
    for block_bytes, held in ((1 << 18, 64), (8 * 4 * 5, 64), (8 * 4 * 50, 1)):
        monkeypatch.setattr(ST, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(ST, "HELD_BLOCKS", held)
        packed = ST.packed_rows(plain).cache()
        got = ST.packed_sums(packed, part, np.add)
        assert got.keys() == want.keys() == set(range(7)) and all(np.allclose(got[k], want[k]) for k in want)
        assert packed.count() < rows.count() / 2
    none = ST.packed_rows(plain.where("false"))
    assert none.count() == 0 and ST.packed_sums(none, part, np.add) == {}


def test_passes_of_a_fit_read_packed_rows(rows, monkeypatch):
    read, sums = [], ST.packed_sums
    monkeypatch.setattr(ST, "packed_sums", lambda df, *args: read.append(df.count()) or sums(df, *args))
    M.stacked_svm(COLUMNS, ["id"]).fit(rows.withColumn("split", (F.col("id") % 2).cast("int")))
    assert len(read) > 5 and max(read) <= 2 * 3 * 3  # splits x parts x tasks, of 600 rows


@pytest.mark.parametrize(("held", "most"), [(1, 1), (10**9, M.PARALLEL)])
def test_fits_of_many_rows_are_not_held_at_a_time(rows, monkeypatch, held, most):
    running, seen = [], []

    class Slow(M.Plain):
        def fit(self, df):
            running.append(1)
            seen.append(len(running))
            try:
                return super().fit(df)
            finally:
                running.pop()

    monkeypatch.setattr(M, "FIT_ROWS", held, raising=False)
    splits = M.day_splits(rows, "label", ["id"], k=4)
    scores = M.fold_scores(splits, lambda: Slow([*M.feature_stages(COLUMNS, scale=False), M.random_forest(5, 3)]))
    assert scores.count() == rows.count() and max(seen) <= most
    assert held == 1 or max(seen) > 1


def test_forests_keep_the_nodes_of_rows(rows):
    """The same trees as without, and no files in a checkpoint folder."""
    kept = M.random_forest(8, 6)
    assert kept.getCacheNodeIds() and kept.getCheckpointInterval() == -1
    stages = M.feature_stages(COLUMNS, scale=False)
    trees = [M.Plain([*stages, f]).fit(rows).model.stages[-1].toDebugString.split("\n", 1)[1] for f in (kept, kept.copy().setCacheNodeIds(False))]
    assert trees[0] == trees[1]
