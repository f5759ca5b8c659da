"""Distribution, pair and evaluation operators against numpy and hand examples."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import cosine_distance
from fleetpulse.operators import evaluate as EV
from fleetpulse.operators import folds as FD
from fleetpulse.operators import models as M
from fleetpulse.operators import pairs as PR
from fleetpulse.operators import ranking as RK
from fleetpulse.operators import screening as SC
from fleetpulse.operators import stats as ST
from fleetpulse.operators.ranking import exact_percentiles, running_totals, value_counts
from fleetpulse.session import new_table_path
from fleetpulse.sources import sinks

SCORES = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.4, 0), (5, 0.3, 1), (6, 0.1, 0)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORES, "id long, score double, label int")


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(size=(40, 3)), rng.normal(loc=2.0, size=(30, 3))])
    rows = [(i, "X" if i < 40 else "Y", [float(v) for v in p]) for i, p in enumerate(pts)]
    return pts, spark.createDataFrame(rows, "id long, grp string, v array<double>")


def distances(pts):
    return np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))


@pytest.fixture
def uncoalesced(spark):
    """As many ranges as shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_over_ranges(spark, uncoalesced):
    values = [0.0] + [1e-9 * k for k in range(1, 400)] + [5.0, 7.0]
    rows = [("a", v, k + 1) for k, v in enumerate(values)] + [("b", 1.0, 5), ("b", 2.0, 6)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(3)
    out = running_totals(df, "v", ["n"], by=["g"], totals=True)
    got = {(r.g, r.v): (r.cum_n, r.all_n) for r in out.collect()}
    up = np.cumsum(np.arange(1, len(values) + 1)).tolist()
    assert got == {("a", v): (c, up[-1]) for v, c in zip(values, up, strict=True)} | {("b", 1.0): (5, 11), ("b", 2.0): (11, 11)}
    one = running_totals(df.where("g = 'a'").drop("g"), "v", ["n"], descending=True)
    assert [r.cum_n for r in one.orderBy(F.desc("v")).collect()] == list(np.cumsum(np.arange(len(values), 0, -1)))
    assert running_totals(df.where("false"), "v", ["n"], by=["g"]).count() == 0


def test_top_by_score_in_groups(spark, uncoalesced):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", int(i), float(rng.integers(0, 6)) if i % 11 else None) for i in rng.permutation(300)] + [("none", 900, None)]
    df = spark.createDataFrame(rows, "g string, id long, s double")
    got = {(r.g, r.id) for r in RK.top_by_score(df, "s", "id", F.bround(F.col("n_rows") * 0.3, 0), ["g"]).collect()}
    want = set()
    for g in ("g0", "g1", "g2"):
        mine = [r for r in rows if r[0] == g]
        best = sorted((r for r in mine if r[2] is not None), key=lambda r: (-r[2], r[1]))[: round(0.3 * len(mine))]
        want |= {(g, r[1]) for r in best}
    assert got == want


@pytest.mark.parametrize("ranked", [1, 10, 50_000])
def test_radix_selection_finds_the_kth_hash(spark, ranked, monkeypatch):
    monkeypatch.setattr(RK, "RANKED", ranked)
    monkeypatch.setattr(RK, "DIGITS", 1)
    df = spark.range(300).union(spark.range(20))  # some ids twice
    hashes = sorted(r.h for r in df.select(RK.stable_hash("id", seed=5).alias("h")).collect())
    for k in (1, 2, 57, 320):
        assert RK.kth_hash(df, ["id"], F.lit(k), 5).first().cut == hashes[k - 1]
    for k in (0, -3, 321, None):
        assert RK.kth_hash(df, ["id"], F.lit(k), 5).first().cut is None


def test_exact_percentiles(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=300), np.zeros(200)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    points = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    got = {r.p: r.percentile for r in exact_percentiles(value_counts(df, ["x"]), points).collect()}
    for p in points:
        assert got[p] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_curve_has_one_point_per_score_and_the_end(scored):
    pts = sorted((r.recall, r.precision) for r in EV.precision_recall_points(scored, "score", "label").collect())
    assert len(pts) == 6 and (0.0, 1.0) in pts
    assert (pytest.approx(2 / 3), pytest.approx(2 / 3)) in [(r, p) for r, p in pts]


def test_areas(scored):
    pos = [s for _, s, y in SCORES if y]
    neg = [s for _, s, y in SCORES if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 9
    assert EV.roc_auc(scored, "score", "label").first().auc == pytest.approx(wins)
    full, part = EV.pr_auc(scored, "score", "label").first().auc, EV.partial_pr_auc(scored, "score", "label", 0.6).first().auc
    assert 0 <= part <= full <= 1


def test_recall_at_precision_edges(scored):
    out = {r.level: (r.recall, r.threshold) for r in EV.recall_at_precision(scored, "score", "label", [0.5, 0.95, 1.5]).collect()}
    assert out[0.5] == (1.0, 0.1)
    assert out[0.95] == (pytest.approx(1 / 3), 0.9)
    assert out[1.5] == (0.0, 1.0)


def test_top_metrics(scored):
    r = EV.top_metrics(scored, "score", "label", "id", 0.5).first()
    assert (r.n_top, r.precision, r.recall, r.f1) == (3, pytest.approx(200 / 3), 100.0, pytest.approx(80.0))


def test_mean_roc_is_monotone_and_anchored(scored):
    folded = scored.withColumn("fold", F.lit(0)).unionByName(scored.withColumn("fold", F.lit(1)))
    rows = EV.mean_roc(folded, "score", "label", "fold").orderBy("fpr").collect()
    tpr = [r.mean_tpr for r in rows]
    assert len(rows) == 100 and tpr[0] == 0.0 and tpr[-1] == 1.0 and tpr == sorted(tpr)
    assert max(r.std_tpr for r in rows) < 1e-12


def test_energy_statistic_and_stored_tiles(spark, cloud):
    pts, df = cloud
    d, x = distances(pts), np.arange(70) < 40
    n1, n2 = 40, 30
    want = n1 * n2 / 70 * (2 * d[np.ix_(x, ~x)].sum() / (n1 * n2) - d[np.ix_(x, x)].sum() / n1**2 - d[np.ix_(~x, ~x)].sum() / n2**2)
    one = PR.energy_statistics(df, "id", "v", "grp", 0, block_rows=16).first().energy
    assert one == pytest.approx(want)
    reps = {r.r: r.energy for r in PR.energy_statistics(df, "id", "v", "grp", 19, block_rows=16).collect()}
    tiles = PR.distance_tiles(df, "id", "v", 16)
    again = {r.r: r.energy for r in PR.energy_from_tiles(tiles, df, "id", "grp", 19, block_rows=16).collect()}
    assert set(reps) == set(again) == set(range(20))
    assert all(reps[k] == pytest.approx(again[k]) for k in reps)
    outcome = PR.energy_test(df, "id", "v", "grp", 19, 5, block_rows=16).first()
    assert outcome.reject and outcome.p_value == 0 and outcome.observed > outcome.limit


def test_stored_distances_are_not_shuffled(spark, tmp_path):
    """Their blocks are read where they lie; copies of a point count as often as they come."""
    rng = np.random.default_rng(9)
    rows = [(i, "X" if i % 3 else "Y", rng.normal(size=3).tolist()) for i in range(60)]
    for points in (rows, rows + rows[:20]):
        df = spark.createDataFrame(points, "id long, grp string, v array<double>")
        path = str(tmp_path / str(len(points)))
        PR.distance_tiles(df, "id", "v", 16).write.parquet(path)
        made = PR.energy_from_tiles(spark.read.parquet(path), df, "id", "grp", 0, block_rows=16)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Sort" in line and "ti#" in line] and "CoGroup" not in plan
        x = np.array([p[2] for p in points])
        first = np.array([p[1] == "X" for p in points])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        n1, n2 = first.sum(), (~first).sum()
        want = n1 * n2 / (n1 + n2) * (2 * d[first][:, ~first].mean() - d[first][:, first].mean() - d[~first][:, ~first].mean())
        assert made.first().energy == pytest.approx(want)
    other = spark.createDataFrame([(r[0] + 1, *r[1:]) for r in rows], "id long, grp string, v array<double>")
    with pytest.raises(Exception, match="not of these points"):
        PR.energy_from_tiles(spark.read.parquet(str(tmp_path / "60")), other, "id", "grp", 0, block_rows=16).collect()


def test_energy_of_identical_samples_is_zero(spark):
    rows = [(i, "X" if i < 10 else "Y", [float(i % 10), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    assert PR.energy_statistics(df, "id", "v", "grp").first().energy == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        PR.check_bootstrap(99, 1.5)


def test_silhouettes(spark, cloud):
    pts, df = cloud
    d, c = distances(pts), (np.arange(70) >= 40).astype(int)
    got = {r.id: r.silhouette for r in PR.silhouettes(df.withColumn("c", (F.col("id") >= 40).cast("int")), "id", "v", "c", 16).collect()}
    for i in range(70):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = d[i, c != c[i]].mean()
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_wide_tiles_give_what_single_blocks_give(spark, cloud, monkeypatch):
    pts, df = cloud
    monkeypatch.setattr(PR, "SPREAD", 2)
    dealt = PR.to_tiles(df, "id", 4, span=8)
    copies = dealt.count() / 70
    assert copies == dealt.select("tj").distinct().count() == 3  # 18 blocks of 4 rows: 3 super-blocks of 8
    assert PR.to_tiles(df, "id", 4).count() / 70 == 18
    d = distances(pts)
    r = PR.distance_summary(df, "id", "v", "euclidean", 4).first()
    x = d[np.triu_indices(70, 1)]
    assert (r.n, r.mean, r.std) == (len(x), pytest.approx(x.mean()), pytest.approx(x.std()))
    counts = {h.bin: h.n for h in PR.distance_histogram(df, "id", "v", "euclidean", 50, 4).collect()}
    assert counts == {h.bin: h.n for h in PR.distance_histogram(df, "id", "v", "euclidean", 50, 128).collect()}
    wide = {e.r: e.energy for e in PR.energy_statistics(df, "id", "v", "grp", 3, block_rows=4).collect()}
    assert wide == pytest.approx({e.r: e.energy for e in PR.energy_statistics(df, "id", "v", "grp", 3, block_rows=128).collect()})
    grouped = df.withColumn("c", (F.col("id") >= 40).cast("int"))
    wide = {e.id: e.silhouette for e in PR.silhouettes(grouped, "id", "v", "c", 4).collect()}
    assert wide == pytest.approx({e.id: e.silhouette for e in PR.silhouettes(grouped, "id", "v", "c", 128).collect()})
    assert {(e.g, e.h): e.n for e in PR.pair_sums(grouped, "id", "v", "c", 4).collect()} == {(0, 0): 780, (0, 1): 1200, (1, 1): 435}


def nearest(train, test, k):
    """Brute force: (id, rank) -> (near, distance), ties by smaller id."""
    out = {}
    for i, v in test:
        ranked = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in train)[:k]
        out.update({(i, r + 1): (j, d) for r, (d, j) in enumerate(ranked)})
    return out


def test_nearest_rows_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    spots = rng.normal(scale=50, size=(12, 3))
    train = [(i, [float(x) for x in spots[i % 12] + rng.normal(size=3)]) for i in range(300)]
    train += [(1000 + i, [7.0, 7.0, 7.0]) for i in range(150)]  # a third of the rows in one place
    test = [(i, [float(x) for x in spots[i % 12] + rng.normal(size=3)]) for i in range(100)]
    test += [(200, [7.0, 7.0, 7.0]), (201, [7.0, 7.5, 7.0]), (202, [1e4, 0.0, 0.0])]
    a, b = (spark.createDataFrame(x, "id long, v array<double>") for x in (train, test))
    for k in (1, 5, 460):
        got = {(r.id, r["rank"]): (r.near, r.distance) for r in PR.nearest_rows(a, b, "id", "v", k, block_rows=16).collect()}
        want = nearest(train, test, k)
        assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
        assert {key: v[1] for key, v in got.items()} == pytest.approx({key: v[1] for key, v in want.items()})


def test_pivots_spare_most_cells_of_clustered_points(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(scale=100, size=(20, 4))
    df = spark.createDataFrame([(i, [float(x) for x in spots[i % 20] + rng.normal(size=4)]) for i in range(2000)], "id long, v array<double>")
    cells = PR.PivotCells(df, "id", "v", [], 5, block_rows=20)
    visited = cells.visits(df, "id", "v").agg(F.avg(F.size("cells"))).first()[0]
    assert len(cells.pivots) == 100 and visited < 15


def test_cells_travel_in_parts(spark, monkeypatch):
    """However many cells a row visits, it is sent once per part; a crowded cell is cut into parts."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(600, 12))
    v[:200] = v[0] + rng.normal(size=(200, 12)) * 1e-3  # a crowd
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(PR, "SPREAD", 4)
    monkeypatch.setattr(PR, "SIDE_ROWS", 64)
    cells = PR.PivotCells(df, "id", "v", [], 3, block_rows=8)
    first, pieces = cells.parts(8)
    assert len(cells.pivots) == 75 and len(set(first)) <= 20 and first.max() + pieces.max() <= 24
    load = np.bincount(first, cells.size / pieces)
    assert load.max() <= 64 and load.sum() > 300
    test = df.where("id % 3 = 0")
    got = {(r.id, r["rank"]): (r.near, r.distance) for r in PR.nearest_rows(df, test, "id", "v", 3, block_rows=8).collect()}
    assert len(got) == 600
    for i in range(0, 600, 3):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        want = sorted(zip(d, range(600)))[:3]
        assert [got[i, r][0] for r in (1, 2, 3)] == [j for _, j in want]
        assert [got[i, r][1] for r in (1, 2, 3)] == pytest.approx([x for x, _ in want], abs=1e-12)


def test_nearest_rows_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 1.0)], "id long, v array<double>, y double")
    none = df.where("id < 0")
    assert PR.nearest_rows(none, df, "id", "v", 3).count() == 0
    assert PR.nearest_rows(df, none, "id", "v", 3, ["y"]).count() == 0
    assert PR.nearest_labels(df, df, "id", "v", "y", 3).first().proba == 1.0


def test_distance_summary_over_blocks(cloud):
    pts, df = cloud
    x = distances(pts)[np.triu_indices(70, 1)]
    r = PR.distance_summary(df, "id", "v", "euclidean", 16).first()
    assert (r.n, r.mean, r.std) == (len(x), pytest.approx(x.mean()), pytest.approx(x.std()))
    assert sum(h.n for h in PR.distance_histogram(df, "id", "v", "euclidean", 50, 16).collect()) == len(x)


def test_ks(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=200).round(1), rng.normal(0.5, 1, size=150).round(1)
    rows = [(1, float(v)) for v in a] + [(0, float(v)) for v in b]
    df = spark.createDataFrame(rows, "g int, x double").withColumn("miss_x", F.lit(0.0))
    got = ST.ks_two_sample(df, "g", 1, ["x", "miss_x"], with_missing_shares=False).collect()
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert len(got) == 1 and got[0].statistic == pytest.approx(want) and 0 <= got[0].p_value < 0.01
    same = ST.ks_two_sample(df.withColumn("g", (F.rand(1) > 2).cast("int")).unionByName(df.withColumn("g", F.lit(1))), "g", 1, ["x"]).first()
    assert same.statistic == 0 and same.p_value == 1


def test_near_zero_variance_and_correlation(spark):
    rows = [(1.0, float(k), float(k), None if k % 4 == 0 else 2.0 * k, 1.0 if k == 7 else 0.0) for k in range(200)]
    cols = ["flat", "x", "x_copy", "twice", "rare"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    flags = {r.column: r.flagged for r in SC.near_zero_variance(df, cols).collect()}
    assert flags == {"flat": True, "x": False, "x_copy": False, "twice": False, "rare": True}
    corr = {(r.a, r.b): r["corr"] for r in SC.pair_correlations(df, cols).collect()}
    assert corr[("x", "twice")] == pytest.approx(1.0) and corr[("flat", "x")] is None
    pairs = SC.strong_pairs(df, cols)
    assert {(r.a, r.b, r.identical) for r in pairs.collect()} == {("x", "x_copy", True), ("x", "twice", False), ("x_copy", "twice", False)}
    groups = {(r.kind, r["head"], r.member) for r in SC.group_pairs(pairs).collect()}
    assert groups == {("identical", "x", "x_copy"), ("correlated", "twice", "x"), ("correlated", "twice", "x_copy")}
    assert [r.column for r in SC.identical_to_drop(pairs).collect()] == ["x_copy"]


def test_longest_run(spark):
    days = [f"2024-01-0{d}" for d in (1, 2, 3, 5, 6, 7, 8, 9)]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("day_0"))
    r = FD.longest_run(df).first()
    assert (str(r.first_day), r.n_days) == ("2024-01-05", 5)


def test_no_day_in_train_and_test(spark):
    df = spark.range(600).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("day_0"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    splits = FD.day_splits(df, "label", ["id"], k=4)
    both = splits.groupBy("split", "day_0").agg(F.count_distinct("role").alias("n")).where("n > 1")
    assert both.count() == 0
    assert splits.where("role = 'test'").count() == 600
    train = splits.where("role = 'train'").groupBy("split").agg(F.avg("label").alias("m")).collect()
    assert all(r.m == 0.5 for r in train)


def test_top_by_score_of_short_and_unscored_tables(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "id long, score double")
    top = lambda k: sorted(r.id for r in RK.top_by_score(df, "score", "id", F.lit(k)).collect())
    assert top(2) == [1, 3] and top(4) == [1, 3, 4] and top(100) == [1, 3, 4] and top(0) == []


def test_curves_of_a_group_without_positives(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.9, 0), ("b", 0.2, 0), ("c", 0.4, 1)]
    df = spark.createDataFrame(rows, "fold string, score double, label int")
    assert {r.fold: r.auc for r in EV.pr_auc(df, "score", "label", ["fold"]).collect()} == {"a": 1.0, "b": None, "c": 1.0}
    assert {r.fold: r.auc for r in EV.partial_pr_auc(df, "score", "label", 0.5, ["fold"]).collect()} == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert {r.fold: r.auc for r in EV.roc_auc(df, "score", "label", ["fold"]).collect()} == {"a": 1.0, "b": None, "c": None}
    got = {r.fold: (r.recall, r.threshold) for r in EV.recall_at_precision(df, "score", "label", [0.5], ["fold"]).collect()}
    assert got == {"a": (1.0, 0.1), "b": (0.0, 1.0), "c": (1.0, 0.4)}
    assert EV.roc_points(df, "score", "label", ["fold"]).count() == 5
    named = df.withColumnsRenamed({"fold": "g", "score": "n", "label": "pos"})
    assert EV.mean_roc(named, "n", "pos", "g").count() == EV.mean_roc(df, "score", "label", "fold").count() == 100


def test_constant_and_never_paired_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, None, 1.0), (2.0, 5.0, None, 2.0), (None, None, 3.0, 4.0)], "a double, b double, c double, d double")
    got = {(r.a, r.b): (r.n, r.corr) for r in SC.pair_correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "c"] == (0, None) and got["a", "b"] == (2, None) and abs(got["a", "d"][1] - 1) < 1e-12
    ranks = {(r.a, r.b): (r.pearson, r.spearman) for r in SC.rank_correlations(df, [("a", "b"), ("a", "d")]).collect()}
    assert ranks["a", "b"] == (None, None) and abs(ranks["a", "d"][1] - 1) < 1e-12


def test_rank_correlations_add_up_before_pairs_meet_in_a_task(spark):
    data = [(float(i % 7), float(i * i % 31), None if i % 5 == 0 else float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SC.rank_correlations(df, [("a", "b"), ("a", "c")])
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.a, r.b): (r.pearson, r.spearman) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # no join deals cells by their pair alone
    assert not re.search(r"SortMergeJoin \[k#\d+L?\],", plan) and "BroadcastHashJoin [k#" in plan

    def mean_ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for k, name in ((1, "b"), (2, "c")):
        x, y = np.array([(r[0], r[k]) for r in data if r[k] is not None]).T
        want = np.corrcoef(x, y)[0, 1], np.corrcoef(mean_ranks(x), mean_ranks(y))[0, 1]
        assert np.allclose(got["a", name], want)


def test_distance_histogram_needs_only_the_ends_of_the_first_pass(spark, cloud, monkeypatch):
    pts, df = cloud
    monkeypatch.setattr(PR, "distance_summary", None)
    x = distances(pts)[np.triu_indices(len(pts), 1)]
    want = np.bincount(np.minimum(((x - x.min()) / ((x.max() - x.min()) / 20)).astype(int), 19), minlength=20)
    got = {h.bin: h.n for h in PR.distance_histogram(df, "id", "v", "euclidean", 20, 16).collect()}
    assert got == {k + 1: n for k, n in enumerate(want) if n}
    # equal points and points whose squares cancel
    near = spark.createDataFrame([(1, [1e6, 1.0]), (2, [1e6, 1.0]), (3, [1e6, 1.5]), (4, [1e6, 2.0])], "id long, v array<double>")
    assert {h.bin: h.n for h in PR.distance_histogram(near, "id", "v", "euclidean", 4, 2).collect()} == {1: 1, 3: 3, 4: 2}


def test_silhouettes_of_several_clusterings_share_one_pass(spark, cloud, monkeypatch):
    pts, df = cloud
    alone = {k: M.clustered(M.k_means(df, "v", k), df, "v") for k in (2, 3)}
    want = {k: PR.silhouettes(rows, "id", "v", "cluster", 16).agg(F.avg("silhouette")).first()[0] for k, rows in alone.items()}
    passes, tiles = [], PR.tile_apply
    monkeypatch.setattr(PR, "tile_apply", lambda *a, **kw: passes.append(1) or tiles(*a, **kw))
    got = {r.k: r.silhouette for r in M.silhouette_by_k(df, "id", "v", [2, 3]).collect()}
    assert got == pytest.approx(want) and len(passes) == 1
    # missing clusters and repeated ids, by each column as alone
    odd = spark.createDataFrame([(i % 9, [float(i), float(i * i % 5)], None if i == 4 else i % 2, i % 3) for i in range(12)], "id long, v array<double>, a int, b int")
    both = PR.silhouettes_of(odd, "id", "v", ["a", "b"], 4).collect()
    for q, c in enumerate("ab"):
        one = {(r.id, r.cluster): r.silhouette for r in PR.silhouettes(odd, "id", "v", c, 4).collect()}
        assert {(r.id, r.cluster): r.silhouette for r in both if r.nth == q} == pytest.approx(one)


def test_flat_dimensions_zero_vectors_and_one_class(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], "id long, v array<double>")
    assert [r.v[0] for r in PR.unit_variance(points, "v").collect()] == [0.0, 0.0]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert zero.select(cosine_distance("a", "b")).first()[0] is None
    one = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, y int")
    assert {r.sick_pct for r in ST.class_histogram(one, "x", "y", 2).collect()} == {None}


def test_kth_hashes_of_overlapping_groups_refine_until_small(spark, monkeypatch):
    monkeypatch.setattr(RK, "RANKED", 3)
    monkeypatch.setattr(RK, "DIGITS", 1)
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("cell"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = rows.unionByName(rows.where("cell = 1"))  # every hash of a cell twice
    cells = spark.createDataFrame([(0, 7), (1, 7), (1, 8), (2, 8), (0, 9)], "cell int, grp int")
    need = spark.createDataFrame([(7, 450), (8, 1), (9, 301), (6, 2)], "grp int, need long")
    got = {r.grp: r.cut for r in RK.kth_hashes(rows, need, cells).collect()}
    found = rows.collect()
    of = lambda *c: sorted(r.h for r in found if r.cell in c)
    assert got == {7: of(0, 1)[449], 8: of(1, 2)[0]}  # 9 has 300 hashes, 6 none
    alone = {r.grp: r.cut for r in RK.kth_hashes(rows, need.withColumn("grp", F.col("grp") - 7)).collect()}
    assert alone == {1: of(1)[0]}


def test_writes_count_what_they_wrote(spark):
    rows = spark.range(1000).select("id", F.lit("2024-01-01").cast("date").alias("day_0")).repartition(5)
    for k, df in {"some": rows, "none": rows.where("id < 0"), "known_empty": rows.limit(0)}.items():
        seen = sinks.counted(sinks.overwrite_days, df, new_table_path(spark, f"counted-{k}"), top=F.max("id"))
        assert seen == ({"n_rows": 1000, "top": 999} if k == "some" else {"n_rows": 0, "top": None}), k


def test_points_travel_no_oftener_in_larger_tables(spark):
    points = spark.range(40_000)
    assert PR.SIDE_ROWS >= 32_768
    copies = lambda n: PR.to_tiles(points.limit(n), "id", 16, PR.SIDE_ROWS // 16).count() / n
    assert copies(40_000) <= 17 and copies(20_000) <= 17


def test_pair_sums_of_any_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.choice([-3, 0, 5])), rng.normal(size=3).tolist()) for i in range(50)] + [(7, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, c int, v array<double>")
    want = {}
    for i, (_, g, x) in enumerate(rows):
        for _, h, y in rows[i + 1 :]:
            want.setdefault((min(g, h), max(g, h)), []).append(float(np.linalg.norm(np.array(x) - np.array(y))))
    got = {(r.g, r.h): r for r in PR.pair_sums(df, "id", "v", "c", 8).collect()}
    assert got.keys() == want.keys()
    for k, d in want.items():
        assert got[k].n == len(d) and [got[k].total, got[k].nearest, got[k].farthest] == pytest.approx([sum(d), min(d), max(d)])


@pytest.mark.parametrize("similar, size", [(False, 9), (True, None)])
def test_repeats_in_one_pass_equal_separate_tests(spark, monkeypatch, similar, size):
    rng = np.random.default_rng(9)
    rows = [(i, "X" if i % 5 < 3 else "Y", rng.normal(size=2).tolist()) for i in range(55)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    passes = []
    apply = PR.tile_apply
    monkeypatch.setattr(PR, "tile_apply", lambda *a, **k: passes.append(1) or apply(*a, **k))
    got = {r.repeat: r for r in PR.repeated_energy_test(df, "id", "v", "g", 19, 5, 2, size, similar, 8).collect()}
    assert len(passes) == 1 and sorted(got) == [0, 1]
    for q, r in got.items():
        seed = 1000 * (q + 1)
        x, y = df.where("g = 'X'"), df.where("g = 'Y'")
        if similar:
            half = size or 16
            both = PR.hash_sample(x, ["id"], F.lit(2 * half), seed)
            left = [i.id for i in PR.hash_sample(both, ["id"], F.lit(half), seed + 1).collect()]
            one = both.withColumn("g", F.when(F.col("id").isin(left), "X").otherwise("Y"))
        else:
            one = PR.hash_sample(x, ["id"], F.lit(size or 33), seed).unionByName(PR.hash_sample(y, ["id"], F.lit(size or 22), seed))
        want = PR.energy_test(one, "id", "v", "g", 19, 5, seed, 8).first()
        assert [r.observed, r.limit, r.p_value] == pytest.approx([want.observed, want.limit, want.p_value]) and r.reject == want.reject


def test_blocks_of_a_tile_meet_once():
    for rows, cols, diagonal in [(7, 5, False), (9, 9, True), (4, 4, True), (1, 1, True)]:
        met = np.zeros((rows, cols), int)
        for left, right, same in PR._walk(rows, cols, diagonal, 4):
            met[left, right] += np.triu(np.ones_like(met[left, right]), 1) if same else 1
        assert (met == (np.triu(np.ones_like(met), 1) if diagonal else 1)).all()


def test_city_block_of_any_vectors():
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(9, 5)), rng.normal(size=(7, 5))
    b[0], b[1], a[1, 2], b[2, 3] = a[0], a[2] + 1e-13, np.inf, np.nan
    with np.errstate(invalid="ignore"):
        for shift in (0.0, 1e6):
            want = np.abs((a + shift)[:, None] - (b + shift)[None]).sum(2)
            got = PR._city_block(a + shift, b + shift)
            assert got == pytest.approx(want, rel=1e-9, nan_ok=True) and got[0, 0] == 0


def test_vectors_of_a_tile_are_made_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, "X" if i < 30 else "Y", i % 2, rng.normal(size=3).tolist()) for i in range(40)], "id long, g string, c int, v array<double>")
    calls = []
    apply = PR.tile_apply
    monkeypatch.setattr(PR, "tile_apply", lambda *a, **k: calls.append((k.get("vec"), k.get("whole"))) or apply(*a, **k))
    assert PR.pair_sums(df, "id", "v", "c", 4).agg(F.sum("n")).first()[0] == 780
    assert PR.distance_summary(df, "id", "v", "cityblock", 4).first().n == 780
    assert PR.repeated_energy_test(df, "id", "v", "g", 0, 100, 1, block_rows=4).count() == 1
    assert calls == [("v", True)] * 3


@pytest.mark.parametrize("first", [1, 38])
def test_repeated_energy_of_samples_of_unlike_size(spark, first):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, "X" if i < first else "Y", v[i].tolist()) for i in range(40)], "id long, g string, v array<double>")
    d, x = np.linalg.norm(v[:, None] - v[None], axis=2), np.arange(40) < first
    n, m = first, 40 - first
    want = n * m / 40 * (2 * d[x][:, ~x].sum() / (n * m) - d[x][:, x].sum() / n**2 - d[~x][:, ~x].sum() / m**2)
    got = PR.repeated_energy_test(df, "id", "v", "g", 1, 50, 2, block_rows=8).collect()
    assert [r.observed for r in got] == pytest.approx([want, want])


def test_stored_distances_take_bounded_space(spark, tmp_path):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, "X" if i % 3 else "Y", rng.normal(size=3).tolist()) for i in range(90)], "id long, grp string, v array<double>")
    parts = PR.stripes(df, 8, 8 * 8 * 100)
    assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == 12 and len(parts) > 4
    assert PR.stripes(df, 8) == [(0, 12)] and PR.stripes(df.limit(0), 8) == [(0, 1)]
    path, cells, pairs = str(tmp_path / "stored"), [], []

    def stored(stripe):
        PR.distance_tiles(df, "id", "v", 8, stripe).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).select("ti", "tj", F.size("dist").alias("n")).collect()
        cells.append(sum(r.n for r in rows))
        pairs.extend((r.ti, r.tj) for r in rows)
        return spark.read.parquet(path)

    got = {r.r: r.energy for r in PR.energy_from_tiles(map(stored, parts), df, "id", "grp", 9, block_rows=8).collect()}
    assert got == pytest.approx({r.r: r.energy for r in PR.energy_statistics(df, "id", "v", "grp", 9, block_rows=8).collect()})
    # every pair of blocks is stored once, and never many of them at a time
    whole = PR.distance_tiles(df, "id", "v", 8).select("ti", "tj", F.size("dist").alias("n")).collect()
    assert sorted(pairs) == sorted((r.ti, r.tj) for r in whole) and len(set(pairs)) == len(pairs)
    assert sum(cells) == sum(r.n for r in whole) and max(cells) < sum(cells) / 3
