"""Hand-computed cases for windows, groups, outliers and the rolling state."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import downstream_interface, equal_width_bin, row_mean, upstream_interface
from fleetpulse.functions.series import series, series_table
from fleetpulse.operators import groups as G
from fleetpulse.operators import windows as WN
from fleetpulse.operators.checks import CheckFailed, days_valid, require
from fleetpulse.plans.vectors import five_day_history, five_day_vector
from fleetpulse.sources.sinks import roll, with_sequence

DAY = date(2024, 1, 15)


def test_feature_grammar():
    features = S.feature_columns()
    assert len(features) == len(set(features)) == 280
    assert len(S.FIVE_DAY_VECTOR) == 289
    dropped = S.redundant_features()
    assert len(dropped) == len(set(dropped)) == 54
    assert set(dropped) <= set(features)


def test_interface_patterns(spark):
    df = spark.createDataFrame([("a Downstream 1/2/3 z", "cable-Upstream 4/1/0"), ("foo", "bar")], "d string, u string")
    rows = df.select(downstream_interface("d"), upstream_interface("u")).collect()
    assert tuple(rows[0]) == ("Downstream 1/2/3", "Upstream 4/1/0")
    assert tuple(rows[1]) == (None, None)


def test_standardise_edge_groups(spark):
    hour = datetime(2024, 1, 15, 3)
    rows = [("A", hour, 5.0, None), ("B", hour, 5.0, None), ("A", hour + timedelta(hours=1), 1.0, 2.0), ("B", hour + timedelta(hours=1), 3.0, None)]
    df = spark.createDataFrame(rows, "mac string, hour_stamp timestamp_ntz, x double, y double")
    out = {(r.mac, r.hour_stamp.hour): (r.x, r.y) for r in G.standardise_to_group(df, ["hour_stamp"], ["x", "y"]).collect()}
    assert out[("A", 3)] == (0.0, None)          # no spread -> 0, whole group NULL -> NULL
    assert out[("A", 4)] == (-0.5, 0.0)
    assert out[("B", 4)][0] == 0.5


def test_missing_and_absent_windows(spark):
    rows = [("A", DAY, 0, None, 0), ("A", DAY, 1, 2.0, 1), ("A", DAY, 1, 4.0, 0)]
    df = spark.createDataFrame(rows, "mac string, day_0 date, hour_window int, x double, offline_flg int")
    stats = WN.device_window_stats(df, ["mac", "day_0"], ["x"])
    wide = WN.spread(stats, ["mac", "day_0"], "hour_window", S.WINDOWS, {"x": "x", "miss_x": "miss_x", "offline_pct": "off"}).first()
    assert (wide["0_x"], wide["0_miss_x"]) == (None, 100.0)
    assert (wide["1_x"], round(wide["1_miss_x"], 3), round(wide["1_off"], 3)) == (3.0, 66.667, 16.667)
    assert wide["3_miss_x"] is None and wide["3_x"] is None


def test_row_mean(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(row_mean(["a", "b", "c"])).collect()] == [2.0, None]


def test_zero_cut_flags_every_ever_offline_device(spark):
    rows = [("A", "m", 10.0), ("B", "m", 0.0)]
    wide = spark.createDataFrame(rows, "mac string, hardware_model string, x double").select(
        "mac", "hardware_model", *[(F.col("x") if h == 0 else F.lit(0.0)).alias(f"{h}_unavailable") for h in range(24)]
    )
    cuts = G.model_cuts(wide)
    assert {r.mac for r in G.offline_outliers(wide, cuts).collect()} == {"A", "B"}
    assert G.offline_outliers(wide, cuts, strict=True).count() == 0


def test_building_and_validity(spark):
    nodes = spark.createDataFrame(
        [("aa:1", "WLAN MODEM TWG870 - CPE", "b", "x", 55), ("aa:2", "OTHER", "b", "x", 55), ("aa:3", "WLAN MODEM TWG870 - CPE", None, "x", 55), ("aa:4", "WLAN MODEM TWG870 - CPE", "b", "x", 1)],
        "node_key string, src_node_model string, src_node_building_id string, cly_acct_number string, topo_node_type_id int",
    )
    day = datetime(2024, 1, 1)
    history = spark.createDataFrame(
        [("h", "g", f"aa:{k}", day, day + timedelta(days=d)) for k in range(1, 5) for d in (1, 20)],
        "cmts string, service_group string, mac string, modemloss_valid_from timestamp_ntz, modemloss_valid_to timestamp_ntz",
    )
    rows = G.device_static(nodes, history).collect()
    assert [(r.mac, r.n_cpe_building) for r in rows] == [("AA1", 2)]
    assert G.valid_on(G.device_static(nodes, history), date(2024, 1, 21)).count() == 1
    assert G.valid_on(G.device_static(nodes, history), date(2024, 1, 22)).count() == 0


def test_day_gap_breaks_differences(spark):
    rows = [("A", DAY - timedelta(days=2), 1.0, 5.0), ("A", DAY, 4.0, 6.0), ("A", DAY + timedelta(days=1), 10.0, 7.0)]
    daily = spark.createDataFrame(rows, "mac string, day_0 date, d double, l double")
    out = {r.day_0: (r.d, r.l) for r in WN.day_differences(daily, ["d"], ["l"]).collect()}
    assert out[DAY] == (None, 6.0)
    assert out[DAY + timedelta(days=1)] == (6.0, 7.0)
    pivot = WN.day_differences_by_pivot(daily, DAY + timedelta(days=1), ["d"], ["l"]).collect()
    assert [(r.d, r.l) for r in pivot] == [(6.0, 7.0)]
    # a device seen only yesterday has no row
    assert WN.day_differences_by_pivot(daily, DAY + timedelta(days=2), ["d"], ["l"]).count() == 0


def test_history_equals_the_daily_step(spark):
    """All days at once must equal the day-by-day buffers."""
    base = spark.range(2).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).where("NOT (id = 1 AND k = 4)")
    value = lambda seed: (F.hash("id", "k", F.lit(seed)) % 1000) / 10.0
    cells = [c for m in S.DAILY_MEASURES for c in S.windowed(m)]
    vectors = base.select(
        F.date_add(F.lit(DAY), F.col("k").cast("int")).alias("day_0"), F.col("id").cast("string").alias("mac"),
        *[F.lit("x").alias(c) for c in S.IDENTITY[2:7]], F.lit(1).alias("n_cpe_building"),
        *[value(i).alias(c) for i, c in enumerate(cells)],
    )
    day_0 = DAY + timedelta(days=6)
    daily = WN.day_means(vectors)
    diffs = WN.day_differences(daily)
    one = five_day_vector(vectors, daily, diffs, day_0)
    every = five_day_history(vectors).where(F.col("day_0") == F.lit(day_0)).select(*one.columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, every.collect()))
    assert len(one.columns) == 288


def test_roll_and_sequence(spark):
    rows = [("A", DAY - timedelta(days=k)) for k in range(5)]
    df = spark.createDataFrame(rows, "mac string, day_0 date")
    kept = roll(df, df.where(F.col("day_0") == F.lit(DAY)), DAY, 2)
    assert sorted(r.day_0 for r in kept.collect()) == [DAY - timedelta(days=1), DAY]
    ids = [r.seq_id for r in with_sequence(df, start_after=10).orderBy("day_0").collect()]
    assert ids == [11, 12, 13, 14, 15]


def test_series(spark):
    assert series_table(spark, 5, 1).count() == 0
    assert [r.n for r in series_table(spark, 1, 5, 2).orderBy("n").collect()] == [1, 3, 5]
    assert [r.n for r in series_table(spark, 3, 1, -1).orderBy("n").collect()] == [1, 2, 3]
    df = spark.createDataFrame([(1, 5, 0), (5, 1, 1), (1, 5, None)], "a long, b long, s long")
    assert [r[0] for r in df.select(series(F.col("a"), F.col("b"), F.col("s"))).collect()] == [[1, 2, 3, 4, 5], [], [1, 2, 3, 4, 5]]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (10.0,)], "x double")
    bins = [r[0] for r in df.select(equal_width_bin(F.col("x"), F.lit(0.0), F.lit(10.0), 10)).collect()]
    assert bins == [1, 1, 2, 10]


def test_checks_raise(spark):
    hours = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 20),)], "ts timestamp_ntz")
    require(days_valid(hours, "ts", DAY, DAY - timedelta(days=9), DAY), "fine")
    with pytest.raises(CheckFailed):
        require(days_valid(hours, "ts", date(2024, 2, 1), DAY, DAY), "outside")
