"""The whole daily run over stored days."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fleetpulse.catalog.inputs import DAY, Inputs
from fleetpulse.operators.checks import CheckFailed
from fleetpulse.plans.vectors import five_day_history
from fleetpulse.session import new_table_path, staged
from fleetpulse.sources.sinks import log_lines
from fleetpulse.streaming import daily_state as D

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def rows(df, cols):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*cols).collect())


def test_days_in_turn_equal_the_set_based_result_and_a_rerun_changes_nothing(spark):
    t = Inputs(spark, SF)
    # no device is an outlier, so that each day's offline history does not matter
    t.__dict__["health_hour"] = staged(t.health_hour.withColumn("cm_status", F.lit(8)), "health")
    names = ["health_hour", "topo_nodes", "group_history", "ifc_up_hour", "ifc_down_hour", "ifc_to_group", "milestones", "sessions", "cases", "interactions"]
    inputs = {n: getattr(t, n) for n in names}
    root = new_table_path(spark, "daily-run")
    days = [DAY - timedelta(days=k) for k in (1, 0)]
    for d in days:
        D.daily_run(spark, root, inputs, d, assemble=d == days[-1])
    window = F.col("day_0").between(F.lit(days[0]), F.lit(days[-1]))
    want = five_day_history(t.vector_1d.where(window)).where(F.col("day_0") == F.lit(DAY))
    got = spark.read.parquet(f"{root}/five_day")
    before = rows(got, want.columns)
    assert before == rows(want, want.columns) and before
    assert {r.day_0 for r in spark.read.parquet(f"{root}/vector").select("day_0").distinct().collect()} == {DAY}
    assert spark.read.parquet(f"{root}/daily").select("day_0").distinct().count() == 2

    D.daily_run(spark, root, inputs, DAY)
    assert rows(spark.read.parquet(f"{root}/five_day"), want.columns) == before
    # labels of a day that has vectors: pretend that the run is eight days later
    n = D.label_step(spark, root, inputs, DAY + timedelta(days=D.LABEL_LAG_DAYS))
    assert n == D.label_step(spark, root, inputs, DAY + timedelta(days=D.LABEL_LAG_DAYS))
    failing = t.via_macs.where(F.col("day_0") == F.lit(DAY)).select("mac", "day_0", "milestone_name").distinct()
    assert n == got.join(failing, ["mac", "day_0"]).count()

    log_lines(spark.createDataFrame([("2001-01-01: run started", 0, 0)], "log_text string, is_error int, is_done int"), f"{root}/run_log")
    with pytest.raises(CheckFailed, match="did not finish"):
        D.daily_run(spark, root, inputs, DAY + timedelta(days=1))
