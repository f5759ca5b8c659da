"""Every registered query is well formed; a sample of them equals its SQL."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare
from fleetpulse.catalog.inputs import DAY, Inputs
from fleetpulse.operators.checks import CheckFailed
from fleetpulse.plans.vectors import five_day_history
from fleetpulse.session import new_table_path, staged
from fleetpulse.streaming.daily_state import assemble_step, backfill

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_names():
    names = list(queries())
    assert len(names) > 150 and set(oracle_sql()) <= set(names)
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)


@needs_data
def test_flagship(spark):
    assert entry(spark).count() > 0


@needs_data
def test_sample_of_queries_equals_sql(spark):
    names = ["src1_downstream_day", "composite2_upstream_vector", "composite7_failing_devices", "ev5_pr_auc", "st7_energy_test"]
    out = compare(spark, SF, names)
    assert all(r.startswith("ok") for r in out.values()), out


@needs_data
def test_daily_loop_equals_the_set_based_history(spark):
    """Running the incremental day step day by day gives the same five-day vectors."""
    t = Inputs(spark, SF)
    # the loop bounds each day's offline history by that day; here no device is an outlier on any day
    online = staged(t.health_hour.withColumn("cm_status", F.lit(8)), "health")
    t.__dict__["health_hour"] = online
    inputs = {n: getattr(t, n) for n in ["health_hour", "topo_nodes", "group_history", "ifc_up_hour", "ifc_down_hour", "ifc_to_group"]}
    root = new_table_path(spark, "daily-state")
    days = [date(DAY.year, DAY.month, DAY.day - k) for k in range(2, -1, -1)]
    got = backfill(spark, root, inputs, days)
    with pytest.raises(CheckFailed):
        assemble_step(spark, root, days[-1])
    window = F.col("day_0").between(F.lit(days[0]), F.lit(days[-1]))
    want = five_day_history(t.vector_1d.where(window)).where(F.col("day_0") == F.lit(DAY))
    cols = [c for c in want.columns]
    rounded = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*cols).collect())
    assert rounded(got) == rounded(want) and got.count() > 0
