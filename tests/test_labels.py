"""As-of matching, starting milestones and sampling against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from itertools import groupby

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fleetpulse.operators import labels as L
from fleetpulse.operators.prep import balance, balance_within
from fleetpulse.operators.ranking import dense_index, hash_sample, top_by_score
from fleetpulse.plans.failures import labelled_sample, labelled_vectors

T0 = datetime(2024, 1, 2, 8)


def test_first_after_matches_brute_force(spark):
    rng = random.Random(5)
    at = lambda: T0 + timedelta(seconds=rng.randrange(0, 4000, 20))
    # key 'hot' holds most rows
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key(), at()) for i in range(150)] + [(900, "hot", None)]
    right = [(i, key(), at()) for i in range(80)]
    ldf = spark.createDataFrame(left, "l long, k string, lt timestamp_ntz")
    rdf = spark.createDataFrame(right, "r long, k string, rt timestamp_ntz")
    got = {x.l: (x.rt, x.r) for x in L.first_after(ldf, rdf, ["k"], "lt", "rt", ["r"], slot_seconds=100).collect()}
    want = {}
    for i, k, t in left:
        hits = [(rt, r) for r, rk, rt in right if k is not None and t is not None and rk == k and rt >= t]
        if hits:
            want[i] = min(hits)
    assert got == want and len(got) > 50


def test_interaction_before_the_case_does_not_match(spark):
    left = spark.createDataFrame([(1, "a", T0)], "l long, k string, lt timestamp_ntz")
    right = spark.createDataFrame([(1, "a", T0 - timedelta(hours=1))], "r long, k string, rt timestamp_ntz")
    assert L.first_after(left, right, ["k"], "lt", "rt", ["r"]).count() == 0


def test_starting_milestones_equal_the_join_chain(spark):
    rng = random.Random(3)
    rows = [
        (rng.randrange(20), rng.randrange(3), n, f"m{n % 4}", rng.choice(["Internet", "INTERNET", "tv"]), T0, T0, rng.choice([0, 0, 1]), 0)
        for n in range(200)
    ]
    ms = spark.createDataFrame(rows, "session_id long, flow_id long, event_no long, milestone_name string, process_flow string, start_time timestamp_ntz, calendar_date timestamp_ntz, cnt_interact_sent int, cnt_case_sent int")
    net = L.flow_milestones(ms)
    chain = L.tag_starting(net, L.first_events(L.tag_finished(net, L.finished_flows(net)))).where("starting_milestone = 1")
    direct = L.starting_milestones(net)
    cols = ["session_id", "event_no", "milestone_name"]
    assert sorted(map(tuple, chain.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))


def test_hash_sample_and_dense_index_are_exact(spark):
    df = spark.range(5000)
    for k in (0, 1, 777, 5000, 9000):
        assert hash_sample(df, ["id"], F.lit(k)).count() == min(k, 5000)
    numbers = sorted(r.i for r in dense_index(df, ["id"], "i").collect())
    assert numbers == list(range(1, 5001))


def test_top_by_score_breaks_ties_by_id(spark):
    rows = [(i, 0.9 if i % 3 else 0.5) for i in range(300)]      # two thirds tie
    df = spark.createDataFrame(rows, "id long, s double")
    got = sorted(r.id for r in top_by_score(df, "s", "id", F.lit(50)).collect())
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))][:50]


def test_balancing(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumn("g", F.col("id") % 2)
    for replace in (True, False):
        out = balance(df, "y", ["id"], replace)
        counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
        assert counts == {0: 100, 1: 100}
    assert balance(df, "y", ["id"], False).distinct().count() == 200
    within = balance_within(df, "y", ["id"], ["g"]).groupBy("g", "y").count().collect()
    assert {(r.g, r.y): r["count"] for r in within} == {(0, 0): 100, (0, 1): 100}


def test_drawn_sick_vector_appears_twice(spark):
    vectors = spark.createDataFrame([(i, "2024-01-01", f"m{i}") for i in range(0, 3)], "seq_id long, d string, mac string").withColumn("day_0", F.to_date("d")).drop("d")
    failing = vectors.where("mac = 'm1'").select("day_0", "mac", F.lit("p").alias("milestone_name"))
    draws = spark.range(1, 200).toDF("i")                         # every id is drawn
    out = labelled_sample(vectors, failing, draws)
    assert sorted((r.mac, r.milestone_name or "") for r in out.collect()) == [("m0", ""), ("m1", ""), ("m1", "p"), ("m2", "")]
    assert labelled_sample(vectors, failing, draws, exclude_positives=True).count() == 3


def _account_rows(spark):
    """Details and nodes with a busy account, equal rows, and missing accounts and names."""
    day = datetime(2024, 1, 2).date()
    accounts = ["hot"] * 40 + ["b", None, "c"]
    details = [(i % 30, None if i == 7 else i, i % 3, T0, "Internet", None if i % 9 == 4 else f"p{i % 2}", a, day) for i, a in enumerate(accounts)]
    details = spark.createDataFrame(
        details + details[:2],
        "case_id long, session_id long, emp_id long, case_start_t timestamp_ntz, process_flow string, milestone_name string, cly_account_number string, day_0 date")
    nodes = [("aa:1", "hot", 55), ("aa:2", "hot", 55), ("aa:2", "hot", 55), (None, "hot", 55), ("aa:3", "b", 55), ("aa:4", "b", 1), ("aa:5", None, 55)]
    nodes = spark.createDataFrame(nodes, "node_key string, cly_acct_number string, topo_node_type_id int")
    return details, nodes.withColumns({"src_node_model": F.lit("m"), "src_node_building_id": F.lit("1")})


def _plain_expansion(details, nodes):
    macs = L.node_details(nodes).select("mac", "cly_account_number")
    return details.join(macs, "cly_account_number")


def _counts(df, columns):
    return sorted(map(str, df.groupBy(*columns).count().collect()))


def test_devices_of_accounts_are_the_plain_join_in_many_tasks(spark):
    details, nodes = _account_rows(spark)
    got, want = L.devices_of_accounts(details, nodes), _plain_expansion(details, nodes)
    assert got.columns[:5] == ["case_id", "session_id", "emp_id", "cly_account_number", "mac"]
    assert _counts(got, details.columns + ["mac"]) == _counts(want, details.columns + ["mac"])
    # one busy account is several tasks, although adaptive execution would merge inputs of this size
    assert got.where("cly_account_number = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_devices_of_accounts_are_written_as_runs(spark, tmp_path):
    # the sessions and devices of an account are more than a packed block of either
    details = spark.range(1500).select(
        (F.col("id") * 7919).alias("case_id"), (F.col("id") * 104729).alias("session_id"), (F.col("id") % 3).alias("emp_id"), F.lit(T0).alias("case_start_t"),
        F.lit("Internet").alias("process_flow"), F.lit("p").alias("milestone_name"), (F.col("id") % 2).cast("string").alias("cly_account_number"), F.lit(T0.date()).alias("day_0"))
    nodes = spark.range(3000).select(
        F.concat(F.lit("aa:"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("node_key"), (F.col("id") % 2).cast("string").alias("cly_acct_number"),
        F.lit(55).alias("topo_node_type_id"), F.lit("m").alias("src_node_model"), F.lit("1").alias("src_node_building_id"))
    L.devices_of_accounts(details, nodes).write.parquet(str(tmp_path / "got"))
    got = spark.read.parquet(str(tmp_path / "got"))
    assert got.count() == got.distinct().count() == 2 * 750 * 1500
    assert got.join(details, details.columns, "left_anti").isEmpty()
    # a detail comes with a block of devices, the next one with the same block
    runs, again = [], 0
    for file in (tmp_path / "got").glob("*.parquet"):
        for _, rows in groupby(pq.read_table(file, columns=["case_id", "mac"]).to_pylist(), lambda r: r["case_id"]):
            runs.append([r["mac"] for r in rows])
            again += len(runs) > 1 and runs[-1] == runs[-2]
    assert max(map(len, runs)) <= 504
    assert len(runs) < 2 * 750 * 1500 / 100 and again > 0.9 * len(runs)


def test_confirming_before_expanding_gives_the_same_rows(spark):
    details, nodes = _account_rows(spark)
    success = details.select("day_0", "session_id").distinct().where("session_id % 2 = 0").withColumns({"flg_ftr_0d_flg": F.lit(0), "flg_ftr_7d_flg": F.lit(1)})
    got = L.devices_of_accounts(L.confirmed_devices(details, success), nodes)
    want = L.confirmed_devices(L.devices_of_accounts(details, nodes), success)
    assert got.columns == want.columns and _counts(got, got.columns) == _counts(want, got.columns)


def test_labelled_vectors_keep_every_match(spark):
    details, nodes = _account_rows(spark)
    vectors = spark.createDataFrame([("AA1", T0.date(), 1), ("AA2", T0.date(), 2), ("AA2", T0.date(), 3), ("AA9", T0.date(), 4), (None, T0.date(), 5)], "mac string, day_0 date, seq_id long")
    got = labelled_vectors(vectors, details, nodes)
    want = vectors.join(_plain_expansion(details, nodes).select("mac", "day_0", "milestone_name"), ["mac", "day_0"])
    columns = ["mac", "day_0", "seq_id", "milestone_name"]
    assert got.columns == columns and _counts(got, columns) == _counts(want, columns)
    # counted: a row a device, day and name, however many sessions
    assert L.device_labels(details, nodes).where("mac = 'AA1'").count() == 3
