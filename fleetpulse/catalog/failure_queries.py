"""Label derivation, sampling, rolling state, sinks and run control."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.catalog.inputs import DAY, Inputs
from fleetpulse.catalog.registry import query
from fleetpulse.catalog.sql_views import MODEL_CASE
from fleetpulse.functions.scalars import hash_unit, stable_hash
from fleetpulse.functions.series import series, series_table
from fleetpulse.operators import checks, labels as L
from fleetpulse.operators.windows import day_differences_by_pivot
from fleetpulse.plans.failures import failing_devices, labelled_sample, labelled_vectors, random_ids
from fleetpulse.session import new_table_path
from fleetpulse.sources import sinks
from fleetpulse.sources.tables import interactions_of_day, keep_labelled_days, normalise_sample, read_sample

D0 = f"DATE '{DAY}'"
INTERNET = "SELECT *, CAST(calendar_date AS DATE) AS m_day FROM milestones WHERE upper(process_flow) = 'INTERNET'"
MILESTONE_COLS = (
    "session_id, flow_id, event_no, milestone_name, process_flow, start_time, calendar_date, cnt_interact_sent, cnt_case_sent, m_day"
)
NO_NAME = "CAST(NULL AS VARCHAR)"


def internet(t: Inputs) -> DataFrame:
    return L.flow_milestones(t.milestones)


# ---- label derivation -----------------------------------------------------------------------


@query("src6_milestones_of_day", f"SELECT {MILESTONE_COLS} FROM ({INTERNET}) WHERE m_day = {D0}")
def _(t: Inputs) -> DataFrame:
    return L.flow_milestones(t.milestones, day=DAY)


@query("src7_interactions_of_day", f"SELECT interaction_id, account_number, create_date, emp_id, flg_ftr_0d_flg, flg_ftr_7d_flg FROM interactions WHERE CAST(create_date AS DATE) = {D0}")
def _(t: Inputs) -> DataFrame:
    return interactions_of_day(t.interactions, DAY)


@query("src7_sessions", "SELECT journal_id AS session_id, emp_id, case_id FROM sessions")
def _(t: Inputs) -> DataFrame:
    return t.sessions.select(F.col("journal_id").alias("session_id"), "emp_id", "case_id")


@query("src7_cases", "SELECT id AS case_id, customer_id, duration AS case_duration, start_time AS case_start_t FROM cases")
def _(t: Inputs) -> DataFrame:
    return t.cases.select(
        F.col("id").alias("case_id"), "customer_id", F.col("duration").alias("case_duration"), F.col("start_time").alias("case_start_t")
    )


@query("flt6_finished_flows", "SELECT m_day, session_id, flow_id, 'FULL' AS tag FROM full_flows")
def _(t: Inputs) -> DataFrame:
    return L.finished_flows(internet(t))


_TAGGED = f"""SELECT f.tag, m.* FROM ({INTERNET}) m FULL OUTER JOIN (SELECT *, 'FULL' AS tag FROM full_flows) f
 ON f.m_day = m.m_day AND f.session_id = m.session_id AND f.flow_id = m.flow_id"""


@query("jn9_tagged_flows", f"SELECT tag, {MILESTONE_COLS} FROM ({_TAGGED})")
def _(t: Inputs) -> DataFrame:
    return L.tag_finished(internet(t), L.finished_flows(internet(t)))


_FIRSTS = f"SELECT m_day, session_id, min(event_no) AS event_no_milestone, 1 AS starting_milestone FROM ({_TAGGED}) WHERE tag = 'FULL' GROUP BY 1, 2"


def _firsts(t: Inputs) -> DataFrame:
    return L.first_events(L.tag_finished(internet(t), L.finished_flows(internet(t))))


@query("agg11_first_events", _FIRSTS)
def _(t: Inputs) -> DataFrame:
    return _firsts(t)


_STARTING = f"""SELECT f.starting_milestone, m.* FROM ({INTERNET}) m FULL OUTER JOIN ({_FIRSTS}) f
 ON f.m_day = m.m_day AND f.session_id = m.session_id AND f.event_no_milestone = m.event_no"""


@query("jn10_tagged_milestones", f"SELECT starting_milestone, {MILESTONE_COLS} FROM ({_STARTING})")
def _(t: Inputs) -> DataFrame:
    return L.tag_starting(internet(t), _firsts(t))


@query("srt1_milestones_in_order", f"SELECT starting_milestone, {MILESTONE_COLS} FROM ({_STARTING}) ORDER BY session_id, event_no")
def _(t: Inputs) -> DataFrame:
    return L.tag_starting(internet(t), _firsts(t)).orderBy("session_id", "event_no")


@query("flt7_starting_milestones", "SELECT m_day, session_id, event_no, milestone_name, process_flow, milestone_start_t FROM first_milestones")
def _(t: Inputs) -> DataFrame:
    return L.starting_milestones(internet(t))


def _details(t: Inputs) -> DataFrame:
    return L.session_details(L.starting_milestones(internet(t)), t.sessions, t.cases)


@query("jn11_session_details", "SELECT * FROM via_details")
def _(t: Inputs) -> DataFrame:
    return _details(t)


@query("flt8_known_match_keys", "SELECT session_id, case_id FROM via_details WHERE emp_id IS NOT NULL AND case_start_t IS NOT NULL AND cly_account_number IS NOT NULL")
def _(t: Inputs) -> DataFrame:
    return _details(t).dropna(subset=["emp_id", "case_start_t", "cly_account_number"]).select("session_id", "case_id")


@query("jn12_first_interaction_after_case", """SELECT * EXCLUDE (rn) FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, case_id, day_0 ORDER BY create_date, interaction_id) AS rn FROM tentative) WHERE rn = 1""")
def _(t: Inputs) -> DataFrame:
    return L.match_interactions(_details(t), t.interactions)


@query("win3_session_success", "SELECT day_0, session_id, flg_ftr_0d_flg, flg_ftr_7d_flg FROM session_flags")
def _(t: Inputs) -> DataFrame:
    return L.session_success(L.match_interactions(_details(t), t.interactions))


@query("jn13_devices_of_accounts", """SELECT v.case_id, v.session_id, v.emp_id, v.cly_account_number, h.mac, v.case_start_t, v.process_flow,
 v.milestone_name, v.day_0 FROM via_details v JOIN hw_info h ON h.cly_account_number = v.cly_account_number""")
def _(t: Inputs) -> DataFrame:
    return L.devices_of_accounts(_details(t), t.topo_nodes)


@query("jn14_devices_with_flags", """SELECT v.case_id, v.session_id, h.mac, v.day_0, f.flg_ftr_7d_flg, f.flg_ftr_0d_flg FROM via_details v
 JOIN hw_info h ON h.cly_account_number = v.cly_account_number
 JOIN session_flags f ON f.day_0 = v.day_0 AND f.session_id = v.session_id""")
def _(t: Inputs) -> DataFrame:
    success = L.session_success(L.match_interactions(_details(t), t.interactions))
    flagged = L.devices_of_accounts(L.confirmed_devices(_details(t), success), t.topo_nodes)
    return flagged.select("case_id", "session_id", "mac", "day_0", "flg_ftr_7d_flg", "flg_ftr_0d_flg")


@query("composite7_failing_devices", "SELECT * FROM via_macs")
def _(t: Inputs) -> DataFrame:
    return failing_devices(t.milestones, t.sessions, t.cases, t.interactions, t.topo_nodes)


# ---- sampling -------------------------------------------------------------------------------

KEYED = "SELECT seq_id, day_0, mac, offline_pct FROM device_day"
N_DRAWS = 500
_UNIT = "CAST(('0x' || substr(md5('{seed}:' || CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT)"
DRAWS = f"""SELECT DISTINCT CAST(floor({_UNIT.format(seed=0, x='i')} / 4294967296.0::DOUBLE * (SELECT max(seq_id) FROM device_day) + 0.5) AS BIGINT) AS seq_id
 FROM range(1, {N_DRAWS + 1}) t(i)"""
VIA = "SELECT day_0, mac, milestone_name FROM device_day WHERE milestone_name IS NOT NULL"


def _vectors(t: Inputs) -> DataFrame:
    return t.device_day.select("seq_id", "day_0", "mac", "offline_pct")


def _failing(t: Inputs) -> DataFrame:
    return t.device_day.where("milestone_name IS NOT NULL").select("day_0", "mac", "milestone_name")


def _draws(t: Inputs) -> DataFrame:
    return series_table(t.spark, 1, N_DRAWS, 1, "i")


@query("smp1_random_ids", DRAWS)
def _(t: Inputs) -> DataFrame:
    return random_ids(_draws(t), t.device_day.agg(F.max("seq_id")).scalar())


@query("set2_distinct_drawn_ids", f"SELECT seq_id FROM (SELECT seq_id FROM ({DRAWS}) UNION ALL SELECT seq_id FROM device_day WHERE day_0 = {D0}) GROUP BY seq_id")
def _(t: Inputs) -> DataFrame:
    today = t.device_day.where(F.col("day_0") == F.lit(DAY)).select("seq_id")
    return random_ids(_draws(t), t.device_day.agg(F.max("seq_id")).scalar()).unionAll(today).dropDuplicates(["seq_id"])


@query("fn20_uniform_numbers", f"SELECT event_id, {_UNIT.format(seed=7, x='event_id')} / 4294967296.0::DOUBLE AS u FROM events", ["u"], 9)
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", hash_unit(stable_hash("event_id", seed=7)).alias("u"))


@query("jn16_drawn_vectors", f"SELECT * FROM ({KEYED}) WHERE seq_id IN (SELECT seq_id FROM ({DRAWS}))", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    v = _vectors(t)
    return v.join(random_ids(_draws(t), v.agg(F.max("seq_id")).scalar()), "seq_id", "left_semi")


@query("jn15_labelled_vectors", "SELECT f.mac, f.day_0, f.seq_id, v.milestone_name FROM five_day f JOIN via_macs v ON v.mac = f.mac AND v.day_0 = f.day_0")
def _(t: Inputs) -> DataFrame:
    return labelled_vectors(t.five_day.select("mac", "day_0", "seq_id"), t.via_sessions, t.topo_nodes)


SAMPLE = f"""SELECT *, {NO_NAME} AS milestone_name FROM ({KEYED}) WHERE seq_id IN (SELECT seq_id FROM ({DRAWS}))
 UNION SELECT k.*, v.milestone_name FROM ({KEYED}) k JOIN ({VIA}) v ON v.day_0 = k.day_0 AND v.mac = k.mac"""


@query("set1_sample_union", SAMPLE, ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    return labelled_sample(_vectors(t), _failing(t), _draws(t))


@query("composite9_labelled_sample", f"""SELECT * FROM ({SAMPLE}) s WHERE milestone_name IS NOT NULL
 OR NOT EXISTS (SELECT 1 FROM ({VIA}) v WHERE v.day_0 = s.day_0 AND v.mac = s.mac)""", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    return labelled_sample(_vectors(t), _failing(t), _draws(t), exclude_positives=True)


@query("udtf1_integer_series", "SELECT o_orderkey, unnest(generate_series(1, 1 + o_custkey % 50, 1 + o_orderkey % 5)) AS n FROM orders")
def _(t: Inputs) -> DataFrame:
    stop, step = 1 + F.col("o_custkey") % 50, 1 + F.col("o_orderkey") % 5
    return t.table("orders").select("o_orderkey", F.explode(series(F.lit(1).cast("long"), stop, step)).alias("n"))


# ---- imports and sinks ----------------------------------------------------------------------

_RAW = "SELECT mac AS MAC, strftime(day_0, '%d/%m/%Y') AS DAY_0, hardware_model AS HARDWARE_MODEL, milestone_name AS MILESTONE_NAME, offline_pct AS OFFLINE_PCT FROM device_day"


def _raw(t: Inputs) -> DataFrame:
    return t.device_day.select(
        F.col("mac").alias("MAC"), F.date_format("day_0", "dd/MM/yyyy").alias("DAY_0"),
        F.col("hardware_model").alias("HARDWARE_MODEL"), F.col("milestone_name").alias("MILESTONE_NAME"),
        F.col("offline_pct").alias("OFFLINE_PCT"),
    )


_SAMPLE = f"""SELECT CAST(isodow(day_0) - 1 AS INTEGER) AS weekday, mac, day_0, {MODEL_CASE} AS hardware_model, milestone_name, offline_pct
 FROM device_day WHERE day_0 IN (SELECT day_0 FROM device_day WHERE milestone_name IS NOT NULL)"""


@query("src9_imported_sample", _SAMPLE, ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    return normalise_sample(_raw(t))


@query("src9_imported_csv", _SAMPLE, ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "sample-csv")
    raw = _raw(t)
    raw.write.option("header", True).csv(path)
    return read_sample(t.spark, path, raw.schema)


@query("flt9_labelled_days", "SELECT mac, day_0 FROM device_day WHERE day_0 IN (SELECT day_0 FROM device_day WHERE milestone_name IS NOT NULL)")
def _(t: Inputs) -> DataFrame:
    return keep_labelled_days(t.device_day).select("mac", "day_0")


@query("snk1_appended_days", "SELECT mac, day_0, offline_pct FROM device_day", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "append")
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    sinks.append(rows.where(F.col("day_0") < F.lit(DAY)), path)
    sinks.append(rows.where(F.col("day_0") >= F.lit(DAY)), path)
    return t.spark.read.parquet(path)


@query("snk2_overwritten_table", f"SELECT mac, day_0, offline_pct FROM device_day WHERE day_0 >= {D0}", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "overwrite")
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    sinks.overwrite(rows, path)
    sinks.overwrite(rows.where(F.col("day_0") >= F.lit(DAY)), path)
    return t.spark.read.parquet(path)


@query("snk2_overwritten_days", "SELECT mac, day_0, CASE WHEN day_0 = " + D0 + " THEN 0.0::DOUBLE ELSE offline_pct END AS offline_pct FROM device_day", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "days")
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    sinks.overwrite_days(rows, path)
    sinks.overwrite_days(rows.where(F.col("day_0") == F.lit(DAY)).withColumn("offline_pct", F.lit(0.0)), path)
    return t.spark.read.parquet(path)


@query("snk3_two_day_buffer", f"SELECT mac, day_0 FROM device_day WHERE day_0 > {D0} - 2 AND day_0 <= {D0}")
def _(t: Inputs) -> DataFrame:
    rows = t.device_day.select("mac", "day_0")
    old = rows.where(F.col("day_0") < F.lit(DAY))
    return sinks.roll(old, rows.where(F.col("day_0") == F.lit(DAY)), DAY, 2)


@query("snk3_five_day_buffer", f"SELECT mac, day_0 FROM device_day WHERE day_0 > {D0} - 5 AND day_0 <= {D0}")
def _(t: Inputs) -> DataFrame:
    rows = t.device_day.select("mac", "day_0")
    old = rows.where(F.col("day_0") < F.lit(DAY))
    return sinks.roll(old, rows.where(F.col("day_0") == F.lit(DAY)), DAY, 5)


@query("snk4_drained_log", "SELECT is_error, log_text, is_done, 0 AS left_behind FROM run_log")
def _(t: Inputs) -> DataFrame:
    source, target = new_table_path(t.spark, "log-source"), new_table_path(t.spark, "log-target")
    sinks.overwrite(t.run_log, source)
    sinks.drain(t.spark, source, target)
    left = t.spark.read.schema(S.RUN_LOG).parquet(source).agg(F.count("*").cast("int").alias("n")).scalar()
    return t.spark.read.schema(S.RUN_LOG).parquet(target).select("is_error", "log_text", "is_done", left.alias("left_behind"))


@query("snk5_run_log_lines", "SELECT 0 AS is_error, CAST(day_0 AS VARCHAR) || ': ' || CAST(count(*) AS VARCHAR) || ' rows inserted' AS log_text, 0 AS is_done FROM device_day GROUP BY day_0")
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "run-log")
    lines = t.device_day.groupBy("day_0").agg(F.count("*").alias("n")).select(
        F.concat(F.col("day_0").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" rows inserted")).alias("log_text"),
        F.lit(0).alias("is_error"), F.lit(0).alias("is_done"),
    )
    sinks.log_lines(lines, path)
    return t.spark.read.schema(S.RUN_LOG).parquet(path).select("is_error", "log_text", "is_done")


@query("snk6_empty_clone", f"SELECT mac, day_0, offline_pct FROM device_day WHERE day_0 = {D0}", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    # the clone is created from the query's schema and then takes a day of its rows
    path = new_table_path(t.spark, "clone")
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    sinks.overwrite(sinks.empty_like(rows), path)
    rows.where(F.col("day_0") == F.lit(DAY)).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


# ---- run control ----------------------------------------------------------------------------


@query("dq1_step_row_counts", """SELECT 'health' AS step, count(*) AS n_rows, count(*) > 0 AS ok FROM health_hour
 UNION ALL SELECT 'milestones', count(*), true FROM milestones""")
def _(t: Inputs) -> DataFrame:
    return checks.row_counts({"health": (t.health_hour, True), "milestones": (t.milestones, False)})


@query("dq2_buffer_state", f"SELECT 'daily' AS buffer, max(day_0) AS max_day, max(day_0) = {D0} AS ok FROM device_day WHERE day_0 <= {D0}")
def _(t: Inputs) -> DataFrame:
    return checks.buffer_state({"daily": t.device_day.where(F.col("day_0") <= F.lit(DAY))}, DAY)


@query("dq3_day_absent", f"SELECT count(*) AS n_rows, count(*) = 0 AS ok FROM device_day WHERE day_0 = {D0}")
def _(t: Inputs) -> DataFrame:
    return checks.day_absent(t.device_day, DAY)


@query("dq4_days_valid", f"""SELECT 'day_in_history' AS "check", {D0} BETWEEN min(CAST(hour_stamp AS DATE)) AND max(CAST(hour_stamp AS DATE)) AS ok FROM health_hour
 UNION ALL SELECT 'label_day_aged', true""")
def _(t: Inputs) -> DataFrame:
    return checks.days_valid(t.health_hour, "hour_stamp", DAY, DAY - timedelta(days=9), DAY)


@query("dq5_rows_grew", f"SELECT count(*) AS inserted, count(*) > 0 AS ok FROM device_day WHERE day_0 = {D0}")
def _(t: Inputs) -> DataFrame:
    day = F.col("day_0")
    return checks.grew(t.device_day.where(day < F.lit(DAY)), t.device_day.where(day <= F.lit(DAY)))


@query("dq1_written_row_counts", f"""SELECT 'days' AS step, count(*) AS n_rows, count(*) > 0 AS ok FROM device_day
 UNION ALL SELECT 'later', count(*), true FROM device_day WHERE day_0 > {D0} + 3650""")
def _(t: Inputs) -> DataFrame:
    # counted by the tasks that write, in place of a counting job per step; the second step may be empty
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    later = rows.where(F.col("day_0") > F.lit(DAY + timedelta(days=3650)))
    steps = {"days": (rows, True), "later": (later, False)}
    written = {n: (sinks.counted(sinks.overwrite_days, df, new_table_path(t.spark, n))["n_rows"], needed) for n, (df, needed) in steps.items()}
    return checks.written_rows(t.spark, written)


@query("dq5_inserted_rows", f"SELECT count(*) AS inserted, count(*) > 0 AS ok FROM device_day WHERE day_0 = {D0}")
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "inserted")
    rows = t.device_day.select("mac", "day_0", "offline_pct")
    sinks.append(rows.where(F.col("day_0") < F.lit(DAY)), path)
    return checks.inserted(t.spark, sinks.counted(sinks.append, rows.where(F.col("day_0") == F.lit(DAY)), path)["n_rows"])


@query("dq6_log_clean", "SELECT CAST(sum(is_error) AS BIGINT) AS errors, sum(is_error) = 0 AS ok FROM run_log")
def _(t: Inputs) -> DataFrame:
    return checks.log_clean(t.run_log)


@query("dq6_last_run_done", "SELECT is_done AS last_done, is_done = 1 AS ok FROM run_log ORDER BY log_date DESC LIMIT 1")
def _(t: Inputs) -> DataFrame:
    return checks.last_run_done(t.run_log)


@query("dq7_identical_columns", """SELECT count(CASE WHEN disc = disc_known THEN NULL ELSE 1 END) AS n_different,
 count(CASE WHEN disc = disc_known THEN NULL ELSE 1 END) = 0 AS ok FROM wide""")
def _(t: Inputs) -> DataFrame:
    return checks.columns_identical(t.wide, "disc", "disc_known")


@query("dq8_targets_absent", f"SELECT day_0, day_0 >= {D0} AS ok FROM (SELECT DISTINCT day_0 FROM device_day)")
def _(t: Inputs) -> DataFrame:
    # an initialisation found half done: the earlier days have their target already
    path = new_table_path(t.spark, "targets")
    rows = t.device_day.select("mac", "day_0")
    sinks.append(rows.where(F.col("day_0") < F.lit(DAY)), path)
    return checks.targets_absent(rows, sinks.partition_days(t.spark, path))


@query("srt2_ordered_log", "SELECT log_text, is_error FROM run_log ORDER BY log_date, log_text")
def _(t: Inputs) -> DataFrame:
    return t.run_log.orderBy("log_date", "log_text").select("log_text", "is_error")


@query("composite10_backfilled_days", f"""SELECT mac, day_0, {', '.join(S.DAILY_MEASURES)} FROM daily_diffs
 WHERE day_0 BETWEEN {D0} - 4 AND {D0}""", S.DAILY_MEASURES)
def _(t: Inputs) -> DataFrame:
    # the daily step of each day over the stored two-day buffer, as a back-fill primes it
    path = new_table_path(t.spark, "backfill")
    sinks.overwrite_days(t.daily_avg, f"{path}/daily")
    daily = t.spark.read.parquet(f"{path}/daily")
    for back in range(4, -1, -1):
        day: date = DAY - timedelta(days=back)
        sinks.overwrite_days(day_differences_by_pivot(daily, day), f"{path}/diffs")
    return t.spark.read.parquet(f"{path}/diffs").select("mac", "day_0", *S.DAILY_MEASURES)
