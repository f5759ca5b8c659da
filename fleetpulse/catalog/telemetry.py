"""Scans, projections, windows, groups and the telemetry composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetpulse import schemas as S
from fleetpulse.catalog.inputs import DAY, ORDER_DAY, Inputs
from fleetpulse.catalog.registry import query
from fleetpulse.catalog.sql_views import DOWN_PATTERN, MODEL_CASE, UP_PATTERN, WINDOW
from fleetpulse.functions import scalars as fn
from fleetpulse.operators import groups as G
from fleetpulse.operators import windows as WN
from fleetpulse.operators.prep import with_suffixes
from fleetpulse.plans import devices as PD
from fleetpulse.plans import interface as PI
from fleetpulse.plans import vectors as PV
from fleetpulse.sources import tables as T

DEV = list(S.DEVICE_MEASURES)
UP = list(S.UPSTREAM_MEASURES)
DOWN = list(S.DOWNSTREAM_MEASURES)
D0 = f"DATE '{DAY}'"
DEVICE_COLS = [c for n in PD.STATS.values() for c in S.windowed(n)]
INTERFACE_COLS = [c for n in S.INTERFACE_DAILY for c in S.windowed(n)]
DOWN_COLS = [c for n in S.DOWNSTREAM_MEASURES.values() for c in S.windowed(n)]
UP_COLS = [c for n in S.UPSTREAM_MEASURES.values() for c in S.windowed(n)]
FEATURES = S.feature_columns()


def q(cols: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in cols)


# ---- scans ----------------------------------------------------------------------------------


@query("src1_downstream_day", f"SELECT cmts_name, downstream_name, hour, {q(DOWN)} FROM ifc_down_hour WHERE CAST(hour AS DATE) = {D0}", DOWN)
def _(t: Inputs) -> DataFrame:
    return T.downstream_hours(t.ifc_down_hour, DAY)


@query("src2_upstream_day", f"SELECT cmts_name, upstream_name, hour, {q(UP)} FROM ifc_up_hour WHERE CAST(hour AS DATE) = {D0}", UP)
def _(t: Inputs) -> DataFrame:
    return T.upstream_hours(t.ifc_up_hour, DAY)


@query("src3_health_history", f"SELECT mac, account_number, hour_stamp, cm_status, {q(DEV)} FROM health_hour", DEV)
def _(t: Inputs) -> DataFrame:
    return T.health_hours(t.health_hour)


@query("src4_device_nodes", "SELECT mac, hardware_model, building_id, cly_account_number FROM hw_info")
def _(t: Inputs) -> DataFrame:
    return G.node_details(t.topo_nodes)


@query("src5_interface_groups", "SELECT cmts_name, service_group_name AS service_group, ifc_descr FROM ifc_to_group")
def _(t: Inputs) -> DataFrame:
    return T.interface_groups(t.ifc_to_group)


@query("src8_second_catalog_read", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t: Inputs) -> DataFrame:
    schema = StructType.fromDDL("o_orderkey long, o_custkey long, o_totalprice double")
    return T.read_table(t.spark, f"{t.sf_dir}/orders.parquet", schema)


# ---- projections and filters ----------------------------------------------------------------


@query("prj1_constant_and_renamed", f"SELECT DISTINCT mac, 1 AS flg_outlier, {D0} AS day_0 FROM outlier_macs")
def _(t: Inputs) -> DataFrame:
    static = G.device_static(t.topo_nodes, t.group_history)
    found = PD.outlier_devices(t.health_hour, static)
    return found.select("mac", F.lit(1).alias("flg_outlier"), F.lit(DAY).alias("day_0"))


@query("prj2_prepended_star", "SELECT 'FULL' AS tag, m.* FROM interactions m")
def _(t: Inputs) -> DataFrame:
    return t.interactions.select(F.lit("FULL").alias("tag"), "*")


_CHANGES = [f"{m}_{h}" for m in S.DIFF_MEASURES for h in ["6h", "12h", "18h"]]
_LEVELS = [f"{m}_{h}" for m in S.LEVEL_MEASURES for h in ["6h", "12h", "18h", "24h"]]


@query("prj3_window_changes", f"SELECT mac, day_0, {q(_CHANGES)} FROM five_day", _CHANGES)
def _(t: Inputs) -> DataFrame:
    return t.vector_1d.select("mac", "day_0", *[c for m in S.DIFF_MEASURES for c in WN.window_changes(m)])


@query("prj4_window_levels", f"SELECT mac, day_0, {q(_LEVELS)} FROM five_day", _LEVELS)
def _(t: Inputs) -> DataFrame:
    return t.vector_1d.select("mac", "day_0", *[c for m in S.LEVEL_MEASURES for c in WN.window_levels(m)])


_LATE = [f for f in FEATURES if f.endswith(("1d", "2d"))]


@query("prj7_short_history_columns", f"SELECT mac, day_0, {q(_LATE)} FROM five_day", _LATE)
def _(t: Inputs) -> DataFrame:
    return with_suffixes(PV.five_day_history(t.vector_1d), ["1d", "2d"], keep=["mac", "day_0"])


@query("flt1_rows_of_a_day", f"SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = {D0}")
def _(t: Inputs) -> DataFrame:
    return t.events.where(fn.on_day("ts", DAY)).select("event_id", "ts")


@query("flt2_supported_models", "SELECT mac, hardware_model FROM hw_info WHERE hardware_model <> 'SLEEPING BOX'")
def _(t: Inputs) -> DataFrame:
    d = G.node_details(t.topo_nodes)
    return d.where(F.col("hardware_model").isin(*S.MODEL_IDS)).select("mac", "hardware_model")


@query("flt3_offline_hours", "SELECT mac, hour_stamp FROM health_hour WHERE cm_status <> 8")
def _(t: Inputs) -> DataFrame:
    return G.offline_hours(t.health_hour)


_ORDER_SPANS = """SELECT cmts, service_group, upper(replace(mac, ':', '')) AS mac, min(modemloss_valid_from) AS v_from,
 max(modemloss_valid_to) AS v_to FROM order_history GROUP BY ALL"""


@query("flt4_span_contains_day", f"SELECT * FROM ({_ORDER_SPANS}) WHERE CAST(v_from AS DATE) <= DATE '{ORDER_DAY}' AND CAST(v_to AS DATE) >= DATE '{ORDER_DAY}'")
def _(t: Inputs) -> DataFrame:
    return G.valid_on(G.merged_validity(t.order_history), ORDER_DAY)


@query("flt5_any_hour_beyond_cut", "SELECT DISTINCT p.mac FROM offline_population p JOIN (SELECT hardware_model, " + ", ".join(
    f"quantile_disc(\"{h}_unavailable\", 0.8) AS c{h}" for h in range(24)) + " FROM offline_population GROUP BY hardware_model) c"
    " ON p.hardware_model = c.hardware_model WHERE " + " OR ".join(f"\"{h}_unavailable\" > c{h}" for h in range(24)))
def _(t: Inputs) -> DataFrame:
    # strictly above a lower cut, so that devices fall on both sides
    static = G.device_static(t.topo_nodes, t.group_history)
    return PD.outlier_devices(t.health_hour, static, percentile=0.8, strict=True)


@query("flt12_weekend_rows", "SELECT mac, day_0, offline_pct FROM device_day WHERE isodow(day_0) >= 6", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    return t.device_day.where(F.weekday("day_0") >= 5).select("mac", "day_0", "offline_pct")


@query("flt13_complete_cases", "SELECT qty, disc_known, tax_known, line FROM wide WHERE disc_known IS NOT NULL AND tax_known IS NOT NULL")
def _(t: Inputs) -> DataFrame:
    return t.wide.dropna(subset=["disc_known", "tax_known"]).select("qty", "disc_known", "tax_known", "line")


# ---- scalar functions -----------------------------------------------------------------------


@query("fn1_downstream_interface", f"SELECT DISTINCT downstream_name, nullif(regexp_extract(downstream_name, '{DOWN_PATTERN}'), '') AS ifc_descr FROM ifc_down_hour")
def _(t: Inputs) -> DataFrame:
    return t.ifc_down_hour.select("downstream_name", fn.downstream_interface("downstream_name").alias("ifc_descr")).distinct()


@query("fn2_upstream_interface", f"SELECT DISTINCT upstream_name, nullif(regexp_extract(upstream_name, '{UP_PATTERN}'), '') AS ifc_descr FROM ifc_up_hour")
def _(t: Inputs) -> DataFrame:
    return t.ifc_up_hour.select("upstream_name", fn.upstream_interface("upstream_name").alias("ifc_descr")).distinct()


@query("fn3_normal_mac", "SELECT node_key, upper(replace(node_key, ':', '')) AS mac FROM topo_nodes")
def _(t: Inputs) -> DataFrame:
    return t.topo_nodes.select("node_key", fn.normal_mac("node_key").alias("mac"))


@query("fn4_day_of_timestamp", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", F.to_date("ts").alias("d"))


@query("fn5_hour_and_day_of_month", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(day(ts) AS INTEGER) AS d FROM events")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", F.hour("ts").alias("h"), F.dayofmonth("ts").alias("d"))


@query("fn6_six_hour_window", f"SELECT event_id, {WINDOW.format('ts')} AS w FROM events")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", fn.six_hour_window("ts").alias("w"))


@query("fn7_day_offset", f"""SELECT event_id, CAST(CASE WHEN {D0} - CAST(ts AS DATE) BETWEEN 0 AND 4
 THEN {D0} - CAST(ts AS DATE) END AS INTEGER) AS d FROM events""")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", fn.day_offset(F.to_date("ts"), DAY, 4).alias("d"))


@query("fn8_weekday", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", F.weekday("ts").alias("weekday"))


@query("fn9_model_ids", f"SELECT mac, {MODEL_CASE} AS model FROM hw_info")
def _(t: Inputs) -> DataFrame:
    return G.node_details(t.topo_nodes).select("mac", fn.mapped("hardware_model", S.MODEL_IDS).alias("model"))


@query("fn10_first_known", "SELECT mac, hour_stamp, coalesce(txpower_up, rxpower_up, snr_dn, 0.0::DOUBLE) AS x FROM health_hour", ["x"])
def _(t: Inputs) -> DataFrame:
    return t.health_hour.select("mac", "hour_stamp", F.coalesce("txpower_up", "rxpower_up", "snr_dn", F.lit(0.0)).alias("x"))


@query("fn11_guarded_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_tax / l_discount END AS ratio FROM lineitem", ["ratio"])
def _(t: Inputs) -> DataFrame:
    return t.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.guarded_ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"))


@query("fn12_shifted_day", "SELECT event_id, CAST(ts AS DATE) - 8 AS via_day, CAST(ts AS DATE) + 1 AS next_day FROM events")
def _(t: Inputs) -> DataFrame:
    d = F.to_date("ts")
    return t.events.select("event_id", F.date_sub(d, 8).alias("via_day"), F.date_add(d, 1).alias("next_day"))


@query("fn13_day_text", "SELECT event_id, strftime(ts, '%d/%m/%Y') AS day_text FROM events")
def _(t: Inputs) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day_text"))


@query("fn14_padded_text", """SELECT o_orderkey, substr(rpad(o_orderpriority, 20, '.') || lpad(o_orderstatus, 5, ' ') || ' done', 1, 27) AS line
 FROM orders""")
def _(t: Inputs) -> DataFrame:
    line = F.concat(F.rpad("o_orderpriority", 20, "."), F.lpad("o_orderstatus", 5, " "), F.lit(" done"))
    return t.table("orders").select("o_orderkey", F.substring(line, 1, 27).alias("line"))


@query("fn15_numbers", """SELECT c_custkey, CAST(round(c_acctbal / 7) AS BIGINT) AS r, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS INTEGER) AS s,
 CAST(trunc(c_acctbal) AS BIGINT) AS t FROM customer""", ["a"])
def _(t: Inputs) -> DataFrame:
    x = F.col("c_acctbal")
    return t.table("customer").select(
        "c_custkey", F.round(x / 7).cast("long").alias("r"), F.abs(x).alias("a"), F.signum(x).cast("int").alias("s"), x.cast("long").alias("t")
    )


@query("fn16_binary_label", "SELECT mac, day_0, CASE WHEN milestone_name IS NULL THEN 0 ELSE 1 END AS label FROM device_day")
def _(t: Inputs) -> DataFrame:
    return t.device_day.select("mac", "day_0", fn.binary_label("milestone_name").alias("label"))


@query("fn17_kind_label", """SELECT mac, day_0, CASE WHEN milestone_name IN ('internet.noconnection.start', 'internet.interruption.start',
 'internet.performance.start') THEN 1 ELSE 0 END AS label FROM device_day""")
def _(t: Inputs) -> DataFrame:
    return t.device_day.select("mac", "day_0", fn.kind_label("milestone_name").alias("label"))


# ---- joins ----------------------------------------------------------------------------------


def _down_rows(t: Inputs) -> DataFrame:
    return PI.extracted(T.downstream_hours(t.ifc_down_hour), fn.downstream_interface("downstream_name"), S.DOWNSTREAM_MEASURES)


def _up_rows(t: Inputs) -> DataFrame:
    return PI.extracted(T.upstream_hours(t.ifc_up_hour), fn.upstream_interface("upstream_name"), S.UPSTREAM_MEASURES)


_DOWN_ROWS = f"""SELECT cmts_name, nullif(regexp_extract(downstream_name, '{DOWN_PATTERN}'), '') AS ifc_descr,
 CAST(hour AS DATE) AS day_0, {WINDOW.format('hour')} AS hour_window, {q(DOWN)} FROM ifc_down_hour"""
_UP_ROWS = f"""SELECT cmts_name, nullif(regexp_extract(upstream_name, '{UP_PATTERN}'), '') AS ifc_descr,
 CAST(hour AS DATE) AS day_0, {WINDOW.format('hour')} AS hour_window, {q(UP)} FROM ifc_up_hour"""


def _avg_sql(rows: str, measures: list[str]) -> str:
    return f"SELECT cmts_name, ifc_descr, day_0, hour_window, {', '.join(f'avg({m}) AS {m}' for m in measures)} FROM ({rows}) GROUP BY 1, 2, 3, 4"


def _pivot_sql(rows: str, measures: dict[str, str]) -> str:
    cols = ", ".join(f"max(CASE WHEN hour_window = {w} THEN {m} END) AS \"{w}_{n}\"" for m, n in measures.items() for w in S.WINDOWS)
    return f"SELECT cmts_name, ifc_descr, day_0, {cols} FROM ({_avg_sql(rows, list(measures))}) GROUP BY 1, 2, 3"


@query("agg1_downstream_six_hour_means", _avg_sql(_DOWN_ROWS, DOWN), DOWN)
def _(t: Inputs) -> DataFrame:
    return WN.window_means(_down_rows(t), PI.KEYS, DOWN)


@query("agg1_upstream_six_hour_means", _avg_sql(_UP_ROWS, UP), UP)
def _(t: Inputs) -> DataFrame:
    return WN.window_means(_up_rows(t), PI.KEYS, UP)


@query("pv1_downstream_by_window", _pivot_sql(_DOWN_ROWS, S.DOWNSTREAM_MEASURES), DOWN_COLS)
def _(t: Inputs) -> DataFrame:
    return WN.spread(WN.window_means(_down_rows(t), PI.KEYS, DOWN), PI.KEYS, "hour_window", S.WINDOWS, S.DOWNSTREAM_MEASURES)


@query("pv2_upstream_by_window", _pivot_sql(_UP_ROWS, S.UPSTREAM_MEASURES), UP_COLS)
def _(t: Inputs) -> DataFrame:
    return WN.spread(WN.window_means(_up_rows(t), PI.KEYS, UP), PI.KEYS, "hour_window", S.WINDOWS, S.UPSTREAM_MEASURES)


@query("jn1_interface_with_group", f"""SELECT g.service_group_name AS service_group, v.* FROM ({_pivot_sql(_DOWN_ROWS, S.DOWNSTREAM_MEASURES)}) v
 JOIN ifc_to_group g ON g.cmts_name = v.cmts_name AND g.ifc_descr = v.ifc_descr""", DOWN_COLS)
def _(t: Inputs) -> DataFrame:
    wide = WN.spread(WN.window_means(_down_rows(t), PI.KEYS, DOWN), PI.KEYS, "hour_window", S.WINDOWS, S.DOWNSTREAM_MEASURES)
    return PI.with_group(wide, t.ifc_to_group)


@query("agg2_downstream_group_means", f"SELECT cmts_name, service_group, day_0, {q(DOWN_COLS)} FROM down_vector", DOWN_COLS)
def _(t: Inputs) -> DataFrame:
    return PI.downstream_vector(t.ifc_down_hour, t.ifc_to_group)


@query("agg3_devices_per_building", "SELECT building_id, count(DISTINCT mac) AS n_cpe_building FROM hw_info GROUP BY building_id")
def _(t: Inputs) -> DataFrame:
    return G.devices_per_building(G.node_details(t.topo_nodes))


@query("agg4_merged_validity", _ORDER_SPANS)
def _(t: Inputs) -> DataFrame:
    return G.merged_validity(t.order_history)


@query("jn2_static_device_info", "SELECT * FROM device_info")
def _(t: Inputs) -> DataFrame:
    return G.device_static(t.topo_nodes, t.group_history)


@query("agg5_history_days", "SELECT CAST(date_diff('day', CAST(min(hour_stamp) AS DATE), CAST(max(hour_stamp) AS DATE)) + 1 AS INTEGER) AS n_days FROM health_hour")
def _(t: Inputs) -> DataFrame:
    return G.history_days(t.health_hour)


@query("agg6_unavailability", "SELECT mac, h, unavailable FROM offline_rates", ["unavailable"])
def _(t: Inputs) -> DataFrame:
    return G.unavailability(t.health_hour)


_HOURLY = [f"{h}_unavailable" for h in range(24)]


@query("pv3_unavailability_by_hour", f"SELECT mac, {q(_HOURLY)} FROM offline_wide", _HOURLY)
def _(t: Inputs) -> DataFrame:
    return G.unavailability_wide(G.unavailability(t.health_hour))


def _population(t: Inputs) -> DataFrame:
    wide = G.unavailability_wide(G.unavailability(t.health_hour))
    return wide.join(G.device_static(t.topo_nodes, t.group_history).select("mac", "hardware_model"), "mac")


@query("jn3_unavailability_with_model", f"SELECT mac, hardware_model, {q(_HOURLY)} FROM offline_population", _HOURLY)
def _(t: Inputs) -> DataFrame:
    return _population(t)


_CUTS = [f"{h}_cut" for h in range(24)]


@query("win1_percentile_cuts_by_model", f"SELECT hardware_model, {q(_CUTS)} FROM offline_cuts", _CUTS)
def _(t: Inputs) -> DataFrame:
    return G.model_cuts(_population(t))


@query("jn4_without_outliers", "SELECT mac, hour_stamp, cm_status FROM health_hour WHERE mac NOT IN (SELECT mac FROM outlier_macs)")
def _(t: Inputs) -> DataFrame:
    static = G.device_static(t.topo_nodes, t.group_history)
    return t.health_hour.join(PD.outlier_devices(t.health_hour, static), "mac", "left_anti").select("mac", "hour_stamp", "cm_status")


@query("jn5_offline_flags", """SELECT h.mac, h.hour_stamp, coalesce(o.f, 0) AS offline_flg FROM health_hour h
 LEFT JOIN (SELECT mac, hour_stamp, 1 AS f FROM health_hour WHERE cm_status <> 8) o ON o.mac = h.mac AND o.hour_stamp = h.hour_stamp""")
def _(t: Inputs) -> DataFrame:
    return G.flag_offline(t.health_hour, G.offline_hours(t.health_hour)).select("mac", "hour_stamp", "offline_flg")


_GROUP_STATS = [f"avg_{m}" for m in DEV] + [f"range_{m}" for m in DEV]


def _enriched(t: Inputs) -> DataFrame:
    static = G.device_static(t.topo_nodes, t.group_history)
    return G.enrich_hours(t.health_hour, static, PD.outlier_devices(t.health_hour, static))


@query("agg7_group_mean_and_range", "SELECT cmts, service_group, hour_stamp, " + ", ".join(
    [f"avg({m}) AS avg_{m}" for m in DEV] + [f"max({m}) - min({m}) AS range_{m}" for m in DEV]
) + " FROM enriched GROUP BY 1, 2, 3", _GROUP_STATS)
def _(t: Inputs) -> DataFrame:
    return G.group_ranges(_enriched(t), ["cmts", "service_group", "hour_stamp"], DEV)


@query("jn6_hours_with_group_stats", "SELECT e.mac, e.hour_stamp, e.snr_up, g.a AS avg_snr_up FROM enriched e "
       "JOIN (SELECT cmts, service_group, hour_stamp, avg(snr_up) AS a FROM enriched GROUP BY 1, 2, 3) g "
       "ON g.cmts = e.cmts AND g.service_group = e.service_group AND g.hour_stamp = e.hour_stamp", ["snr_up", "avg_snr_up"])
def _(t: Inputs) -> DataFrame:
    keys = ["cmts", "service_group", "hour_stamp"]
    e = _enriched(t)
    return e.join(G.group_ranges(e, keys, ["snr_up"]), keys).select("mac", "hour_stamp", "snr_up", "avg_snr_up")


@query("win2_standardised_to_group", f"SELECT mac, hour_stamp, cmts, service_group, offline_flg, {q(DEV)} FROM standardised", DEV)
def _(t: Inputs) -> DataFrame:
    return G.standardise_to_group(_enriched(t)).select("mac", "hour_stamp", "cmts", "service_group", "offline_flg", *DEV)


def _six_hours(t: Inputs) -> DataFrame:
    return PD.window_rows(G.standardise_to_group(_enriched(t)))


@query("agg8_device_six_hour_means", f"SELECT mac, day_0, hour_window, {q(DEV)} FROM six_hours", DEV)
def _(t: Inputs) -> DataFrame:
    return _six_hours(t).select("mac", "day_0", "hour_window", *DEV)


_MISS = [f"miss_{m}" for m in DEV]


@query("agg9_missing_percentages", f"SELECT mac, day_0, hour_window, {q(_MISS)} FROM six_hours", _MISS)
def _(t: Inputs) -> DataFrame:
    return _six_hours(t).select("mac", "day_0", "hour_window", *_MISS)


@query("agg10_offline_percentages", f"""SELECT h.mac, CAST(h.hour_stamp AS DATE) AS day_0, {WINDOW.format("h.hour_stamp")} AS hour_window,
 100.0::DOUBLE * sum(CASE WHEN h.cm_status <> 8 THEN 1 ELSE 0 END) / 6 AS offline_pct
 FROM health_hour h JOIN device_info d ON h.mac = d.mac AND CAST(h.hour_stamp AS DATE) BETWEEN CAST(d.v_from AS DATE) AND CAST(d.v_to AS DATE)
 GROUP BY ALL""", ["offline_pct"])
def _(t: Inputs) -> DataFrame:
    # outliers included, since they are the devices with offline hours
    enriched = G.enrich_hours(t.health_hour, G.device_static(t.topo_nodes, t.group_history))
    return PD.window_rows(enriched).select("mac", "day_0", "hour_window", "offline_pct")


@query("pv4_device_by_window", f"SELECT mac, day_0, cmts, service_group, {q(DEVICE_COLS)} FROM cpe_vector", DEVICE_COLS)
def _(t: Inputs) -> DataFrame:
    rows = _six_hours(t)
    return WN.spread(rows, PD.DEVICE_KEYS, "hour_window", S.WINDOWS, PD.STATS).select("mac", "day_0", "cmts", "service_group", *DEVICE_COLS)


@query("jn7_one_day_vector", f"SELECT mac, day_0, cmts, service_group, n_cpe_building, {q(DEVICE_COLS + INTERFACE_COLS)} FROM vector_1d", DEVICE_COLS + INTERFACE_COLS)
def _(t: Inputs) -> DataFrame:
    return t.vector_1d.select("mac", "day_0", "cmts", "service_group", "n_cpe_building", *DEVICE_COLS, *INTERFACE_COLS)


@query("agg12_day_means", f"SELECT mac, day_0, {q(S.DAILY_MEASURES)} FROM daily_avg", S.DAILY_MEASURES)
def _(t: Inputs) -> DataFrame:
    return t.daily_avg


@query("win4_day_differences", f"SELECT mac, day_0, {q(S.DAILY_MEASURES)} FROM daily_diffs", S.DAILY_MEASURES)
def _(t: Inputs) -> DataFrame:
    return t.daily_diffs


@query("pv5_day_differences_by_pivot", f"SELECT mac, day_0, {q(S.DAILY_MEASURES)} FROM daily_diffs WHERE day_0 = {D0}", S.DAILY_MEASURES)
def _(t: Inputs) -> DataFrame:
    return WN.day_differences_by_pivot(t.daily_avg, DAY)


_HISTORY = [f"{m}_{k}d" for m in S.DAILY_MEASURES for k in S.HISTORY_DAYS]


@query("pv6_history_by_offset", f"SELECT mac, day_0, {q(_HISTORY)} FROM five_day", _HISTORY)
def _(t: Inputs) -> DataFrame:
    return WN.history_by_day(t.daily_diffs)


@query("jn8_five_day_vector", f"SELECT {', '.join(S.IDENTITY)}, {q(FEATURES)} FROM five_day", FEATURES)
def _(t: Inputs) -> DataFrame:
    return PV.five_day_history(t.vector_1d)


# ---- composites -----------------------------------------------------------------------------


@query("composite1_downstream_vector", f"SELECT cmts_name, service_group, day_0, {q(DOWN_COLS)} FROM down_vector", DOWN_COLS)
def _(t: Inputs) -> DataFrame:
    return PI.downstream_vector(t.ifc_down_hour, t.ifc_to_group)


@query("composite2_upstream_vector", f"SELECT cmts_name, service_group, day_0, {q(UP_COLS)} FROM up_vector", UP_COLS)
def _(t: Inputs) -> DataFrame:
    return PI.upstream_vector(t.ifc_up_hour, t.ifc_to_group)


@query("composite3_static_info_on_day", f"""SELECT mac, hardware_model, cly_account_number, n_cpe_building, service_group, cmts FROM device_info
 WHERE CAST(v_from AS DATE) <= {D0} AND CAST(v_to AS DATE) >= {D0}""")
def _(t: Inputs) -> DataFrame:
    return G.valid_on(G.device_static(t.topo_nodes, t.group_history), DAY).drop("v_from", "v_to")


@query("composite4_offline_outliers", "SELECT mac FROM outlier_macs")
def _(t: Inputs) -> DataFrame:
    return PD.outlier_devices(t.health_hour, G.device_static(t.topo_nodes, t.group_history))


@query("composite5_device_vector", f"SELECT {', '.join(PD.DEVICE_KEYS)}, {q(DEVICE_COLS)} FROM cpe_vector", DEVICE_COLS)
def _(t: Inputs) -> DataFrame:
    return PD.device_vector(t.health_hour, t.topo_nodes, t.group_history)


@query("composite6_daily_changes", f"SELECT mac, day_0, {q(S.DAILY_MEASURES)} FROM daily_diffs", S.DAILY_MEASURES)
def _(t: Inputs) -> DataFrame:
    vectors = PV.daily_vectors(t.health_hour, t.topo_nodes, t.group_history, t.ifc_up_hour, t.ifc_down_hour, t.ifc_to_group)
    return WN.day_differences(WN.day_means(vectors))


@query("composite8_five_day_vector", f"SELECT {', '.join(S.IDENTITY)}, {q(FEATURES)}, seq_id FROM five_day", FEATURES)
def _(t: Inputs) -> DataFrame:
    return t.five_day


@query("snk7_sequence_numbers", "SELECT mac, day_0, seq_id FROM five_day")
def _(t: Inputs) -> DataFrame:
    return PV.numbered(t.vector_1d.select("mac", "day_0"))


@query("agg21_distinct_days", "SELECT DISTINCT day_0 FROM daily_avg")
def _(t: Inputs) -> DataFrame:
    return t.daily_avg.select("day_0").distinct()


@query("agg22_highest_id", "SELECT max(seq_id) AS top FROM five_day")
def _(t: Inputs) -> DataFrame:
    return t.five_day.agg(F.max("seq_id").alias("top"))

