"""The inputs and the composites in SQL, written independently of the Spark operators."""

from __future__ import annotations

from fleetpulse import schemas as S
from fleetpulse.functions.scalars import FAILURE_KINDS

MODEL_CASE = "CASE hardware_model " + " ".join(f"WHEN '{m}' THEN {i}" for m, i in S.MODEL_IDS.items()) + " END"
_MAC = "lpad(CAST({0} AS VARCHAR), 8, '0')"


def _typed(kind: str) -> str:
    return f"avg(CASE WHEN event_type = '{kind}' THEN value END)"


def quoted(name: str) -> str:
    return f'"{name}"'


def lines(parts: list[str]) -> str:
    return ",\n ".join(parts)


VIEWS: dict[str, str] = {}

VIEWS["health_hour"] = f"""
SELECT 'AA' || {_MAC.format('user_id')} AS mac, CAST(user_id % 97 AS VARCHAR) AS account_number,
 date_trunc('hour', ts) AS hour_stamp,
 CASE WHEN max(CASE WHEN event_type = 'error' AND value >= 200 THEN 1 ELSE 0 END) = 1 THEN 4 ELSE 8 END AS cm_status,
 {_typed('signup')} AS cer_dn, {_typed('error')} AS cer_up, min(value) AS pct_traffic_dmh_up,
 avg(CASE WHEN event_type IN ('click', 'view') THEN value END) AS pct_traffic_sdmh_up,
 avg(value) AS rxpower_dn, {_typed('view')} AS rxpower_up, {_typed('purchase')} AS snr_dn,
 max(value) AS snr_up, {_typed('click')} AS txpower_up
FROM events GROUP BY user_id, date_trunc('hour', ts)"""

VIEWS["ifc_down_hour"] = f"""
SELECT 'H' || CAST(user_id % 2 AS VARCHAR) AS cmts_name,
 'x Downstream ' || CAST(user_id % 10 AS VARCHAR) || '/' || CAST(user_id % 10 AS VARCHAR) || ' y' AS downstream_name,
 date_trunc('hour', ts) AS hour, avg(value) AS rxpower, {_typed('click')} AS avg_snr, {_typed('error')} AS ccer,
 {_typed('signup')} AS cer, CAST(count(*) AS DOUBLE) AS utilization
FROM events GROUP BY user_id % 2, user_id % 10, date_trunc('hour', ts)"""

VIEWS["ifc_up_hour"] = f"""
SELECT 'H' || CAST(user_id % 2 AS VARCHAR) AS cmts_name,
 'cable-Upstream ' || CAST(user_id % 10 AS VARCHAR) || '/1/0' AS upstream_name,
 date_trunc('hour', ts) AS hour, {_typed('view')} AS rxpower, {_typed('click')} AS txpower, {_typed('error')} AS cer,
 CAST(count(*) AS DOUBLE) AS utilization, {_typed('purchase')} AS ms_utilization, max(value) AS freecont_ms_utilization
FROM events GROUP BY user_id % 2, user_id % 10, date_trunc('hour', ts)"""

VIEWS["ifc_to_group"] = """
SELECT DISTINCT 'H' || CAST(user_id % 2 AS VARCHAR) AS cmts_name, 'G' || CAST(user_id % 5 AS VARCHAR) AS service_group_name,
 'Downstream ' || CAST(user_id % 10 AS VARCHAR) || '/' || CAST(user_id % 10 AS VARCHAR) AS ifc_descr FROM events
UNION ALL
SELECT DISTINCT 'H' || CAST(user_id % 2 AS VARCHAR), 'G' || CAST(user_id % 5 AS VARCHAR),
 'Upstream ' || CAST(user_id % 10 AS VARCHAR) || '/1/0' FROM events"""

VIEWS["topo_nodes"] = f"""
SELECT 'aa:' || {_MAC.format('c_custkey')} AS node_key,
 [{', '.join(f"'{m}'" for m in S.MODEL_IDS)}, 'SLEEPING BOX'][c_custkey % {len(S.MODEL_IDS) + 1} + 1] AS src_node_model,
 CAST(c_nationkey AS VARCHAR) AS src_node_building_id, CAST(c_custkey % 97 AS VARCHAR) AS cly_acct_number,
 CASE WHEN c_acctbal < 0 THEN 1 ELSE 55 END AS topo_node_type_id
FROM customer"""

VIEWS["group_history"] = f"""
SELECT 'H' || CAST(user_id % 2 AS VARCHAR) AS cmts, 'G' || CAST(user_id % 5 AS VARCHAR) AS service_group,
 'aa:' || {_MAC.format('user_id')} AS mac, ts AS modemloss_valid_from, ts + INTERVAL 3 DAY AS modemloss_valid_to
FROM events WHERE event_type IN ('click', 'view')"""

VIEWS["order_history"] = f"""
SELECT 'H' || CAST(o_custkey % 2 AS VARCHAR) AS cmts, 'G' || CAST(o_custkey % 5 AS VARCHAR) AS service_group,
 'aa:' || {_MAC.format('o_custkey')} AS mac, o_orderdate AS modemloss_valid_from,
 o_orderdate + INTERVAL 90 DAY AS modemloss_valid_to
FROM orders"""

VIEWS["milestones"] = """
SELECT user_id * 100 + day(ts) AS session_id, event_id % 4 AS flow_id, event_id AS event_no,
 'internet.' || event_type || '.start' AS milestone_name,
 CASE WHEN event_id % 3 = 0 THEN 'tv' ELSE 'Internet' END AS process_flow, ts AS start_time, ts AS calendar_date,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS cnt_interact_sent, 0 AS cnt_case_sent
FROM events"""

VIEWS["sessions"] = """
SELECT user_id * 100 + day(ts) AS journal_id, event_id % 3 AS emp_id, event_id AS case_id
FROM events WHERE event_type = 'error'"""

VIEWS["cases"] = """
SELECT event_id AS id, CAST(user_id % 97 AS VARCHAR) AS customer_id, 'first' AS cust_first_name,
 'last' AS cust_last_name, value AS duration, ts AS start_time
FROM events WHERE event_type = 'error'"""

VIEWS["interactions"] = """
SELECT event_id AS interaction_id, CAST(user_id % 97 AS VARCHAR) AS account_number, ts AS create_date,
 event_id % 3 AS emp_id, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS flg_ftr_0d_flg,
 CAST(event_id % 2 AS INTEGER) AS flg_ftr_7d_flg
FROM events WHERE event_type IN ('click', 'view')"""

VIEWS["run_log"] = """
SELECT max(ts) AS log_date,
 CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) * 5 > count(*) THEN 1 ELSE 0 END AS is_error,
 CAST(count(*) AS VARCHAR) || ' rows inserted in events' AS log_text, 1 AS is_done
FROM events GROUP BY CAST(ts AS DATE)"""

# ---- composites -----------------------------------------------------------------------------

_MODELS = ", ".join(f"'{m}'" for m in S.MODEL_IDS)
WINDOW = "3 - CAST(floor(hour({0}) / 6) AS INTEGER)"

VIEWS["hw_info"] = """
SELECT upper(replace(node_key, ':', '')) AS mac, src_node_model AS hardware_model,
 src_node_building_id AS building_id, cly_acct_number AS cly_account_number
FROM topo_nodes WHERE topo_node_type_id = 55"""

VIEWS["spans"] = """
SELECT cmts, service_group, upper(replace(mac, ':', '')) AS mac, min(modemloss_valid_from) AS v_from,
 max(modemloss_valid_to) AS v_to
FROM group_history GROUP BY ALL"""

VIEWS["device_info"] = f"""
SELECT h.mac, h.hardware_model, h.cly_account_number, n.n_cpe_building, s.service_group, s.cmts, s.v_from, s.v_to
FROM hw_info h JOIN (SELECT building_id, count(DISTINCT mac) AS n_cpe_building FROM hw_info GROUP BY building_id) n
 ON h.building_id = n.building_id JOIN spans s ON s.mac = h.mac
WHERE h.hardware_model IN ({_MODELS})"""

VIEWS["offline_rates"] = """
SELECT mac, CAST(hour(hour_stamp) AS INTEGER) AS h,
 100.0::DOUBLE * count(*) / (SELECT date_diff('day', CAST(min(hour_stamp) AS DATE), CAST(max(hour_stamp) AS DATE)) + 1 FROM health_hour) AS unavailable
FROM health_hour WHERE cm_status <> 8 GROUP BY 1, 2"""

VIEWS["offline_wide"] = "SELECT mac, " + lines([
    f"coalesce(max(CASE WHEN h = {h} THEN unavailable END), 0.0::DOUBLE) AS \"{h}_unavailable\"" for h in range(24)
]) + " FROM offline_rates GROUP BY mac"

VIEWS["offline_population"] = "SELECT w.*, d.hardware_model FROM offline_wide w JOIN device_info d ON w.mac = d.mac"

VIEWS["offline_cuts"] = "SELECT hardware_model, " + lines([
    f"quantile_disc(\"{h}_unavailable\", 0.99) AS \"{h}_cut\"" for h in range(24)
]) + " FROM offline_population GROUP BY hardware_model"

VIEWS["outlier_macs"] = (
    "SELECT DISTINCT p.mac FROM offline_population p JOIN offline_cuts c ON p.hardware_model = c.hardware_model WHERE "
    + " OR ".join(f'"{h}_unavailable" >= "{h}_cut"' for h in range(24))
)

VIEWS["enriched"] = f"""
SELECT h.mac, d.hardware_model, d.cly_account_number, d.n_cpe_building, d.service_group, d.cmts,
 CASE WHEN h.cm_status <> 8 THEN 1 ELSE 0 END AS offline_flg, h.account_number AS saa_account_number, h.hour_stamp,
 {', '.join('h.' + m for m in S.DEVICE_MEASURES)}
FROM health_hour h JOIN device_info d ON h.mac = d.mac
 AND CAST(h.hour_stamp AS DATE) BETWEEN CAST(d.v_from AS DATE) AND CAST(d.v_to AS DATE)
WHERE h.mac NOT IN (SELECT mac FROM outlier_macs)"""

_PART = "OVER (PARTITION BY cmts, service_group, hour_stamp)"
VIEWS["standardised"] = """
SELECT mac, hardware_model, cly_account_number, n_cpe_building, service_group, cmts, offline_flg, saa_account_number,
 hour_stamp, """ + lines([
    f"CASE WHEN max({m}) {_PART} - min({m}) {_PART} = 0 THEN 0.0::DOUBLE "
    f"ELSE ({m} - avg({m}) {_PART}) / (max({m}) {_PART} - min({m}) {_PART}) END AS {m}"
    for m in S.DEVICE_MEASURES
]) + " FROM enriched"

_KEYS = "cmts, service_group, mac, saa_account_number, hardware_model, cly_account_number, n_cpe_building"
VIEWS["six_hours"] = f"SELECT {_KEYS}, CAST(hour_stamp AS DATE) AS day_0, {WINDOW.format('hour_stamp')} AS hour_window, " + lines(
    [f"avg({m}) AS {m}" for m in S.DEVICE_MEASURES]
    + [f"100.0::DOUBLE * (6 - count({m})) / 6 AS miss_{m}" for m in S.DEVICE_MEASURES]
    + ["100.0::DOUBLE * sum(offline_flg) / 6 AS offline_pct"]
) + " FROM standardised GROUP BY ALL"

_STATS = dict(S.DEVICE_MEASURES) | {"offline_pct": "offline_pct"} | {
    f"miss_{m}": f"miss_{n}" for m, n in S.DEVICE_MEASURES.items()
}
VIEWS["cpe_vector"] = f"SELECT {_KEYS}, day_0, " + lines([
    f"max(CASE WHEN hour_window = {w} THEN {m} END) AS \"{w}_{n}\"" for m, n in _STATS.items() for w in S.WINDOWS
]) + " FROM six_hours GROUP BY ALL"


def _interface(table: str, column: str, pattern: str, measures: dict[str, str]) -> str:
    means = ", ".join(f"avg({m}) AS {m}" for m in measures)
    pivots = lines([
        f"max(CASE WHEN w = {w} THEN {m} END) AS \"{w}_{n}\"" for m, n in measures.items() for w in S.WINDOWS
    ])
    groups = lines([f"avg(\"{w}_{n}\") AS \"{w}_{n}\"" for n in measures.values() for w in S.WINDOWS])
    return f"""
SELECT v.cmts_name, g.service_group_name AS service_group, day_0, {groups}
FROM (SELECT cmts_name, ifc, day_0, {pivots} FROM (
  SELECT cmts_name, nullif(regexp_extract({column}, '{pattern}'), '') AS ifc, CAST(hour AS DATE) AS day_0,
   {WINDOW.format('hour')} AS w, {means}
  FROM {table} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) v
JOIN ifc_to_group g ON g.cmts_name = v.cmts_name AND g.ifc_descr = v.ifc
GROUP BY 1, 2, 3"""


DOWN_PATTERN = "(Downstream [[:alnum:]/]+)"
UP_PATTERN = "[[:alnum:] .]+/[0-9 .]+/[0-9 .]+$"
VIEWS["down_vector"] = _interface("ifc_down_hour", "downstream_name", DOWN_PATTERN, S.DOWNSTREAM_MEASURES)
VIEWS["up_vector"] = _interface("ifc_up_hour", "upstream_name", UP_PATTERN, S.UPSTREAM_MEASURES)

VIEWS["vector_1d"] = """
SELECT c.*, u.* EXCLUDE (cmts_name, service_group, day_0), d.* EXCLUDE (cmts_name, service_group, day_0)
FROM cpe_vector c
 JOIN up_vector u ON c.cmts = u.cmts_name AND c.service_group = u.service_group AND c.day_0 = u.day_0
 JOIN down_vector d ON c.cmts = d.cmts_name AND c.service_group = d.service_group AND c.day_0 = d.day_0"""


def _row_mean(m: str) -> str:
    cols = [f'"{w}_{m}"' for w in S.WINDOWS]
    total = " + ".join(f"coalesce({c}, 0)" for c in cols)
    known = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    return f"CASE WHEN coalesce({', '.join(cols)}) IS NOT NULL THEN ({total}) / ({known}) END AS {m}"


VIEWS["daily_avg"] = "SELECT mac, day_0, " + lines([_row_mean(m) for m in S.DAILY_MEASURES]) + " FROM vector_1d"

VIEWS["daily_diffs"] = "SELECT t.mac, t.day_0, " + lines(
    [f"t.{m} AS {m}" for m in S.LEVEL_MEASURES] + [f"t.{m} - y.{m} AS {m}" for m in S.DIFF_MEASURES]
) + " FROM daily_avg t LEFT JOIN daily_avg y ON y.mac = t.mac AND y.day_0 = t.day_0 - 1"


def _five_day_column(m: str) -> list[str]:
    if m in S.LEVEL_MEASURES:
        hours = [f"v.\"{k}_{m}\" AS {m}_{h}" for k, h in enumerate(["6h", "12h", "18h", "24h"])]
    else:
        hours = [f"v.\"{k}_{m}\" - v.\"{k + 1}_{m}\" AS {m}_{h}" for k, h in enumerate(["6h", "12h", "18h"])]
    return hours + [f"a.{m} AS {m}"] + [f"d{k}.{m} AS {m}_{k}d" for k in S.HISTORY_DAYS]


VIEWS["five_day_raw"] = (
    "SELECT " + ", ".join(f"v.{c}" for c in S.IDENTITY) + ", "
    + lines([c for m in S.DAILY_MEASURES for c in _five_day_column(m)])
    + " FROM vector_1d v JOIN daily_avg a ON a.mac = v.mac AND a.day_0 = v.day_0 "
    + " ".join(
        f"{'JOIN' if k == 1 else 'LEFT JOIN'} daily_diffs d{k} ON d{k}.mac = v.mac AND d{k}.day_0 = v.day_0 - {k - 1}"
        for k in S.HISTORY_DAYS
    )
)

VIEWS["five_day"] = """
SELECT *, row_number() OVER (ORDER BY day_0, md5('0:' || mac)) AS seq_id FROM five_day_raw"""

VIEWS["full_flows"] = """
SELECT DISTINCT CAST(calendar_date AS DATE) AS m_day, session_id, flow_id FROM milestones
WHERE upper(process_flow) = 'INTERNET' AND (cnt_interact_sent > 0 OR cnt_case_sent > 0)"""

VIEWS["first_milestones"] = """
SELECT m.m_day, m.session_id, m.event_no, m.milestone_name, m.process_flow, m.start_time AS milestone_start_t
FROM (SELECT *, CAST(calendar_date AS DATE) AS m_day FROM milestones WHERE upper(process_flow) = 'INTERNET') m
JOIN (SELECT f.m_day, f.session_id, min(x.event_no) AS event_no
 FROM full_flows f JOIN milestones x ON x.session_id = f.session_id AND x.flow_id = f.flow_id
  AND CAST(x.calendar_date AS DATE) = f.m_day AND upper(x.process_flow) = 'INTERNET' GROUP BY 1, 2) e
 ON e.m_day = m.m_day AND e.session_id = m.session_id AND e.event_no = m.event_no"""

VIEWS["via_details"] = """
SELECT s.case_id, s.emp_id, c.start_time AS case_start_t, m.session_id, m.process_flow, m.milestone_name,
 c.customer_id AS cly_account_number, m.m_day - 1 AS day_0
FROM first_milestones m JOIN sessions s ON s.journal_id = m.session_id JOIN cases c ON c.id = s.case_id"""

VIEWS["tentative"] = """
SELECT v.*, i.interaction_id, i.create_date, i.flg_ftr_0d_flg, i.flg_ftr_7d_flg
FROM via_details v JOIN interactions i ON CAST(v.case_start_t AS DATE) = CAST(i.create_date AS DATE)
 AND CAST(i.create_date AS DATE) = v.day_0 + 1 AND v.case_start_t <= i.create_date
 AND v.cly_account_number = i.account_number AND v.emp_id = i.emp_id"""

VIEWS["session_flags"] = """
SELECT day_0, session_id, flg_ftr_0d_flg, flg_ftr_7d_flg FROM (
 SELECT *, row_number() OVER (PARTITION BY day_0, session_id ORDER BY create_date, interaction_id) AS rn FROM tentative)
WHERE rn = 1"""

VIEWS["via_macs"] = """
SELECT v.case_id, v.session_id, v.emp_id, v.cly_account_number, h.mac, v.case_start_t, v.process_flow, v.milestone_name,
 v.day_0, f.flg_ftr_7d_flg, f.flg_ftr_0d_flg
FROM via_details v JOIN hw_info h ON h.cly_account_number = v.cly_account_number
JOIN session_flags f ON f.day_0 = v.day_0 AND f.session_id = v.session_id
WHERE f.flg_ftr_7d_flg = 1"""

# ---- modelling ------------------------------------------------------------------------------

VIEWS["device_day"] = """
SELECT d.*, f.milestone_name, t.src_node_model AS hardware_model,
 CAST(substr(d.mac, 3, 8) AS BIGINT) * 100 + day(d.day_0) AS seq_id
FROM (SELECT mac, CAST(hour_stamp AS DATE) AS day_0, """ + ", ".join(
    f"avg({m}) AS {n}" for m, n in S.DEVICE_MEASURES.items()
) + """, 100.0::DOUBLE * avg(CASE WHEN cm_status <> 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS offline_pct
 FROM health_hour GROUP BY 1, 2) d
LEFT JOIN (SELECT DISTINCT mac, CAST(hour_stamp AS DATE) - 1 AS day_0, [""" + ", ".join(f"'{k}'" for k in FAILURE_KINDS) + """, 'internet.speedtest.start']
  [(CAST(substr(mac, 3, 8) AS BIGINT) + day(CAST(hour_stamp AS DATE) - 1)) % 4 + 1] AS milestone_name FROM health_hour WHERE cer_up IS NOT NULL) f ON f.mac = d.mac AND f.day_0 = d.day_0
JOIN topo_nodes t ON upper(replace(t.node_key, ':', '')) = d.mac"""

VIEWS["scored"] = """
SELECT event_id AS id, CAST(ts AS DATE) AS day_0, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
 least(1.0::DOUBLE, floor(value * 2) / 1000.0::DOUBLE) AS score
FROM events"""

VIEWS["samples"] = """
SELECT vec_id AS id, CASE WHEN label < 5 THEN 'X' ELSE 'Y' END AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"""

VIEWS["clustered"] = """
SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS cluster, CASE WHEN label <= 2 THEN 1 ELSE 0 END AS label,
 CAST(embedding AS DOUBLE[]) AS v FROM embeddings"""

VIEWS["wide"] = """
SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_quantity AS qty_copy,
 l_quantity * 2 + l_linenumber AS twice,
 CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare,
 CASE WHEN l_returnflag <> 'A' THEN l_discount END AS disc_known,
 CASE WHEN l_returnflag = 'R' THEN l_tax END AS tax_known, l_linenumber AS line,
 CAST(l_shipdate AS DATE) AS ship_day, CASE WHEN isodow(l_shipdate) >= 6 THEN 1 ELSE 0 END AS weekend
FROM lineitem"""

VIEWS["curve"] = """
SELECT score, sum(label) AS p, sum(1 - label) AS n, sum(sum(label)) OVER (ORDER BY score DESC) AS tp,
 sum(sum(1 - label)) OVER (ORDER BY score DESC) AS fp,
 (SELECT sum(label) FROM scored) AS pos, (SELECT sum(1 - label) FROM scored) AS neg
FROM scored GROUP BY score"""

VIEWS["fold_of_day"] = """
SELECT day_0, CAST((row_number() OVER (ORDER BY md5('0:' || CAST(day_0 AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT DISTINCT day_0 FROM scored)"""

VIEWS["fold_curve"] = """
SELECT fold, score, sum(label) AS p, sum(1 - label) AS n,
 sum(sum(label)) OVER (PARTITION BY fold ORDER BY score DESC) AS tp,
 sum(sum(1 - label)) OVER (PARTITION BY fold ORDER BY score DESC) AS fp,
 sum(sum(label)) OVER (PARTITION BY fold) AS pos, sum(sum(1 - label)) OVER (PARTITION BY fold) AS neg
FROM scored s JOIN fold_of_day f USING (day_0) GROUP BY fold, score"""
