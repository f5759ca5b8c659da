"""Measures, column-name grammar and explicit table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: measure names of the telemetry tables -------------------------------------
# hourly device measure -> name in the daily tables
DEVICE_MEASURES = {
    "cer_dn": "cer_dn",
    "cer_up": "cer_up",
    "pct_traffic_dmh_up": "pct_traffic_dmh_up",
    "pct_traffic_sdmh_up": "pct_traffic_sdmh_up",
    "rxpower_dn": "rx_dn",
    "rxpower_up": "rx_up",
    "snr_dn": "snr_dn",
    "snr_up": "snr_up",
    "txpower_up": "tx_up",
}
# hourly upstream-interface measure -> name in the daily tables
UPSTREAM_MEASURES = {
    "rxpower": "cmts_rx_up",
    "txpower": "cmts_tx_up",
    "cer": "cmts_cer_up",
    "utilization": "cmts_utilization_up",
    "ms_utilization": "cmts_ms_utilization_up",
    "freecont_ms_utilization": "cmts_f_ms_utilization_up",
}
# hourly downstream-interface measure -> name in the daily tables
DOWNSTREAM_MEASURES = {
    "rxpower": "cmts_rx_dn",
    "avg_snr": "cmts_snr_dn",
    "ccer": "cmts_ccer_dn",
    "cer": "cmts_cer_dn",
    "utilization": "cmts_utilization_dn",
}
# device models without a deep-sleep mode, with the id used for training
MODEL_IDS = {
    "CONNECT BOX CH7465LG COMPAL": 0,
    "UBEE EVM3206 (ED 3.0) - CPE": 1,
    "UBEE EVM3236 (ED 3.0) - CPE": 2,
    "WLAN MODEM EVW3226 - CPE": 3,
    "WLAN MODEM TC7200 - CPE": 4,
    "WLAN MODEM TC7200 V2 - CPE": 5,
    "WLAN MODEM TWG870 - CPE": 6,
}
DEVICE_NODE_TYPE = 55
ONLINE_STATUS = 8
IDENTITY = [
    "day_0", "mac", "cly_account_number", "saa_account_number",
    "cmts", "service_group", "hardware_model", "n_cpe_building",
]
NON_FEATURES = [
    "mac", "day_0", "cly_account_number", "saa_account_number",
    "cmts", "service_group", "seq_id", "milestone_name",
]
# ---------------------------------------------------------------------------------------------

WINDOWS = [0, 1, 2, 3]          # 0 = hours 18-23 ... 3 = hours 0-5
HISTORY_DAYS = [1, 2, 3, 4, 5]

DEVICE_DAILY = list(DEVICE_MEASURES.values())
MISS_DAILY = [f"miss_{m}" for m in DEVICE_DAILY]
INTERFACE_DAILY = list(UPSTREAM_MEASURES.values()) + list(DOWNSTREAM_MEASURES.values())
#: measures kept as levels over time
LEVEL_MEASURES = ["offline_pct"] + MISS_DAILY
#: measures turned into differences over time
DIFF_MEASURES = DEVICE_DAILY + INTERFACE_DAILY
DAILY_MEASURES = LEVEL_MEASURES + DIFF_MEASURES


def windowed(measure: str) -> list[str]:
    """Names of a measure's four 6-hour columns, e.g. ``0_cer_dn``."""
    return [f"{w}_{measure}" for w in WINDOWS]


def feature_columns() -> list[str]:
    """The 280 features of the five-day vector, in grammar order."""
    out: list[str] = []
    for m in DAILY_MEASURES:
        hours = ["6h", "12h", "18h", "24h"] if m in LEVEL_MEASURES else ["6h", "12h", "18h"]
        out += [f"{m}_{h}" for h in hours] + [m] + [f"{m}_{k}d" for k in HISTORY_DAYS]
    return out


def redundant_features() -> list[str]:
    """The 54 features known to repeat another one (five cliques and nine one-day levels)."""
    diff = ["", "_6h", "_12h", "_18h", "_1d", "_2d", "_3d", "_4d", "_5d"]
    level = ["", "_6h", "_12h", "_18h", "_24h", "_2d", "_3d", "_4d", "_5d"]
    out = ["cmts_ms_utilization_up" + s for s in diff]
    for m in ["miss_pct_traffic_sdmh_up", "miss_rx_dn", "miss_tx_up", "miss_snr_up"]:
        out += [m + s for s in level]
    return out + [f"{m}_1d" for m in MISS_DAILY]


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _DAY = T.TimestampNTZType(), T.DateType()

HEALTH_HOUR = _struct(mac=_S, account_number=_S, hour_stamp=_TS, cm_status=_I, **{m: _D for m in DEVICE_MEASURES})
DOWNSTREAM_HOUR = _struct(cmts_name=_S, downstream_name=_S, hour=_TS, **{m: _D for m in DOWNSTREAM_MEASURES})
UPSTREAM_HOUR = _struct(cmts_name=_S, upstream_name=_S, hour=_TS, **{m: _D for m in UPSTREAM_MEASURES})
INTERFACE_GROUP = _struct(cmts_name=_S, service_group_name=_S, ifc_descr=_S)
TOPO_NODE = _struct(
    node_key=_S, src_node_model=_S, src_node_building_id=_S, cly_acct_number=_S, topo_node_type_id=_I
)
GROUP_HISTORY = _struct(
    cmts=_S, service_group=_S, mac=_S, modemloss_valid_from=_TS, modemloss_valid_to=_TS
)
MILESTONE = _struct(
    session_id=_L, flow_id=_L, event_no=_L, milestone_name=_S, process_flow=_S,
    start_time=_TS, calendar_date=_TS, cnt_interact_sent=_I, cnt_case_sent=_I,
)
SESSION = _struct(journal_id=_L, emp_id=_L, case_id=_L)
CASE = _struct(id=_L, customer_id=_S, cust_first_name=_S, cust_last_name=_S, duration=_D, start_time=_TS)
INTERACTION = _struct(
    interaction_id=_L, account_number=_S, create_date=_TS, emp_id=_L, flg_ftr_0d_flg=_I, flg_ftr_7d_flg=_I
)
RUN_LOG = _struct(log_date=T.TimestampType(), is_error=_I, log_text=_S, is_done=_I)
DAILY_AVERAGE = _struct(mac=_S, day_0=_DAY, **{m: _D for m in DAILY_MEASURES})
FIVE_DAY_VECTOR = _struct(
    day_0=_DAY, mac=_S, cly_account_number=_S, saa_account_number=_S, cmts=_S, service_group=_S,
    hardware_model=_S, n_cpe_building=_L, **{f: _D for f in feature_columns()}, seq_id=_L,
)
