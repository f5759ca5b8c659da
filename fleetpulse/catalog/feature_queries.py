"""Feature preparation, screening and distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse import schemas as S
from fleetpulse.catalog.inputs import Inputs
from fleetpulse.catalog.registry import query
from fleetpulse.catalog.sql_views import MODEL_CASE
from fleetpulse.functions.scalars import binary_label
from fleetpulse.operators import prep as P
from fleetpulse.operators import screening as SC
from fleetpulse.operators import stats as ST
from fleetpulse.plans.matrix import as_vectors, training_columns
from fleetpulse.sources.tables import normalise_sample

NUM = ["qty", "price", "disc", "tax", "qty_copy", "twice", "rare", "disc_known", "tax_known"]
DAILY = list(S.DEVICE_DAILY)
KEEP = [f for f in S.feature_columns() if f not in S.redundant_features()]


def long_sql(cols: list[str], table: str = "wide") -> str:
    parts = [f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL" for c in cols]
    return " UNION ALL ".join(parts)


def device_days(t: Inputs) -> DataFrame:
    return t.device_day.withColumns({
        "label": binary_label("milestone_name"), "weekend": (F.weekday("day_0") >= 5).cast("int")
    })


DEVICE_DAYS = """(SELECT *, CASE WHEN milestone_name IS NULL THEN 0 ELSE 1 END AS label,
 CASE WHEN isodow(day_0) >= 6 THEN 1 ELSE 0 END AS weekend FROM device_day)"""


# ---- preparation ----------------------------------------------------------------------------


@query("prj5_feature_columns", f"SELECT hardware_model, offline_pct, {', '.join(DAILY)} FROM device_day", ["offline_pct", *DAILY])
def _(t: Inputs) -> DataFrame:
    return P.feature_part(t.device_day)


@query("prj6_without_redundant_features", f"SELECT mac, day_0, {', '.join(KEEP)} FROM five_day", KEEP)
def _(t: Inputs) -> DataFrame:
    return P.drop_redundant(t.five_day).select("mac", "day_0", *KEEP)


_CODED = f"(SELECT mac, day_0, {MODEL_CASE} AS hardware_model, CAST(isodow(day_0) - 1 AS INTEGER) AS weekday FROM device_day)"
_ONE_HOT = [f"CASE WHEN hardware_model = {k} THEN 1 ELSE 0 END AS model_{k}" for k in range(7)] + [
    f"CASE WHEN weekday = {k} THEN 1 ELSE 0 END AS wk_{k}" for k in range(7)
]


def _coded(t: Inputs) -> DataFrame:
    return normalise_sample(t.device_day, drop_healthy_days=False).select("mac", "day_0", "hardware_model", "weekday")


@query("pv8_one_hot_columns", f"SELECT mac, day_0, {', '.join(_ONE_HOT)} FROM {_CODED}")
def _(t: Inputs) -> DataFrame:
    return P.one_hot(_coded(t), P.MODEL_AND_WEEKDAY)


@query("prj8_undone_one_hot", f"SELECT mac, day_0, weekday, coalesce(hardware_model, -1) AS hardware_model FROM {_CODED}")
def _(t: Inputs) -> DataFrame:
    wide = P.one_hot(_coded(t), P.MODEL_AND_WEEKDAY)
    return wide.select(
        "mac", "day_0", P.undo_one_hot("wk", range(7)).alias("weekday"), P.undo_one_hot("model", range(7)).alias("hardware_model")
    )


@query("cln1_imputed_zero", f"SELECT mac, day_0, {', '.join(f'coalesce({m}, 0) AS {m}' for m in DAILY)} FROM device_day", DAILY)
def _(t: Inputs) -> DataFrame:
    return P.impute(t.device_day, DAILY, "zero").select("mac", "day_0", *DAILY)


@query("cln1_imputed_mean", f"SELECT mac, day_0, {', '.join(f'coalesce({m}, (SELECT avg({m}) FROM device_day)) AS {m}' for m in DAILY)} FROM device_day", DAILY)
def _(t: Inputs) -> DataFrame:
    return P.impute(t.device_day, DAILY, "mean").select("mac", "day_0", *DAILY)


@query("cln1_imputed_median", f"SELECT mac, day_0, {', '.join(f'coalesce({m}, (SELECT quantile_cont({m}, 0.5) FROM device_day)) AS {m}' for m in DAILY)} FROM device_day", DAILY)
def _(t: Inputs) -> DataFrame:
    return P.impute(t.device_day, DAILY, "median").select("mac", "day_0", *DAILY)


_SCALED = ["qty", "price", "disc", "tax"]


@query("cln2_standard_scaled", "SELECT line, ship_day, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _SCALED) + " FROM wide", _SCALED)
def _(t: Inputs) -> DataFrame:
    return P.standard_scale(t.wide.select("line", "ship_day", *_SCALED), _SCALED)


_Q = "(SELECT quantile_cont({c}, {p}) FROM wide)"


@query("cln3_robust_scaled", "SELECT line, ship_day, " + ", ".join(
    f"({c} - {_Q.format(c=c, p=0.5)}) / ({_Q.format(c=c, p=0.99)} - {_Q.format(c=c, p=0.01)}) AS {c}" for c in _SCALED
) + " FROM wide", _SCALED)
def _(t: Inputs) -> DataFrame:
    return P.robust_scale(t.wide.select("line", "ship_day", *_SCALED), _SCALED)


# draws follow the stable hash, so DuckDB can make the same ones
_H = "md5('{seed}:' || CAST(seq_id AS VARCHAR))"


@query("smp2_balanced_with_replacement", f"""SELECT d.seq_id, d.label FROM {DEVICE_DAYS} d WHERE label = 1
 UNION ALL SELECT h.seq_id, 0 FROM (SELECT seq_id, row_number() OVER (ORDER BY {_H.format(seed=0)}) AS i FROM {DEVICE_DAYS} WHERE label = 0) h
 JOIN (SELECT CAST(('0x' || substr({_H.format(seed=0)}, 1, 8)) AS BIGINT) % (SELECT count(*) FROM {DEVICE_DAYS} WHERE label = 0) + 1 AS i
  FROM {DEVICE_DAYS} WHERE label = 1) s ON s.i = h.i""")
def _(t: Inputs) -> DataFrame:
    return P.balance(device_days(t).select("seq_id", "label"), "label", ["seq_id"])


@query("smp2_balanced_without_replacement", f"""SELECT seq_id, label FROM (SELECT seq_id, label,
 row_number() OVER (PARTITION BY label ORDER BY {_H.format(seed=3)}) AS r, sum(label) OVER () AS n FROM {DEVICE_DAYS})
 WHERE label = 1 OR r <= n""")
def _(t: Inputs) -> DataFrame:
    return P.balance(device_days(t).select("seq_id", "label"), "label", ["seq_id"], replace=False, seed=3)


@query("smp3_balanced_within_weekday", f"""SELECT seq_id, label, weekday FROM (SELECT seq_id, label, weekday,
 row_number() OVER (PARTITION BY weekday, label ORDER BY {_H.format(seed=0)}) AS r, sum(label) OVER (PARTITION BY weekday) AS n
 FROM (SELECT *, CAST(isodow(day_0) - 1 AS INTEGER) AS weekday FROM {DEVICE_DAYS})) WHERE label = 1 OR r <= n""")
def _(t: Inputs) -> DataFrame:
    rows = device_days(t).select("seq_id", "label", F.weekday("day_0").alias("weekday"))
    return P.balance_within(rows, "label", ["seq_id"], ["weekday"])


@query("smp4_disjoint_halves", f"""SELECT seq_id, CASE WHEN r > 700 THEN 1 ELSE 0 END AS half FROM (
 SELECT seq_id, row_number() OVER (ORDER BY {_H.format(seed=0)}) AS r FROM device_day) WHERE r <= 1400""")
def _(t: Inputs) -> DataFrame:
    return P.disjoint_halves(t.device_day.select("seq_id"), ["seq_id"], F.lit(700))


@query("set3_stacked_populations", f"SELECT seq_id, 'weekday' AS population FROM {DEVICE_DAYS} WHERE weekend = 0 UNION ALL SELECT seq_id, 'weekend' FROM {DEVICE_DAYS} WHERE weekend = 1")
def _(t: Inputs) -> DataFrame:
    d = device_days(t)
    week = d.where("weekend = 0").select("seq_id", F.lit("weekday").alias("population"))
    return week.unionByName(d.where("weekend = 1").select("seq_id", F.lit("weekend").alias("population")))


@query("set4_shared_ids", f"SELECT seq_id FROM {DEVICE_DAYS} WHERE weekend = 1 AND label = 1")
def _(t: Inputs) -> DataFrame:
    d = device_days(t)
    return d.where("weekend = 1").select("seq_id").join(d.where("label = 1").select("seq_id"), "seq_id", "left_semi")


@query("set6_united_ids", f"SELECT seq_id FROM {DEVICE_DAYS} WHERE weekend = 1 UNION SELECT seq_id FROM {DEVICE_DAYS} WHERE label = 1")
def _(t: Inputs) -> DataFrame:
    d = device_days(t)
    return d.where("weekend = 1").select("seq_id").union(d.where("label = 1").select("seq_id")).distinct()


_SICK_DAYS = "day_0 IN (SELECT day_0 FROM device_day WHERE milestone_name IS NOT NULL)"


@query("composite11_training_columns", f"""SELECT mac, day_0, seq_id, CASE WHEN milestone_name IS NULL THEN 0 ELSE 1 END AS label,
 offline_pct, {', '.join(DAILY)}, {', '.join(_ONE_HOT)} FROM (SELECT * REPLACE ({MODEL_CASE} AS hardware_model),
 CAST(isodow(day_0) - 1 AS INTEGER) AS weekday FROM device_day WHERE {_SICK_DAYS})""", ["offline_pct", *DAILY])
def _(t: Inputs) -> DataFrame:
    return training_columns(t.device_day)


@query("composite11_training_vectors")
def _(t: Inputs) -> DataFrame:
    return as_vectors(training_columns(t.device_day))


# ---- column reports -------------------------------------------------------------------------


@query("agg13_means_by_device_and_day_type", f"SELECT mac, weekend, {', '.join(f'avg({m}) AS {m}' for m in DAILY)} FROM {DEVICE_DAYS} GROUP BY 1, 2", DAILY)
def _(t: Inputs) -> DataFrame:
    return device_days(t).groupBy("mac", "weekend").agg(*[F.avg(m).alias(m) for m in DAILY])


@query("agg14_category_counts", "SELECT milestone_name AS value, count(*) AS n FROM device_day WHERE milestone_name IS NOT NULL GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return ST.category_counts(t.device_day, "milestone_name")


@query("agg15_few_valued_columns", f"""SELECT "column", count(DISTINCT value) AS n_distinct FROM ({long_sql(NUM)}) GROUP BY 1 HAVING count(DISTINCT value) < 12""")
def _(t: Inputs) -> DataFrame:
    return ST.distinct_counts(t.wide, NUM, below=12)


@query("agg16_null_shares", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 100.0::DOUBLE * count(CASE WHEN {c} IS NULL THEN 1 END) / count({c}) AS null_pct FROM wide" for c in NUM), ["null_pct"])
def _(t: Inputs) -> DataFrame:
    return ST.null_shares(t.wide, NUM)


@query("agg17_mean_positives_per_day", f"SELECT avg(n) AS mean_per_day, count(*) AS days FROM (SELECT day_0, sum(label) AS n FROM {DEVICE_DAYS} GROUP BY 1)", ["mean_per_day"])
def _(t: Inputs) -> DataFrame:
    return ST.mean_positives_per_day(device_days(t), "day_0", "label")


_SUM_COLS = ["count", "mean", "std", "min", "p1", "p50", "p99", "max"]


@query("agg18_column_summary", f"""SELECT "column", count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
 quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS max
 FROM ({long_sql(NUM)}) GROUP BY 1""", [c for c in _SUM_COLS if c != "count"])
def _(t: Inputs) -> DataFrame:
    return ST.column_summary(t.wide, NUM, [0.01, 0.5, 0.99])


@query("agg19_share_within_cluster", "SELECT cluster, label, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS pct FROM clustered GROUP BY 1, 2", ["pct"])
def _(t: Inputs) -> DataFrame:
    return ST.share_within(t.clustered, "cluster", "label")


@query("win7_percent_of_group", "SELECT line, disc, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY line) AS pct FROM wide GROUP BY 1, 2", ["pct"])
def _(t: Inputs) -> DataFrame:
    return ST.share_within(t.wide, "line", "disc")


@query("agg20_sample_composition", "SELECT count(*) AS n_total, 15 AS dimensions, count(milestone_name) AS n_sick, count(*) - count(milestone_name) AS n_healthy FROM device_day")
def _(t: Inputs) -> DataFrame:
    return ST.composition(t.device_day)


@query("pv7_long_form", long_sql(NUM), ["value"])
def _(t: Inputs) -> DataFrame:
    numbers = t.wide.select(*[F.col(c).cast("double").alias(c) for c in NUM])
    return numbers.unpivot([], NUM, "column", "value").where("value IS NOT NULL")


# ---- screening ------------------------------------------------------------------------------

_NZV = f"""SELECT "column", 100.0::DOUBLE * max(n) / sum(n) AS top_pct,
 CAST(max(n) AS DOUBLE) / max(CASE WHEN r = 2 THEN n END) AS ratio, 100.0::DOUBLE * count(*) / sum(n) AS unique_pct
 FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC) AS r FROM (
  SELECT "column", value, count(*) AS n FROM ({long_sql(NUM)}) GROUP BY 1, 2)) GROUP BY 1"""


@query("st1_near_zero_variance", f"""SELECT *, top_pct >= 99 OR ratio IS NULL OR (ratio >= 19 AND unique_pct <= 10) AS flagged FROM ({_NZV})""", ["top_pct", "ratio", "unique_pct"])
def _(t: Inputs) -> DataFrame:
    return SC.near_zero_variance(t.wide, NUM)


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@query("st2_pair_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, corr({a}, {b}) AS corr FROM wide" for a, b in _pairs(NUM)
), ["corr"])
def _(t: Inputs) -> DataFrame:
    return SC.pair_correlations(t.wide, NUM)


@query("st2_strong_pairs", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, "
    + (f"count(CASE WHEN {a} = {b} THEN NULL ELSE 1 END) = 0" if a in b or b in a else "false") + " AS \"identical\" FROM wide"
    for a, b in _pairs(NUM)
) + ") WHERE abs(corr) > 0.9", ["corr"])
def _(t: Inputs) -> DataFrame:
    return SC.strong_pairs(t.wide, NUM)


_STRONG = "(" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c, "
    + (f"count(CASE WHEN {a} = {b} THEN NULL ELSE 1 END) = 0" if a in b or b in a else "false") + " AS same FROM wide"
    for a, b in _pairs(NUM)
) + ")"


@query("st2_correlated_groups", f"""SELECT kind, min(head) AS head, member FROM (
 SELECT CASE WHEN same THEN 'identical' ELSE 'correlated' END AS kind, a AS head, b AS member FROM {_STRONG} WHERE abs(c) > 0.9
 UNION ALL SELECT CASE WHEN same THEN 'identical' ELSE 'correlated' END, b, a FROM {_STRONG} WHERE abs(c) > 0.9)
 GROUP BY kind, member HAVING min(head) < member""")
def _(t: Inputs) -> DataFrame:
    return SC.group_pairs(SC.strong_pairs(t.wide, NUM))


@query("st4_identical_to_drop", "SELECT 'qty_copy' AS \"column\" FROM wide HAVING count(CASE WHEN qty = qty_copy THEN NULL ELSE 1 END) = 0")
def _(t: Inputs) -> DataFrame:
    return SC.identical_to_drop(SC.strong_pairs(t.wide, NUM))


_RANK_PAIRS = [("qty", "price"), ("qty", "twice"), ("disc", "tax_known"), ("disc_known", "tax_known")]


def _rank_sql(a: str, b: str, table: str = "wide", head: str = "") -> str:
    head = head or f"'{a}' AS a, '{b}' AS b"
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
    return (
        f"SELECT {head}, corr({a}, {b}) AS pearson, corr(ra, rb) AS spearman FROM ("
        f"SELECT {a}, {b}, {rank.format(a)} AS ra, {rank.format(b)} AS rb FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


@query("st3_rank_correlations", " UNION ALL ".join(_rank_sql(a, b) for a, b in _RANK_PAIRS), ["pearson", "spearman"])
def _(t: Inputs) -> DataFrame:
    return SC.rank_correlations(t.wide, _RANK_PAIRS)


_KEY, _CANDIDATES, _SUFFIXES = "rx_dn", ["snr_up", "snr_dn"], ["1d", "2d"]


@query("st3_key_by_suffix", " UNION ALL ".join(
    _rank_sql(f"{_KEY}_{s}", f"{c}_{s}", "five_day", f"'{s}' AS suffix, '{c}' AS candidate") for s in _SUFFIXES for c in _CANDIDATES
), ["pearson", "spearman"], 4)
def _(t: Inputs) -> DataFrame:
    return SC.key_correlations(t.five_day, _KEY, _CANDIDATES, _SUFFIXES)


_NULLABLE = ["cer_dn", "cer_up", "snr_dn", "rx_up", "tx_up"]


@query("st12_null_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr(CASE WHEN {a} IS NULL THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN {b} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS corr FROM device_day"
    for a, b in _pairs(_NULLABLE)
), ["corr"])
def _(t: Inputs) -> DataFrame:
    return SC.null_correlations(t.device_day, _NULLABLE)


# ---- distributions --------------------------------------------------------------------------

_KS = f"""SELECT measurement, max(abs(fx / n1 - fy / n2)) AS statistic, n1, n2 FROM (
 SELECT measurement, value, CAST(sum(x) OVER w AS DOUBLE) AS fx, CAST(sum(y) OVER w AS DOUBLE) AS fy,
  CAST(sum(x) OVER (PARTITION BY measurement) AS BIGINT) AS n1, CAST(sum(y) OVER (PARTITION BY measurement) AS BIGINT) AS n2
 FROM (SELECT measurement, value, sum(weekend) AS x, sum(1 - weekend) AS y FROM (
  {' UNION ALL '.join(f"SELECT '{m}' AS measurement, {m} AS value, weekend FROM {DEVICE_DAYS} WHERE {m} IS NOT NULL" for m in DAILY)}) GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY measurement ORDER BY value)) GROUP BY measurement, n1, n2"""
_LAMBDA = "((sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE))) * statistic)"
_KS_P = f"""SELECT measurement, statistic, CASE WHEN lam < 0.1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
 (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0::DOUBLE * j * j * lam * lam)) FROM range(1, 101) r(j)))) END AS p_value, n1, n2
 FROM (SELECT *, {_LAMBDA} AS lam FROM ({_KS}))"""


@query("st5_ks_two_sample", _KS_P, ["statistic", "p_value"])
def _(t: Inputs) -> DataFrame:
    return ST.ks_two_sample(device_days(t), "weekend", 1, DAILY)


@query("srt5_strongest_differences", f"SELECT measurement, statistic FROM ({_KS_P}) ORDER BY p_value, measurement LIMIT 3", ["statistic"])
def _(t: Inputs) -> DataFrame:
    return ST.best_first(ST.ks_two_sample(device_days(t), "weekend", 1, DAILY), 3).select("measurement", "statistic")


@query("st9_shown_range", """SELECT min(lo) AS low, max(hi) AS high FROM (SELECT weekend, quantile_cont(price, 0.05) AS lo,
 quantile_cont(price, 0.95) AS hi FROM wide GROUP BY weekend)""", ["low", "high"])
def _(t: Inputs) -> DataFrame:
    return ST.shown_range(t.wide, "price", "weekend")


@query("st9_week_histogram", """SELECT weekend AS grp, least(CAST(floor((price - lo) / ((hi - lo) / 1000)) AS INTEGER) + 1, 1000) AS bin, count(*) AS n,
 count(*) / CAST(max(total) AS DOUBLE) / max((hi - lo) / 1000) AS density
 FROM (SELECT *, min(price) OVER (PARTITION BY weekend) AS lo, max(price) OVER (PARTITION BY weekend) AS hi,
  count(price) OVER (PARTITION BY weekend) AS total FROM wide) GROUP BY 1, 2""", ["density"], 12)
def _(t: Inputs) -> DataFrame:
    return ST.week_histogram(t.wide, "price", "weekend", 1000)


@query("st9_week_frequencies", """SELECT weekend AS grp, disc AS value, count(*) / CAST(sum(count(*)) OVER (PARTITION BY weekend) AS DOUBLE) AS freq
 FROM wide GROUP BY weekend, disc""", ["freq"])
def _(t: Inputs) -> DataFrame:
    return ST.week_frequencies(t.wide, "disc", "weekend")


_BIN = "CASE WHEN {x} IS NOT NULL THEN least(greatest(CAST(ceil(({x} - {lo}) / (({hi} - {lo}) / {n})) AS INTEGER), 1), {n}) END"


@query("fn18_equal_width_bins", f"SELECT price, {_BIN.format(x='price', lo='lo', hi='hi', n=10)} AS bin FROM (SELECT price, min(price) OVER () AS lo, max(price) OVER () AS hi FROM wide)")
def _(t: Inputs) -> DataFrame:
    return ST.binned(t.wide.select("price"), "price", 10)


@query("st10_class_histogram", f"""SELECT bin, 100.0::DOUBLE * count(CASE WHEN label = 1 THEN 1 END) / max(s) AS sick_pct,
 100.0::DOUBLE * count(CASE WHEN label = 0 THEN 1 END) / max(h) AS healthy_pct
 FROM (SELECT label, {_BIN.format(x='snr_up', lo='min(snr_up) OVER ()', hi='max(snr_up) OVER ()', n=10)} AS bin,
  sum(label) OVER () AS s, sum(1 - label) OVER () AS h FROM {DEVICE_DAYS}) GROUP BY bin""", ["sick_pct", "healthy_pct"])
def _(t: Inputs) -> DataFrame:
    return ST.class_histogram(device_days(t), "snr_up", "label", 10)


@query("fn19_grid_density", """SELECT CAST(floor(qty / 5) AS BIGINT) AS gx, CAST(floor(price / 10000) AS BIGINT) AS gy, count(*) AS n, log10(count(*)) AS log_n
 FROM wide GROUP BY 1, 2""", ["log_n"])
def _(t: Inputs) -> DataFrame:
    return ST.grid_density(t.wide, "qty", "price", 5, 10000)


@query("st11_cumulative_distribution", """SELECT price AS value, CAST(sum(count(*)) OVER (ORDER BY price) AS DOUBLE) / (SELECT count(price) FROM wide) AS share FROM wide GROUP BY price""", ["share"])
def _(t: Inputs) -> DataFrame:
    return ST.cumulative_distribution(t.wide, "price")


_BOX = ["lowest", "q1", "median", "q3", "highest"]


@query("st13_box_summary", f"""SELECT "column", min(value) AS lowest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.75) AS q3, max(value) AS highest FROM ({long_sql(NUM)}) GROUP BY 1""", _BOX)
def _(t: Inputs) -> DataFrame:
    return ST.box_summary(t.wide, NUM)
