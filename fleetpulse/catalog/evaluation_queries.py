"""Splits, curves, scores, cluster tables and pair-distance tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.catalog.inputs import DAY, Inputs
from fleetpulse.catalog.registry import query
from fleetpulse.operators import evaluate as EV
from fleetpulse.operators import folds as FD
from fleetpulse.operators import pairs as PR
from fleetpulse.operators.ranking import running_totals, top_by_score
from fleetpulse.session import new_table_path
from fleetpulse.sources.sinks import overwrite

D0 = f"DATE '{DAY}'"
D = "CAST({0} AS DOUBLE)"

# ---- splits ---------------------------------------------------------------------------------

_RUNS = """SELECT min(d) AS first_day, max(d) AS last_day, count(*) AS n_days FROM (
 SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM (SELECT DISTINCT ship_day AS d FROM wide)) GROUP BY g"""
_LONGEST = f"SELECT * FROM ({_RUNS}) ORDER BY n_days DESC, first_day LIMIT 1"
_SCORED_RUN = "(SELECT min(day_0) AS first_day, max(day_0) AS last_day, count(DISTINCT day_0) AS n_days FROM scored)"


@query("win5_longest_run_of_days", _LONGEST)
def _(t: Inputs) -> DataFrame:
    return FD.longest_run(t.wide, "ship_day")


@query("win8_rolling_windows", f"""SELECT CAST(r AS INTEGER) AS round, first_day + CAST(r + i AS INTEGER) AS day FROM {_SCORED_RUN},
 range(0, 31) a(r), range(0, 7) b(i) WHERE r <= n_days - 7""")
def _(t: Inputs) -> DataFrame:
    return FD.rolling_windows(t.scored, 7)


@query("cv1_day_folds", "SELECT day_0, fold FROM fold_of_day")
def _(t: Inputs) -> DataFrame:
    return FD.day_folds(t.scored)


_H = "md5('0:' || CAST(id AS VARCHAR))"


@query("cv1_balanced_day_splits", f"""WITH copies AS (SELECT s.id, s.label, f.fold, k.split FROM scored s JOIN fold_of_day f USING (day_0), range(0, 5) k(split))
 SELECT CAST(split AS INTEGER) AS split, 'test' AS role, id, label FROM copies WHERE split = fold
 UNION ALL SELECT CAST(split AS INTEGER), 'train', id, label FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {_H}) AS r,
  sum(label) OVER (PARTITION BY split) AS n FROM copies WHERE split <> fold) WHERE label = 1 OR r <= n""")
def _(t: Inputs) -> DataFrame:
    return FD.day_splits(t.scored, "label", ["id"]).select("split", "role", "id", "label")


@query("cv2_contiguous_folds", "SELECT id, CAST(ntile(7) OVER (ORDER BY id) - 1 AS INTEGER) AS fold FROM scored")
def _(t: Inputs) -> DataFrame:
    return FD.contiguous_folds(t.scored.select("id"), "id", 7)


@query("cv6_gap_hold_out", """SELECT id, day_0, role FROM (SELECT s.id, s.day_0, CASE WHEN b BETWEEN 2 AND 4 THEN 'hold_out' WHEN b > 9 THEN 'train' END AS role
 FROM scored s JOIN (SELECT day_0, row_number() OVER (ORDER BY day_0 DESC) AS b FROM (SELECT DISTINCT day_0 FROM scored)) d USING (day_0)) WHERE role IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    return FD.gap_hold_out(t.scored, 3, 5).select("id", "day_0", "role")


@query("cv7_gap_schedule", f"""WITH p AS (SELECT first_day, CAST(floor(0.25 * (n_days - 4)) AS INTEGER) AS rounds,
 CAST(n_days - 4 - floor(0.25 * (n_days - 4)) AS INTEGER) AS train_days FROM {_SCORED_RUN})
 SELECT CAST(r AS INTEGER) AS round, 'train' AS role, CAST(NULL AS INTEGER) AS gap, first_day + CAST(r + i AS INTEGER) AS day
 FROM p, range(0, 31) a(r), range(0, 31) b(i) WHERE r < rounds AND i < train_days
 UNION ALL SELECT CAST(r AS INTEGER), 'test', CAST(g AS INTEGER), first_day + CAST(r + train_days + g AS INTEGER)
 FROM p, range(0, 31) a(r), (VALUES (0), (2), (4)) c(g) WHERE r < rounds""")
def _(t: Inputs) -> DataFrame:
    return FD.gap_schedule(t.scored, [0, 2, 4])


@query("flt11_latest_day", "SELECT id, day_0 FROM scored WHERE day_0 = (SELECT max(day_0) FROM scored)")
def _(t: Inputs) -> DataFrame:
    return FD.latest_day(t.scored).select("id", "day_0")


@query("set5_unseen_days", f"SELECT id, day_0 FROM scored WHERE day_0 NOT IN (SELECT day_0 FROM scored WHERE day_0 < {D0})")
def _(t: Inputs) -> DataFrame:
    return FD.unseen_days(t.scored, t.scored.where(F.col("day_0") < F.lit(DAY))).select("id", "day_0")


# ---- scores and curves ----------------------------------------------------------------------


@query("win6_running_hits", "SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve")
def _(t: Inputs) -> DataFrame:
    return EV.cumulative_hits(t.scored, "score", "label").select("score", "tp", "fp")


_TOP = "SELECT id, label, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n FROM scored) WHERE r <= round_even(0.2 * n, 0)"


@query("srt3_top_scores", _TOP)
def _(t: Inputs) -> DataFrame:
    k = t.scored.agg(F.bround(F.count("*") * F.lit(0.2), 0).cast("long").alias("k")).scalar()
    return top_by_score(t.scored, "score", "id", k).select("id", "label", "score")


@query("ev1_top_share_metrics", f"""SELECT n_top, 100.0::DOUBLE * tp / predicted AS "precision", 100.0::DOUBLE * tp / positive AS recall,
 200.0::DOUBLE * tp / (predicted + positive) AS f1 FROM (SELECT count(*) AS n_top, count(CASE WHEN score > 0.5 AND label = 1 THEN 1 END) AS tp,
 count(CASE WHEN score > 0.5 THEN 1 END) AS predicted, count(CASE WHEN label = 1 THEN 1 END) AS positive FROM ({_TOP}))""", ["precision", "recall", "f1"])
def _(t: Inputs) -> DataFrame:
    return EV.top_metrics(t.scored, "score", "label", "id", 0.2)


_PRED = "(SELECT label, CASE WHEN score > 0.05 THEN 1 ELSE 0 END AS pred FROM scored)"


@query("ev2_class_report", " UNION ALL ".join(f"""SELECT {c} AS "class", 100.0::DOUBLE * count(CASE WHEN label = {c} AND pred = {c} THEN 1 END) / count(CASE WHEN pred = {c} THEN 1 END) AS "precision",
 100.0::DOUBLE * count(CASE WHEN label = {c} AND pred = {c} THEN 1 END) / count(CASE WHEN label = {c} THEN 1 END) AS recall,
 200.0::DOUBLE * count(CASE WHEN label = {c} AND pred = {c} THEN 1 END) / (count(CASE WHEN pred = {c} THEN 1 END) + count(CASE WHEN label = {c} THEN 1 END)) AS f1,
 count(CASE WHEN label = {c} THEN 1 END) AS support FROM {_PRED}""" for c in (0, 1)), ["precision", "recall", "f1"], 3)
def _(t: Inputs) -> DataFrame:
    scored = t.scored.withColumn("pred", (F.col("score") > 0.05).cast("int"))
    return EV.class_report(scored, "label", "pred")


@query("ev3_roc_points", f"SELECT score AS threshold, {D.format('fp')} / neg AS fpr, {D.format('tp')} / pos AS tpr FROM curve", ["fpr", "tpr"])
def _(t: Inputs) -> DataFrame:
    return EV.roc_points(t.scored, "score", "label")


@query("ev3_roc_auc", f"SELECT sum({D.format('n')} / neg * (2 * tp - p) / pos / 2) AS auc FROM curve", ["auc"])
def _(t: Inputs) -> DataFrame:
    return EV.roc_auc(t.scored, "score", "label")


def _folded(t: Inputs) -> DataFrame:
    return FD.with_day_folds(t.scored)


@query("ev3_mean_roc", """WITH seg AS (SELECT fold, CAST(fp - n AS DOUBLE) / neg AS x0, CAST(fp AS DOUBLE) / neg AS x1, CAST(fp - n AS BIGINT) AS f0, CAST(fp AS BIGINT) AS f1,
  CAST(neg AS BIGINT) AS neg, CAST(tp - p AS DOUBLE) / pos AS y0, CAST(tp AS DOUBLE) / pos AS y1 FROM fold_curve),
 pts AS (SELECT g, CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE y0 + (g / 99.0::DOUBLE - x0) / (x1 - x0) * (y1 - y0) END AS tpr
  FROM seg JOIN range(0, 99) r(g) ON 99 * f0 <= g * neg AND g * neg < 99 * f1
  UNION ALL SELECT 99, 1.0::DOUBLE FROM (SELECT DISTINCT fold FROM seg))
 SELECT g / 99.0::DOUBLE AS fpr, avg(tpr) AS mean_tpr, stddev_pop(tpr) AS std_tpr, greatest(avg(tpr) - stddev_pop(tpr), 0.0::DOUBLE) AS low,
  least(avg(tpr) + stddev_pop(tpr), 1.0::DOUBLE) AS high FROM pts GROUP BY g""", ["fpr", "mean_tpr", "std_tpr", "low", "high"])
def _(t: Inputs) -> DataFrame:
    return EV.mean_roc(_folded(t), "score", "label", "fold")


_PR = f"SELECT score AS threshold, {D.format('tp')} / (tp + fp) AS \"precision\", {D.format('tp')} / pos AS recall FROM curve"


@query("ev4_precision_recall_points", f"{_PR} UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE", ["precision", "recall"])
def _(t: Inputs) -> DataFrame:
    return EV.precision_recall_points(t.scored, "score", "label")


def _area(table: str, by: str = "", extra: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by + ', ' if by else ''}sum({extra or 'area'}) AS auc FROM (SELECT *, (recall - recall0) * ("precision" + precision0) / 2 AS area FROM (
 SELECT *, coalesce(lag("precision") OVER w, 1.0::DOUBLE) AS precision0, coalesce(lag(recall) OVER w, 0.0::DOUBLE) AS recall0 FROM (
 SELECT {by + ', ' if by else ''}score, {D.format('tp')} / (tp + fp) AS "precision", {D.format('tp')} / pos AS recall FROM {table})
 WINDOW w AS ({part}ORDER BY score DESC))){' GROUP BY ' + by if by else ''}"""


@query("ev5_pr_auc", _area("curve"), ["auc"])
def _(t: Inputs) -> DataFrame:
    return EV.pr_auc(t.scored, "score", "label")


@query("ev5_partial_pr_auc", _area("curve", extra='CASE WHEN "precision" > 0.19 AND precision0 > 0.19 THEN area ELSE 0 END'), ["auc"])
def _(t: Inputs) -> DataFrame:
    return EV.partial_pr_auc(t.scored, "score", "label", 0.19)


_LEVELS = [0.15, 0.19, 0.2, 0.25, 0.9]


def _recalls(table: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"""SELECT {head}level, coalesce(max(CASE WHEN "precision" >= level THEN recall END), 0.0::DOUBLE) AS recall,
 coalesce(min(CASE WHEN "precision" >= level AND recall = best THEN score END), 1.0::DOUBLE) AS threshold FROM (
 SELECT *, max(CASE WHEN "precision" >= level THEN recall END) OVER (PARTITION BY {head}level) AS best FROM (
 SELECT {head}score, {D.format('tp')} / (tp + fp) AS "precision", {D.format('tp')} / pos AS recall FROM {table}),
 (VALUES {', '.join(f'({x}::DOUBLE)' for x in _LEVELS)}) l(level)) GROUP BY {head}level"""


@query("ev6_recall_at_precision", _recalls("curve"), ["recall", "threshold"])
def _(t: Inputs) -> DataFrame:
    return EV.recall_at_precision(t.scored, "score", "label", _LEVELS)


@query("ev7_fold_report", f"""SELECT level, avg(recall) AS recall, avg(threshold) AS threshold, max(auc) AS auc
 FROM ({_recalls('fold_curve', 'fold')}), ({_area('curve')}) GROUP BY level""", ["recall", "threshold", "auc"])
def _(t: Inputs) -> DataFrame:
    return EV.fold_report(_folded(t), "score", "label", "fold", _LEVELS)


@query("cv4_auc_over_folds", f"SELECT avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc FROM ({_area('fold_curve', 'fold')})", ["mean_auc", "std_auc"])
def _(t: Inputs) -> DataFrame:
    return EV.auc_over_folds(_folded(t), "score", "label", "fold")


# ---- clusters -------------------------------------------------------------------------------

_SICK = "(SELECT cluster FROM clustered GROUP BY cluster ORDER BY avg(label) DESC, cluster LIMIT 1)"
_CLUSTERS = f"""SELECT CASE WHEN cluster = {_SICK} THEN 'sick' ELSE 'healthy' END AS cluster, label,
 CASE WHEN cluster = {_SICK} AND label = 1 THEN 'True positives' WHEN cluster = {_SICK} THEN 'False positives'
  WHEN label = 1 THEN 'False negatives' ELSE 'True negatives' END AS description, count(*) AS n,
 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY label) AS label_pct,
 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS cluster_pct FROM clustered GROUP BY clustered.cluster, label"""


@query("cl6_cluster_table", _CLUSTERS, ["label_pct", "cluster_pct"])
def _(t: Inputs) -> DataFrame:
    return EV.cluster_table(t.clustered, "label", "cluster")


@query("jn17_cluster_scores", f"""SELECT 100.0::DOUBLE * sum(CASE WHEN description = 'True positives' THEN n END) / sum(CASE WHEN cluster = 'sick' THEN n END) AS "precision",
 100.0::DOUBLE * sum(CASE WHEN description = 'True positives' THEN n END) / sum(CASE WHEN label = 1 THEN n END) AS recall FROM ({_CLUSTERS})""", ["precision", "recall"], 3)
def _(t: Inputs) -> DataFrame:
    return EV.cluster_scores(EV.cluster_table(t.clustered, "label", "cluster"))


_DIST = "list_distance(a.v, b.v)"
BLOCK = 256


@query("cl2_silhouettes", f"""WITH m AS (SELECT a.id, a.cluster AS c, b.cluster AS o, sum({_DIST}) AS total, count(*) AS n FROM clustered a, clustered b GROUP BY 1, 2, 3),
 ab AS (SELECT id, c, max(CASE WHEN c = o AND n > 1 THEN total / (n - 1) END) AS x, min(CASE WHEN c <> o THEN total / n END) AS y FROM m GROUP BY 1, 2)
 SELECT id, c AS cluster, CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE (y - x) / greatest(x, y) END AS silhouette FROM ab""", ["silhouette"])
def _(t: Inputs) -> DataFrame:
    return PR.silhouettes(t.clustered, "id", "v", "cluster", BLOCK)


# ---- pair distances -------------------------------------------------------------------------


@query("jn18_pair_distances_by_cluster", f"""SELECT least(a.cluster, b.cluster) AS g, greatest(a.cluster, b.cluster) AS h, count(*) AS n, sum({_DIST}) AS total,
 min({_DIST}) AS nearest, max({_DIST}) AS farthest FROM clustered a JOIN clustered b ON a.id < b.id GROUP BY 1, 2""", ["total", "nearest", "farthest"])
def _(t: Inputs) -> DataFrame:
    return PR.pair_sums(t.clustered, "id", "v", "cluster", BLOCK)


_CENTRES = """(SELECT cluster, list(m ORDER BY k) AS centre FROM (SELECT cluster, k, avg(x) AS m FROM (
 SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM clustered) GROUP BY 1, 2) GROUP BY 1)"""


@query("jn19_distances_to_centres", f"""SELECT p.id, p.cluster, c.cluster AS centre_id, list_distance(p.v, c.centre) AS euclidean FROM clustered p, {_CENTRES} c""", ["euclidean"])
def _(t: Inputs) -> DataFrame:
    centres = PR.centres_of(t.clustered, "v", "cluster")
    return PR.distances_to_centres(t.clustered, "v", centres).select("id", "cluster", "centre_id", "euclidean")


@query("st15_centre_distances", f"""SELECT p.id, p.cluster, c.cluster AS centre_id, list_distance(p.v, c.centre) AS euclidean,
 1 - list_cosine_similarity(p.v, c.centre) AS cosine FROM clustered p, {_CENTRES} c""", ["euclidean", "cosine"])
def _(t: Inputs) -> DataFrame:
    centres = PR.centres_of(t.clustered, "v", "cluster")
    return PR.distances_to_centres(t.clustered, "v", centres).select("id", "cluster", "centre_id", "euclidean", "cosine")


_ENERGY = """n1 * n2 / (n1 + n2) * (2 * sxy / (n1 * n2) - sxx / (n1 * n1) - syy / (n2 * n2))"""
_SIZES = "(SELECT CAST(count(CASE WHEN grp = 'X' THEN 1 END) AS DOUBLE) AS n1, CAST(count(CASE WHEN grp = 'Y' THEN 1 END) AS DOUBLE) AS n2 FROM samples)"


@query("st6_energy_statistic", f"""SELECT CAST(0 AS INTEGER) AS r, {_ENERGY} AS energy FROM (SELECT sum(CASE WHEN a.grp = 'X' AND b.grp = 'X' THEN {_DIST} END) AS sxx,
 sum(CASE WHEN a.grp = 'X' AND b.grp = 'Y' THEN {_DIST} END) AS sxy, sum(CASE WHEN a.grp = 'Y' AND b.grp = 'Y' THEN {_DIST} END) AS syy
 FROM samples a, samples b), {_SIZES}""", ["energy"])
def _(t: Inputs) -> DataFrame:
    return PR.energy_statistics(t.samples, "id", "v", "grp", 0, block_rows=BLOCK)


REPLICATES = 99
ALPHA = 1
_REPS = f"""WITH d AS (SELECT a.id AS i, b.id AS j, {_DIST} AS x FROM samples a, samples b),
 bits AS (SELECT id, 0 AS r, grp = 'X' AS b FROM samples
  UNION ALL SELECT id, CAST(r AS INTEGER), row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS VARCHAR) || ':' || CAST(id AS VARCHAR))) <= (SELECT n1 FROM {_SIZES})
  FROM samples, range(1, {REPLICATES + 1}) t(r)),
 sums AS (SELECT p.r, sum(CASE WHEN p.b AND q.b THEN x END) AS sxx, sum(CASE WHEN p.b AND NOT q.b THEN x END) AS sxy,
  sum(CASE WHEN NOT p.b AND NOT q.b THEN x END) AS syy FROM d JOIN bits p ON p.id = d.i JOIN bits q ON q.id = d.j AND q.r = p.r GROUP BY 1),
 e AS (SELECT r, {_ENERGY} AS energy FROM sums, {_SIZES})"""


@query("smp5_permuted_groups", f"{_REPS} SELECT id, r, b AS in_first FROM bits WHERE r > 0")
def _(t: Inputs) -> DataFrame:
    marked = PR.with_assignments(t.samples.select("id", "grp"), "id", "grp", REPLICATES)
    return marked.select("id", F.posexplode("bits").alias("r", "in_first")).where("r > 0")


@query("st7_energy_replicates", f"{_REPS} SELECT r, energy FROM e", ["energy"])
def _(t: Inputs) -> DataFrame:
    return PR.energy_statistics(t.samples, "id", "v", "grp", REPLICATES, block_rows=BLOCK)


@query("st7_energy_test", f"""{_REPS} SELECT observed, quantile_cont(energy, 0.99) AS "limit", CAST(count(CASE WHEN energy > observed THEN 1 END) AS DOUBLE) / count(*) AS p_value,
 CAST(count(CASE WHEN energy > observed THEN 1 END) AS DOUBLE) / count(*) < 0.01 AS reject
 FROM e, (SELECT energy AS observed FROM e WHERE r = 0) o WHERE r > 0 GROUP BY observed""", ["observed", "limit", "p_value"])
def _(t: Inputs) -> DataFrame:
    return PR.energy_test(t.samples, "id", "v", "grp", REPLICATES, ALPHA, block_rows=BLOCK)


@query("snk9_energy_from_stored_distances", f"{_REPS} SELECT r, energy FROM e", ["energy"])
def _(t: Inputs) -> DataFrame:
    path = new_table_path(t.spark, "distances")

    def stored(stripe: tuple[int, int]) -> DataFrame:
        overwrite(PR.distance_tiles(t.samples, "id", "v", BLOCK, stripe), path)
        return t.spark.read.parquet(path)

    # a matrix of more than STORED_BYTES is stored and used stripe by stripe, each in place of the one before
    return PR.energy_from_tiles(map(stored, PR.stripes(t.samples, BLOCK)), t.samples, "id", "grp", REPLICATES, block_rows=BLOCK)


@query("st8_repeated_energy_test")
def _(t: Inputs) -> DataFrame:
    return PR.repeated_energy_test(t.samples, "id", "v", "grp", REPLICATES, ALPHA, block_rows=BLOCK)


@query("st8_same_population_control")
def _(t: Inputs) -> DataFrame:
    return PR.repeated_energy_test(t.samples, "id", "v", "grp", REPLICATES, ALPHA, similar=True, block_rows=BLOCK)


@query("st8_summary_of_repeats")
def _(t: Inputs) -> DataFrame:
    tests = PR.repeated_energy_test(t.samples, "id", "v", "grp", REPLICATES, ALPHA, similar=True, block_rows=BLOCK)
    return PR.repeated_summary(tests, ALPHA)


_METRIC_SQL = {
    "euclidean": _DIST,
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    "cityblock": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "seuclidean": _DIST,
}
_UNIT = """(SELECT id, list(x / s ORDER BY k) AS v FROM (SELECT id, k, x, stddev_samp(x) OVER (PARTITION BY k) AS s FROM (
 SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM samples)) GROUP BY id)"""


def _pairs_of(metric: str) -> str:
    source = _UNIT if metric == "seuclidean" else "samples"
    return f"SELECT {_METRIC_SQL[metric]} AS x FROM {source} a JOIN {source} b ON a.id < b.id"


def _register_metric(metric: str) -> None:
    @query(f"st14_distance_summary_{metric}", f"SELECT count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM ({_pairs_of(metric)})", ["mean", "std", "lo", "hi"])
    def _(t: Inputs) -> DataFrame:
        return PR.distance_summary(t.samples, "id", "v", metric, BLOCK)


for _m in _METRIC_SQL:
    _register_metric(_m)


@query("st14_distance_histogram", f"""WITH d AS ({_pairs_of('euclidean')}), s AS (SELECT min(x) AS lo, max(x) AS hi FROM d)
 SELECT least(CAST(floor((x - lo) / ((hi - lo) / 500)) AS INTEGER) + 1, 500) AS bin, count(*) AS n FROM d, s GROUP BY 1""")
def _(t: Inputs) -> DataFrame:
    return PR.distance_histogram(t.samples, "id", "v", "euclidean", 500, BLOCK)


_NEIGHBOURS = f"""SELECT id, avg(y) AS proba FROM (SELECT a.id, CAST(b.label AS DOUBLE) AS y, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS r
 FROM clustered a, clustered b WHERE a.cluster = 0 AND b.cluster = 1) WHERE r <= 5 GROUP BY id"""


@query("ml10_nearest_neighbour_share", _NEIGHBOURS, ["proba"])
def _(t: Inputs) -> DataFrame:
    points = t.clustered
    return PR.nearest_labels(points.where("cluster = 1"), points.where("cluster = 0"), "id", "v", "label", 5, BLOCK)


@query("ml10_nearest_rows", f"""SELECT id, CAST(r AS INTEGER) AS rank, near, distance FROM (SELECT a.id, b.id AS near, {_DIST} AS distance,
 row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS r FROM clustered a, clustered b WHERE a.cluster = 0 AND b.cluster = 1) WHERE r <= 5""", ["distance"])
def _(t: Inputs) -> DataFrame:
    points = t.clustered
    return PR.nearest_rows(points.where("cluster = 1"), points.where("cluster = 0"), "id", "v", 5, block_rows=BLOCK)


@query("win6_running_totals_by_day", """SELECT day_0, score, CAST(sum(count(*)) OVER (PARTITION BY day_0 ORDER BY score) AS BIGINT) AS cum_n FROM scored GROUP BY day_0, score""")
def _(t: Inputs) -> DataFrame:
    counts = t.scored.groupBy("day_0", "score").agg(F.count("*").alias("n"))
    return running_totals(counts, "score", ["n"], by=["day_0"]).select("day_0", "score", "cum_n")
