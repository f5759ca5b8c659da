"""Date-aware splits: day folds, contiguous folds, hold-outs, gap schedules, longest date run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import stable_hash
from fleetpulse.operators.ranking import kth_hashes, running_totals
from fleetpulse.session import staged


def longest_run(df: DataFrame, day: str = "day_0") -> DataFrame:
    """(first_day, last_day, n_days) of the longest run of consecutive days (earliest on a tie)."""
    days = df.select(F.col(day).alias("d")).where(F.col("d").isNotNull()).distinct()
    # one row per calendar day, so a single ordering is small
    runs = days.withColumn("g", F.date_sub("d", F.row_number().over(W.orderBy("d"))))
    spans = runs.groupBy("g").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n_days"))
    best = spans.agg(F.max(F.struct("n_days", (-F.datediff("first_day", F.lit("1970-01-01").cast("date"))).alias("o"), "first_day", "last_day")).alias("b"))
    return best.select("b.first_day", "b.last_day", "b.n_days").where(F.col("n_days").isNotNull())


def day_folds(df: DataFrame, day: str = "day_0", k: int = 5, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """(day, fold): whole days dealt to folds in shuffled (stable-hash) or calendar order."""
    days = df.select(day).distinct()
    order = stable_hash(day, seed=seed) if shuffle else F.col(day)
    return days.withColumn("fold", ((F.row_number().over(W.orderBy(order)) - 1) % k).cast("int"))


def with_day_folds(df: DataFrame, day: str = "day_0", k: int = 5, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Rows with the fold of their day. No day is ever in two folds."""
    return df.join(day_folds(df, day, k, shuffle, seed), day)


def _balance_cuts(marked: DataFrame, label: str, k: int) -> DataFrame:
    """One row: per split, the hash up to which negatives outside the split's fold are as many as positives.

    Only counts per fold and hash prefix are spread over splits. A split without positives gets an empty cut (no negatives); with too few negatives, one
    above every hash (all of them).
    """
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: s != F.col("fold"))).alias("split")
    hashes = marked.where(F.col(label) == 0).select(F.col("fold").alias("cell"), F.col("_h").alias("h"))
    positives = marked.groupBy("fold").agg(F.count_if(F.col(label) == 1).alias("n")).select("n", others)
    need = staged(positives.groupBy("split").agg(F.sum("n").alias("need")), "needs")
    cells = marked.sparkSession.range(k).select(F.col("id").cast("int").alias("fold")).select(F.col("fold").alias("cell"), others.alias("grp"))
    edge = kth_hashes(hashes, need.withColumnRenamed("split", "grp"), cells).withColumnRenamed("grp", "split")
    cut = F.when(F.col("need") > 0, F.coalesce("cut", F.lit("g"))).otherwise(F.lit(""))  # hashes are hexadecimal
    table = need.join(edge, "split", "left").select("split", cut.alias("cut"))
    return table.agg(F.map_from_entries(F.collect_list(F.struct("split", "cut"))).alias("cuts"))


def day_splits(
    df: DataFrame, label: str, ids: Sequence[str], day: str = "day_0", k: int = 5, balanced: bool = True, seed: int = 0
) -> DataFrame:
    """Rows of all k splits: ``split``, ``role`` ('train' or 'test') and the row itself.

    With ``balanced`` each split's training part keeps all positives and as many negatives: a row is
    hashed once and compared with the cut of each split, so only rows that take part are copied.
    """
    folded = with_day_folds(df, day, k, True, seed)
    marked = folded.withColumn("_h", stable_hash(*ids, seed=seed))
    train = F.lit(True)
    if balanced:
        marked = marked.withColumn("_cuts", _balance_cuts(marked, label, k).scalar())
        train = lambda s: (F.col(label) == 1) | ((F.col(label) == 0) & (F.col("_h") <= F.try_element_at("_cuts", s)))
    role = lambda s: F.when(F.col("fold") == s, "test").when(train(s) if balanced else train, "train")
    entries = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.struct(s.alias("split"), role(s).alias("role")))
    used = F.explode(F.filter(entries, lambda e: e["role"].isNotNull()))
    return marked.withColumn("_e", used).select(*folded.columns, "_e.split", "_e.role")


def contiguous_folds(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """Fold numbers 0..k-1 over the row order, sizes differing by at most one (larger ones first)."""
    counts = df.groupBy(order).agg(F.count("*").alias("_n"))
    ranks = running_totals(counts, order, ["_n"]).select(order, F.col("cum__n").alias("_r"))
    n = df.agg(F.count("*").alias("n")).scalar()
    ranked = df.join(ranks, order).withColumn("_size", n)
    base, extra = F.expr("_size div %d" % k), F.col("_size") % k
    # the first `extra` folds have base + 1 rows
    edge = extra * (base + 1)
    i = F.col("_r") - 1
    fold = F.when(i < edge, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - edge) / base))
    return ranked.withColumn("fold", fold.cast("int")).drop("_r", "_size")


def gap_hold_out(df: DataFrame, hold_days: int, gap_days: int, day: str = "day_0") -> DataFrame:
    """Rows with ``role``: 'hold_out' for the ``hold_days`` days before the last one, 'train'
    for those more than ``gap_days`` earlier; the last day and the gap are left out."""
    days = df.select(day).distinct()
    back = days.withColumn("_b", F.row_number().over(W.orderBy(F.col(day).desc())))   # 1 = last day
    role = (
        F.when(F.col("_b").between(2, hold_days + 1), F.lit("hold_out"))
        .when(F.col("_b") > hold_days + gap_days + 1, F.lit("train"))
    )
    roles = back.withColumn("role", role).where(F.col("role").isNotNull()).drop("_b")
    return df.join(roles, day)


def gap_schedule(df: DataFrame, gaps: Sequence[int], ratio_testing: float = 0.25, day: str = "day_0") -> DataFrame:
    """(round, role, gap, day): fixed-length training windows that slide by a day over the
    longest run of days, and for each gap the day tested after the window."""
    run = longest_run(df, day)
    usable = F.col("n_days") - max(gaps)
    plan = run.withColumn("rounds", F.floor(ratio_testing * usable).cast("int")).withColumn(
        "train_days", (usable - F.col("rounds")).cast("int")
    ).where("rounds > 0")
    rounds = plan.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    start = F.date_add("first_day", F.col("round"))
    train = rounds.select(
        "round", F.lit("train").alias("role"), F.lit(None).cast("int").alias("gap"),
        F.explode(F.sequence(start, F.date_add("first_day", F.col("round") + F.col("train_days") - 1))).alias("day"),
    )
    test = rounds.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps]))).select(
        "round", F.lit("test").alias("role"), "gap",
        F.date_add("first_day", F.col("round") + F.col("train_days") + F.col("gap")).alias("day"),
    )
    return train.unionByName(test)


def rolling_windows(df: DataFrame, train_days: int, day: str = "day_0") -> DataFrame:
    """(round, day): every window of ``train_days`` consecutive days inside the longest run."""
    run = longest_run(df, day).where(F.col("n_days") >= train_days)
    rounds = run.withColumn("round", F.explode(F.sequence(F.lit(0), (F.col("n_days") - train_days).cast("int"))))
    return rounds.select(
        "round",
        F.explode(F.sequence(F.date_add("first_day", F.col("round")), F.date_add("first_day", F.col("round") + train_days - 1))).alias("day"),
    )


def latest_day(df: DataFrame, day: str = "day_0") -> DataFrame:
    """Rows of the newest day."""
    return df.where(F.col(day) == df.agg(F.max(day)).scalar())


def unseen_days(df: DataFrame, seen: DataFrame, day: str = "day_0") -> DataFrame:
    """Rows whose day is not among the days of ``seen``."""
    return df.join(seen.select(day).distinct(), day, "left_anti")
