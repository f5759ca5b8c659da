"""Quality rules whose thresholds follow the corpus: one quantile sketch per language, source and metric.

A sketch is a log-linear histogram (``expressions.coarse``): counts per bucket, relative error
below 2**-5, merged by adding counts and hence the same in any order of merging. Thresholds are
fences around the quartiles of a group; a group of few documents takes the sketch merged over its
language, or over the whole corpus. Documents meet their thresholds in a join.

Defined results: a null or empty text has no words and fails the base rule. Null language or
source is a group of its own. Repeated rows are judged alike, each for itself. An empty table
gives an empty table. The document's own columns are kept inside ``row``, so that no column of the
input can clash with the columns made here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.expressions import SYMBOLS, coarse, ratio, whole, words
from fleetpulse.llm.store import stage

SPAN = 8  # words in a window for repeats
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Metric:
    """An integer measure with the least width of its middle half that is taken as real spread."""

    name: str
    least_spread: int
    low_side: bool = False


METRICS = (
    Metric("symbol_permille", 10),
    Metric("upper_permille", 30),
    Metric("word_length_percent", 60, low_side=True),
    Metric("repeat_permille", 50),
    Metric("dup_line_permille", 150),
)


@dataclass(frozen=True)
class Rules:
    fence: int = 3  # widths of the middle half outside the quartiles
    least_group: int = 100  # documents for a sketch of its own
    least_spread: tuple[tuple[str, int], ...] = ()  # metrics with another least spread than in METRICS


def _repeats(base: DataFrame) -> DataFrame:
    """Words inside windows that occur twice or more in the same text."""
    n = F.size("__words")
    windows = F.when(
        n >= SPAN,
        F.transform(F.sequence(F.lit(1), n - (SPAN - 1)), lambda i: F.xxhash64(F.slice("__words", i, SPAN))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = base.withColumn("__windows", windows)
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumn(
        "__sorted",
        F.when(twice, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda e, other: F.coalesce(F.get(F.col("__sorted"), other)["h"] == e["h"], F.lit(False))
    starts = F.sort_array(F.transform(
        F.filter("__sorted", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    df = df.withColumn("__starts", F.when(F.size("__sorted") > 0, starts).otherwise(F.array().cast("array<int>")))
    covered = F.transform(
        "__starts", lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(F.col("__starts"), k + 1) - p, F.lit(SPAN))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")).drop(
        "__words", "__windows", "__sorted", "__starts")


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """``row`` (the document's columns), counts, metrics, ``base_failed``, and the group keys."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text])
    df = docs.select(row.alias("row"), whole(docs[f"`{text}`"]).alias("__text"), docs[f"`{lang}`"].cast("string").alias("lang"),
                     docs[f"`{source}`"].cast("string").alias("source"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__words": words(F.col("__text")), "__lines": lines})
    joined = F.array_join("__words", "")
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": F.regexp_count(F.col("__text"), F.lit(SYMBOLS)).cast("long"),
        "__upper": F.regexp_count(F.col("__text"), F.lit(r"\p{Lu}")).cast("long"),
        "__n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    df = _repeats(df)
    values = {
        "symbol_permille": ratio(F.col("n_symbols"), F.col("word_chars"), 1000),
        "upper_permille": ratio(F.col("__upper"), F.col("word_chars"), 1000),
        "word_length_percent": ratio(F.col("word_chars"), F.col("n_words"), 100),
        "repeat_permille": ratio(F.col("n_repeat_words"), F.col("n_words"), 1000),
        "dup_line_permille": ratio(F.col("n_dup_lines"), F.col("__n_lines"), 1000),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(
        "row", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[values[m.name].alias(m.name) for m in METRICS], failed.alias("base_failed"))


def sketches(documents: DataFrame) -> DataFrame:
    """Counts per language, source, metric and bucket, over documents that pass the base rule."""
    buckets = F.array(*[
        F.struct(F.lit(m.name).alias("metric"), coarse(F.col(m.name)).alias("bucket")) for m in METRICS])
    return (
        documents.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(buckets).alias("b"))
        .groupBy("lang", "source", "b.metric", "b.bucket").agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each group and metric, read off the running count over its buckets."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole_group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("cum", F.sum("n").over(whole_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("total", F.sum("n").over(whole_group))
    at = lambda p: F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), at(25).alias("q1"), at(75).alias("q3"))


def thresholds(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language and source with ``<metric>_low`` and ``<metric>_high``."""
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("__lang"), F.col("metric").alias("__metric"), F.struct("n", "q1", "q3").alias("of_lang"))
    overall = _quartiles(sketch, []).select(F.col("metric").alias("__any"), F.struct("n", "q1", "q3").alias("of_all"))
    df = (
        own.withColumn("own", F.struct("n", "q1", "q3"))
        .join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("metric") == F.col("__metric")))
        .join(overall, F.col("metric") == F.col("__any"))
    )
    enough = lambda s: s["n"] >= rules.least_group
    used = F.when(enough(F.col("own")), F.col("own")).when(enough(F.col("of_lang")), F.col("of_lang")).otherwise(F.col("of_all"))
    df = df.select("lang", "source", "metric", used.alias("s"))
    fences = []
    spread = {m.name: m.least_spread for m in METRICS} | dict(rules.least_spread)
    for m in METRICS:
        s = F.when(F.col("metric") == m.name, F.col("s"))
        width = rules.fence * F.greatest(s["q3"] - s["q1"], F.lit(spread[m.name]))
        fences.append(F.max(s["q3"] + width).alias(f"{m.name}_high"))
        fences.append(F.max((s["q1"] - width) if m.low_side else F.lit(None).cast("long")).alias(f"{m.name}_low"))
    return df.groupBy("lang", "source").agg(*fences)


def judged(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """Join each document with its group's thresholds; ``kept`` and ``reasons`` follow."""
    lim = limits.select(F.lit(True).alias("__known"), F.col("lang").alias("__lang"), F.col("source").alias("__source"),
                        *[c for c in limits.columns if c not in ("lang", "source")])
    df = documents.join(
        lim, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")

    def beyond(m: Metric) -> Column:
        high = F.coalesce(F.col(m.name) > F.col(f"{m.name}_high"), F.lit(False))
        return high | F.coalesce(F.col(m.name) < F.col(f"{m.name}_low"), F.lit(False))

    reasons = F.array_compact(F.array(*[F.when(beyond(m), F.lit(m.name)) for m in METRICS]))
    return df.withColumn("reasons", reasons).withColumn(
        "kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("__known", "__lang", "__source")


def quality_verdicts(
    docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True
) -> DataFrame:
    """Every document (inside ``row``) with its counts, metrics, thresholds, ``reasons`` and ``kept``.

    The measured documents are written once, since both the sketches and the verdicts read them.
    """
    documents = stage(measured(docs, text, lang, source, keep_text), "quality-measured")
    limits = stage(thresholds(sketches(documents), rules).coalesce(1), "quality-thresholds")
    return judged(documents, limits)
