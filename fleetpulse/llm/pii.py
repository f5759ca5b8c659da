"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Spans are offsets in code points. The matches of a pattern and the gaps between them alternate, so
their lengths add up to the offsets; a text without confirmed match is not cut up at all. Patterns
use possessive repeats and start either where a run of their first class starts or where the
previous match ended (``\\G``): the same matches as the plain pattern, in linear time.

Kinds with ``keep=True`` are reported whatever their score. The others need ``least`` points after
context words within ``NEAR`` characters before the span have been counted.

Defined results: a null text is empty and has no spans. Spans of different kinds may overlap, spans
of a kind don't. Repeated rows are each reported. An empty table gives an empty table. The
document's own columns stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.expressions import whole

NEAR = 40
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,score:int>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def card_ok(match: Column) -> Column:
    number = digits(match)
    return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))


def ip_ok(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))

    return F.forall(F.split(match, r"\."), small)


def phone_ok(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def iban_ok(match: Column) -> Column:
    """Mod-97 over the account number with its first four characters moved to the end."""
    bare = F.upper(F.regexp_replace(match, " ", ""))
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(value < 10, rest * 10 + value).otherwise(rest * 100 + value) % 97

    return F.when(
        F.length(bare).between(15, 34), F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), step) == 1
    ).otherwise(F.lit(False))


def always(match: Column) -> Column:
    return match.isNotNull()


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must contain to be worth trying, the confirmation and the scoring."""

    name: str
    pattern: str
    trigger: str | None
    confirm: Callable[[Column], Column]
    prior: int
    hints: str
    keep: bool


# Patterns of the first four kinds are fixed values: they must find the same spans everywhere.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", always, 90,
         r"(?i)mail|contact|write|address", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", ip_ok, 60, r"(?i)\bip\b|host|server|address|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, card_ok, 80, r"(?i)card|visa|credit|payment|account", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", phone_ok, 60, r"(?i)phone|call|tel|mobile|fax", True),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+\b", None, iban_ok, 80, r"(?i)iban|bank|account", False),
    Kind("secret", r"\b(?:[0-9a-f]{40}|[0-9a-f]{64})\b", None, always, 30, r"(?i)token|secret|password|passwd|api.?key", False),
)


def _found(text: Column, kind: Kind) -> Column:
    every = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(kind.trigger)), every).otherwise(none) if kind.trigger else every


def _placed(text: Column, matches: Column, kind: Kind, rank: int, least: int) -> Column:
    """Spans of the confirmed matches, by adding up the lengths of gaps and matches."""
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        near = F.substring(x["g"], F.greatest(F.length(x["g"]) - NEAR + 1, F.lit(1)), F.lit(NEAR))
        score = F.lit(kind.prior) + F.when(near.rlike(kind.hints), F.lit(30)).otherwise(F.lit(0))
        span = F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), begin.alias("start"), end.alias("end"), score.alias("score"))
        good = kind.confirm(x["m"]) if kind.keep else kind.confirm(x["m"]) & (score >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span).cast(SPAN))).otherwise(acc["out"]).alias("out"))

    return F.when(F.exists(matches, kind.confirm), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def personal_data(docs: DataFrame, text: str = "text", least: int = 60, kinds: Sequence[Kind] = KINDS, keep_text: bool = True) -> DataFrame:
    """Every document (inside ``row``) with ``spans``: kind, rank of the kind, start, end (exclusive), score."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text])
    df = docs.select(row.alias("row"), whole(docs[f"`{text}`"]).alias("__text"))
    df = df.withColumns({f"__m_{k.name}": _found(F.col("__text"), k) for k in kinds})
    parts = [_placed(F.col("__text"), F.col(f"__m_{k.name}"), k, i, least) for i, k in enumerate(kinds)]
    return df.select("row", F.concat(*parts).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        added = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def span_text(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` joined by commas, by kind as listed and then start."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
