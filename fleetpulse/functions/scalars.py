"""Column expressions: text, time, guarded arithmetic, binning and stable hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: interface-name patterns ---------------------------------------------------
DOWNSTREAM_PATTERN = r"(Downstream [\p{Alnum}/]+)"
UPSTREAM_PATTERN = r"[\p{Alnum} .]+/[0-9 .]+/[0-9 .]+$"
# ---------------------------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def downstream_interface(name: Column | str) -> Column:
    """Interface part of a downstream name; NULL when the name has none."""
    return F.regexp_substr(_c(name), F.lit(DOWNSTREAM_PATTERN))


def upstream_interface(name: Column | str) -> Column:
    """Interface part at the end of an upstream name; NULL when the name has none."""
    return F.regexp_substr(_c(name), F.lit(UPSTREAM_PATTERN))


def normal_mac(mac: Column | str) -> Column:
    """A hardware address without colons, upper-cased."""
    return F.upper(F.replace(_c(mac), F.lit(":"), F.lit("")))


def six_hour_window(ts: Column | str) -> Column:
    """0 for hours 18-23 back to 3 for hours 0-5."""
    return (F.lit(3) - F.floor(F.hour(_c(ts)) / 6)).cast("int")


def on_day(ts: Column | str, day: date) -> Column:
    """Timestamp falls on ``day``, as a half-open range that reaches the file scan."""
    start = F.lit(day).cast("timestamp_ntz")
    return (_c(ts) >= start) & (_c(ts) < F.date_add(F.lit(day), 1).cast("timestamp_ntz"))


def day_offset(day: Column | str, day_0: Column | date, limit: int) -> Column:
    """Whole days from ``day`` back from ``day_0`` when inside 0..limit, else NULL."""
    d0 = day_0 if isinstance(day_0, Column) else F.lit(day_0)
    n = F.datediff(d0, _c(day))
    return F.when(n.between(0, limit), n)


def guarded_ratio(num: Column, den: Column) -> Column:
    """``num/den``; 0 wherever the denominator is 0, NULL where it is NULL."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the non-null columns of a row; NULL when all are NULL."""
    # as text: one expression to build instead of a dozen per measure
    names = [f"`{c}`" for c in cols]
    total = " + ".join(f"coalesce({c}, 0D)" for c in names)
    known = " + ".join(f"int({c} IS NOT NULL)" for c in names)
    return F.expr(f"try_divide({total}, {known})")


def mapped(col: Column | str, table: Mapping[str, int]) -> Column:
    """Dictionary lookup; NULL for keys the table lacks."""
    out = None
    for key, value in table.items():
        hit = _c(col) == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out


def binary_label(col: Column | str) -> Column:
    """1 where a problem name is present, 0 where it is NULL."""
    return _c(col).isNotNull().cast("int")


# --- fixed values: problem kinds counted as a failure ----------------------------------------
FAILURE_KINDS = [
    "internet.noconnection.start",
    "internet.interruption.start",
    "internet.performance.start",
]
# ---------------------------------------------------------------------------------------------


def kind_label(col: Column | str, kinds: Sequence[str] = FAILURE_KINDS) -> Column:
    """1 where the name is one of ``kinds``, else 0 (also for NULL)."""
    return F.coalesce(_c(col).isin(*kinds), F.lit(False)).cast("int")


def equal_width_bin(x: Column, low: Column, high: Column, n_bins: int) -> Column:
    """Right-closed bin number 1..n over [low, high]; the minimum falls in bin 1."""
    width = (high - low) / n_bins
    raw = F.ceil((x - low) / width)
    return (
        F.when(x.isNull(), F.lit(None))
        .when(high == low, F.lit(1))
        .otherwise(F.least(F.greatest(raw, F.lit(1)), F.lit(n_bins)))
        .cast("int")
    )


def stable_hash(*parts: Column | str, seed: Column | int = 0) -> Column:
    """Hex digest of the parts and a seed: a reproducible random order for any row set."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", s.cast("string"), *[_c(p).cast("string") for p in parts]))


def hash_number(digest: Column | str) -> Column:
    """The first 32 bits of a digest as a whole number."""
    return F.conv(F.substring(_c(digest), 1, 8), 16, 10).cast("long")


def hash_unit(digest: Column | str) -> Column:
    """A uniform number in [0, 1) from a digest."""
    return hash_number(digest) / F.lit(4294967296.0)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v
    )


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
        )
    )


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One minus the cosine of two arrays; NULL for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
