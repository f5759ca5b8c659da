"""Column expressions shared by the text operators. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ratio(part: Column, total: Column, scale: int) -> Column:
    """``scale * part / total`` rounded down; 0 where the total is 0."""
    return F.when(total > 0, F.floor(F.try_divide(F.lit(scale) * part, total))).otherwise(F.lit(0)).cast("long")


def coarse(value: Column, bits: int = 6) -> Column:
    """Lower edge of the value's bucket in a log-linear histogram: exact below ``2**bits``, then
    ``2**(bits-1)`` buckets for each power of two. Takes non-negative longs."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(bits), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def uniform(seed: int, *cols: Column) -> Column:
    """A number inside (0, 1) that depends on the seed and the values only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
