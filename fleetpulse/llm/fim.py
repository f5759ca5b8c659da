"""Fill-in-the-middle documents, cut at line boundaries through a learned rank index.

A text is cut into lines; its n + 1 boundaries are code point offsets in ascending order. ``RankIndex`` is a
piecewise-linear function from the rank of a boundary to its offset: segments are grown until a line within
``bound`` of every offset no longer exists, and what the line misses is kept in one signed byte per boundary.
A cut is looked up by its rank: the segment predicts the offset and the residual makes it exact. The index is
fitted where the document is read, so nothing is shuffled.

Two ranks, the layout and whether a document is transformed come from a hash of its id. ``psm`` is prefix,
suffix, middle and ``spm`` is suffix, prefix, middle, each part behind its marker.

Defined results: null and empty texts, and texts that hold a marker, stay as they are (``plain``). A null id is
hashed as an empty one. Equal rows give equal results. An empty table gives an empty table. The document's own
columns stay inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetpulse.llm import tokens
from fleetpulse.llm.expressions import whole

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BOUND = 126  # a residual is one signed byte, and rounding may add one


class RankIndex:
    """Rank to offset of ascending offsets, in error-bounded segments with stored residuals."""

    def __init__(self, offsets: np.ndarray, bound: int = BOUND) -> None:
        if not 0 <= bound <= BOUND:
            raise ValueError(f"bound must be within 0 and {BOUND}, not {bound}")
        firsts, slopes = [], []
        at, n = 0, len(offsets)
        while at < n:
            end, slope = self._segment(offsets, at, bound)
            firsts.append(at)
            slopes.append(slope)
            at = end
        self.firsts = np.array(firsts, np.int64)
        self.bases = offsets[self.firsts] if n else np.zeros(0, np.int64)
        self.slopes = np.array(slopes, np.float64)
        self.residuals = (offsets - self._predicted(np.arange(n))).astype(np.int8)

    @staticmethod
    def _segment(offsets: np.ndarray, at: int, bound: int) -> tuple[int, float]:
        """End (exclusive) of the longest segment from ``at``, and its slope. Windows double while a line still fits."""
        low, high, end, size, n = -np.inf, np.inf, at + 1, 32, len(offsets)
        while end < n:
            to = min(n, end + size)
            steps = np.arange(end - at, to - at)
            rise = offsets[end:to] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - bound) / steps), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / steps), high)
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else to - end  # once apart, the limits stay apart
            if fits:
                low, high, end = lows[fits - 1], highs[fits - 1], end + fits
            if fits < to - (end - fits):
                break
            size *= 2
        return end, float(low + high) / 2 if end > at + 1 else 0.0

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.firsts, ranks, "right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.firsts[segment])).astype(np.int64)

    def __call__(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of these ranks."""
        return self._predicted(ranks) + self.residuals[ranks]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For every text of a run, the code point offsets of its line boundaries: 0, after each line, and the end."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    after = np.flatnonzero(data == 0x0A) + 1
    cuts = np.searchsorted(after, offsets, "right")
    for k in range(len(offsets) - 1):
        start, end = offsets[k], offsets[k + 1]
        inner = after[cuts[k] : cuts[k + 1]]
        last = [] if end == start or (len(inner) and inner[-1] == end) else [end]
        yield points[np.concatenate([[start], inner, last]).astype(np.int64)] - points[start]


def laid_out(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Parts hold no marker, and none arises where part and marker meet."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, bound: int = BOUND,
    doc_id: str = "doc_id", text: str = "text", keep_text: bool = True,
) -> DataFrame:
    """Every document (inside ``row``) with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and
    ``segments`` (of its rank index). ``percent`` of the documents are transformed, ``spm_percent`` of these as ``spm``."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text])
    df = docs.select(
        row.alias("row"), whole(docs[f"`{text}`"]).alias("__text"),
        *[h.alias(f"__h{k + 1}") for k, h in enumerate(draws(docs[f"`{doc_id}`"], seed))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, column = batch.column(0), batch.column(1)
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            for at, to, data, offsets in tokens.runs(column):
                out: list[list] = [[] for _ in range(6)]
                texts = column.slice(at, to - at).to_pylist()
                for k, (value, bounds) in enumerate(zip(texts, boundaries(data, offsets), strict=True), at):
                    n = len(bounds) - 1
                    if not value or h[2][k] % 100 >= percent or any(m in value for m in (PREFIX, SUFFIX, MIDDLE)):
                        made = (n, "plain", None, None, value, 0)
                    else:
                        index = RankIndex(bounds, bound)
                        a, b = index(np.sort([h[0][k] % (n + 1), h[1][k] % (n + 1)])).tolist()
                        form = "spm" if h[3][k] % 100 < spm_percent else "psm"
                        made = (n, form, a, b - a, laid_out(form, value[:a], value[a:b], value[b:]), len(index.firsts))
                    for values, x in zip(out, made, strict=True):
                        values.append(x)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                arrays = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, to - at), *arrays], names=names)

    added = StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string, segments long")
    names = ["row", *added.names]
    return df.mapInArrow(work, StructType([df.schema["row"], *added.fields]))
