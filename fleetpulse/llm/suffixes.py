"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Texts are UTF-8 bytes. Sorting every suffix of a corpus would move eight bytes or more for each byte of
text, so the arrays hold a sample of the suffixes that content alone chooses: of all suffixes that start
inside a window of ``length`` bytes and have ``PROBE`` bytes in it, the one with the least hash, leftmost
first. Equal windows choose the same suffix, so a repeated window shows as a repeated sampled suffix.
Suffixes are ordered by a 64-bit hash of their first ``PROBE`` bytes, which any sorted order of equal
prefixes serves as well as the lexicographic one. A hash of the whole stretch that the windows of a suffix
span goes along.

Documents come in batches. Each batch becomes a sorted array; it is merge-scanned against every existing
level for suffixes that both have, and becomes a level of its own; two levels of the same rank merge into
one of the next, so n batches leave log2(n) levels and a suffix is rewritten log2(n) times. The scans find
the repeated suffixes. Of those, some repeat with their whole stretch, and so do all its windows. For the
others, where a copy ends or begins, the windows are compared one by one by hash among the stretches of
equal suffixes.

Defined results: a null text is empty. Texts shorter than ``length`` keep all bytes. Matches never cross
texts; both copies of a repeat go, overlapping or not; equal texts repeat each other. Results are per
distinct text and joined back to every row. An empty table gives an empty table. The document's own
columns stay inside ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import tokens
from fleetpulse.llm.expressions import whole
from fleetpulse.llm.store import Staged, likely, stage

PROBE = 64
CROWD = 50_000  # stretches of one suffix that are compared inside one task
_U = np.uint64


def _window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    done, best = 1, values
    while done * 2 <= size:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    rest = size - done
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, probe: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of one run: text number, position, first and last window start (all but the
    number relative to the text), hash of the probe and hash of the stretch."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.view(_U), empty.view(_U)
    spans = tokens.SpanHash(data)
    low = _U(0xFFFFFFFF)  # the upper half of a hash ranks a suffix, its position breaks ties
    rank = (spans.all_of(probe) & ~low) | np.arange(len(data) - probe + 1, dtype=_U)
    chosen = (_window_minimum(rank, length - probe + 1) & low).astype(np.int64)  # by window start
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.repeat(offsets[:-1], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    if not len(start):
        return empty, empty, empty, empty, empty.view(_U), empty.view(_U)
    at = chosen[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    doc, at, lo, hi = doc[new], at[new], start[new], start[last]
    stretch = spans.of(lo, hi + length) ^ tokens.mix((at - lo).astype(_U))
    base = offsets[doc]
    return doc, at - base, lo - base, hi - base, spans.of(at, at + probe), stretch


def suffix_table(docs: DataFrame, text: str, length: int, probe: int) -> DataFrame:
    """Rows ``t, t2`` (128 bits of the text), ``key``, ``seg``, ``at, lo, hi`` of all sampled suffixes."""
    df = docs.select(whole(docs[f"`{text}`"]).alias("__text")).where(F.octet_length("__text") >= length)
    df = df.select(F.xxhash64("__text").alias("t"), F.xxhash64(F.lit(1), "__text").alias("t2"), "__text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in tokens.runs(batch.column(2)):
                doc, at, lo, hi, key, seg = sampled(data, offsets, length, probe)
                doc = doc + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[doc]), pa.array(t2[doc]), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)),
                     *[pa.array(x.astype(np.int32)) for x in (at, lo, hi)]],
                    names=["t", "t2", "key", "seg", "at", "lo", "hi"])

    return df.mapInArrow(work, "t long, t2 long, key long, seg long, at int, lo int, hi int")


@dataclass
class SuffixFamily:
    """Levels of sorted suffix arrays, and the repeated suffixes that their scans have found."""

    spark: SparkSession
    levels: list[tuple[int, Staged]] = field(default_factory=list)  # rank and array, largest first
    found: list[Staged] = field(default_factory=list)

    @staticmethod
    def _sorted(df: DataFrame) -> Staged:
        """An array: each suffix and how often it occurs, in ranges of hashes, sorted."""
        return Staged(df.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "suffix-array")

    def ingest(self, suffixes: DataFrame) -> None:
        """Add a batch (rows of ``suffix_table``): scan it against all levels, then make it a level."""
        array = self._sorted(suffixes.groupBy("key").agg(F.count("*").alias("n")))
        found = array.df.where("n > 1").select("key")
        for _, level in self.levels:  # both sides are sorted by the suffix and merged
            found = found.unionByName(array.df.select("key").join(level.df.select("key").hint("merge"), "key"))
        self.found.append(Staged(found.distinct(), "suffix-found"))
        self.levels.append((0, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._sorted(a.df.unionByName(b.df))))
            a.discard()
            b.discard()

    def repeated(self) -> DataFrame:
        """Suffixes (``key``) that occur at least twice in all batches."""
        found = self.found[0].df
        for f in self.found[1:]:
            found = found.unionByName(f.df)
        return found.distinct()


def _stretches(docs: DataFrame, per_text: DataFrame, text: str, length: int) -> DataFrame:
    """Bytes of the stretches whose windows must be compared: ``key, crowd, t, t2, lo, bytes``."""
    texts = docs.select(whole(docs[f"`{text}`"]).alias("__text")).where(F.octet_length("__text") >= length)
    texts = texts.withColumns({"__t": F.xxhash64("__text"), "__t2": F.xxhash64(F.lit(1), "__text")})
    texts = likely(texts, F.col("__t"), per_text, F.col("t")).where("likely")
    joined = texts.join(per_text.hint("merge"), (F.col("__t") == F.col("t")) & (F.col("__t2") == F.col("t2"))).select("t", "t2", F.encode("__text", "UTF-8").alias("b"), "parts")
    cut = lambda p: F.struct(
        p["key"].alias("key"), p["crowd"].alias("crowd"), p["lo"].alias("lo"),
        F.substring(F.col("b"), p["lo"] + 1, p["hi"] - p["lo"] + length).alias("bytes"))
    return joined.select("t", "t2", F.explode(F.transform("parts", cut)).alias("p")).select("t", "t2", "p.*")


def _window_hashes(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each stretch: its hash, the row of the stretch, and its start in the text."""
    hashes, owners, starts = [], [], []
    column = table.column("bytes").combine_chunks()
    lows = table.column("lo").to_numpy()
    for first, to, data, offsets in tokens.runs(column):
        spans = tokens.SpanHash(data).all_of(length)
        counts = np.diff(offsets) - length + 1
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes.append(spans[np.repeat(offsets[:-1], counts) + inside])
        owners.append(np.repeat(np.arange(first, to), counts))
        starts.append(np.repeat(lows[first:to], counts) + inside)
    return np.concatenate(hashes), np.concatenate(owners), np.concatenate(starts)


def _compared(stretches: DataFrame, length: int) -> DataFrame:
    """Windows that equal another one among stretches of the same suffix: ``t, t2, lo, hi`` (starts)."""
    rows = stretches.where("NOT crowd").repartition("key").sortWithinPartitions("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tokens.grouped(batches, "key"):
            hashes, owners, starts = _window_hashes(table, length)
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            twice = np.zeros(len(hashes), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            owners, starts = owners[twice], starts[twice]
            if not len(owners):
                continue
            new = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (starts[1:] != starts[:-1] + 1)]))
            last = np.concatenate([new[1:], [len(owners)]]) - 1
            t, t2 = table.column("t").to_numpy(), table.column("t2").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[owners[new]]), pa.array(t2[owners[new]]), pa.array(starts[new].astype(np.int32)), pa.array(starts[last].astype(np.int32))],
                names=["t", "t2", "lo", "hi"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                hashes, owners, starts = _window_hashes(table, length)
                t, t2 = table.column("t").to_numpy(), table.column("t2").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(t[owners]), pa.array(t2[owners]), pa.array(starts.astype(np.int32))],
                    names=["w", "t", "t2", "lo"])

    small = rows.mapInArrow(work, "t long, t2 long, lo int, hi int")
    crowd = stretches.where("crowd").mapInArrow(explode, "w long, t long, t2 long, lo int")
    twice = crowd.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return small.unionByName(crowd.join(twice, "w").select("t", "t2", "lo", F.col("lo").alias("hi")))


def repeated_spans(docs: DataFrame, length: int = 400, probe: int = PROBE, batches: int = 4, text: str = "text") -> DataFrame:
    """Per distinct text with a repeat (``t, t2``): ``starts``, ranges (lo, hi) of starts of repeated windows.
    The result is written; what led to it is deleted."""
    written: list[Staged] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        written.append(Staged(df, name))
        return written[-1].df

    suffixes = keep(suffix_table(docs, text, length, probe), "suffix-table")
    family = SuffixFamily(docs.sparkSession)
    for b in range(batches):
        family.ingest(suffixes.where(F.pmod("t", F.lit(batches)) == b))
    keys = keep(family.repeated(), "suffix-keys")
    written += [array for _, array in family.levels] + family.found
    again = likely(suffixes, F.col("key"), keys, F.col("key")).where("likely").drop("likely")
    again = keep(again.join(keys.hint("merge"), "key", "left_semi"), "suffix-again")
    # the same stretch twice: all of its windows are repeated
    twice = again.groupBy("key", "seg").agg(F.count("*").alias("n")).where("n > 1").select("key", "seg", F.lit(True).alias("twice"))
    twice = keep(twice, "suffix-twice")  # counted before the join, which can then deal out a crowded stretch
    again = keep(again.join(twice.hint("merge"), ["key", "seg"], "left"), "suffix-marked")
    full, part = again.where("twice"), again.where("twice IS NULL").drop("twice")
    crowds = part.groupBy("key").agg((F.count("*") > CROWD).alias("crowd"))
    # windows of the other stretches may also equal windows inside those: one of each is compared too
    sample = (
        full.groupBy("key", "seg").agg(F.min(F.struct("t", "t2", "lo", "hi")).alias("m"))
        .join(crowds.select("key").hint("merge"), "key", "left_semi").select("key", "m.*")
    )
    open_ = (part.select("key", "t", "t2", "lo", "hi").unionByName(sample).join(crowds.hint("merge"), "key"))
    per_text = keep(open_.groupBy("t", "t2").agg(F.collect_list(F.struct("key", "crowd", "lo", "hi")).alias("parts")), "suffix-parts")
    compared = _compared(_stretches(docs, per_text, text, length), length)
    whole_ones = full.select("t", "t2", "lo", "hi").distinct()
    spans = stage(whole_ones.unionByName(compared).groupBy("t", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "suffix-spans")
    for table in written:
        table.discard()
    return spans


def _merged(starts: list[dict] | None, length: int) -> list[list[int]]:
    """Maximal runs of bytes (end exclusive) that windows cover."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in starts or []):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def without_repeats(
    docs: DataFrame, length: int = 400, probe: int = PROBE, batches: int = 4, text: str = "text", keep_text: bool = True,
    passage_bytes: int | None = None, passage_words: int = 50,
) -> DataFrame:
    """Every document (inside ``row``) with ``n_bytes``, ``spans`` (removed bytes, end exclusive),
    ``n_removed``, ``kept_sha256`` and, with ``keep_text``, ``kept``: the remaining bytes.

    With ``passage_bytes`` repeats of so many bytes are searched as well, without being removed: ``n_passages``
    counts their maximal runs of over ``passage_words`` words, and ``n_passage_words`` the words of these. A
    passage of shorter words than ``passage_bytes`` allows for is not counted."""
    spans = repeated_spans(docs, length, probe, batches, text)
    if passage_bytes is not None:
        close = repeated_spans(docs, passage_bytes, probe, 1, text).withColumnRenamed("starts", "close")
        spans = stage(spans.join(close.hint("merge"), ["t", "t2"], "full"), "suffix-spans")
    else:
        spans = spans.withColumn("close", F.lit(None).cast(spans.schema["starts"].dataType))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text])
    df = docs.select(row.alias("row"), whole(docs[f"`{text}`"]).alias("__text"))
    df = df.withColumns({"__t": F.xxhash64("__text"), "__t2": F.xxhash64(F.lit(1), "__text")})
    df = likely(df, F.col("__t"), spans, F.col("t"))
    same = (F.col("__t") == F.col("t")) & (F.col("__t2") == F.col("t2"))
    whole_text = F.encode("__text", "UTF-8").alias("bytes")
    # only texts that may have spans travel to them
    none = F.lit(None).cast(spans.schema["starts"].dataType)
    df = df.where("likely").join(spans.hint("merge"), same, "left").select("row", whole_text, "starts", "close").unionByName(
        df.where("NOT likely").select("row", whole_text, none.alias("starts"), none.alias("close")))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    extra = ["n_passages", "n_passage_words"] if passage_bytes is not None else []
    names = ["row", "n_bytes", "n_removed", "kept_sha256", "spans", *(["kept"] if keep_text else []), *extra]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: list[list] = [[], [], [], [], [], [], []]
            for value, starts, close in zip(*batch.columns[1:], strict=True):
                data = value.as_py()
                cut = _merged(starts.as_py(), length)
                counts = [len(data[a:b].split()) for a, b in _merged(close.as_py(), passage_bytes or 0)]
                long = [n for n in counts if n > passage_words]
                edges = [0, *[x for c in cut for x in c], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for values, v in zip(out, (len(data), len(data) - len(kept), hashlib.sha256(kept).hexdigest(),
                                           [{"start": a, "end": b} for a, b in cut], kept, len(long), sum(long)), strict=True):
                    values.append(v)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], kind)]
            if keep_text:
                arrays.append(pa.array(out[4], pa.binary()))
            if extra:
                arrays += [pa.array(out[5], pa.int64()), pa.array(out[6], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    schema = f"row {df.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    return df.mapInArrow(work, schema + (", kept binary" if keep_text else "") + "".join(f", {c} long" for c in extra))
