"""Hashes of words, n-grams and byte strings over whole Arrow columns of text, in numpy.

A column is cut into runs of whole texts of about ``STEP`` bytes; a longer text is a run of its own.
Hashes are polynomial in the bytes modulo 2**64, so the hash of any span follows from two prefix sums.
They depend on content only and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers = [np.ones(1, _U), np.ones(1, _U)]  # of the base and of its inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            full = np.full(n, b, _U)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers


def runs(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of texts without nulls."""
    values = column.cast(pa.large_binary())
    n = len(values)
    if not n:
        return
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class SpanHash:
    """Hashes of byte spans of one run."""

    def __init__(self, data: np.ndarray) -> None:
        powers = _power(len(data) + 1)
        self.inverse = powers[1]
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * powers[0][: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))

    def all_of(self, size: int) -> np.ndarray:
        """Hash of every span of this size, by its start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space separated word, and the number of words of each text."""
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)  # a word starts here, or the one before has ended
    edge[:1], edge[-1:] = True, True
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    kept = solid[cuts[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = cuts[:-1][kept], cuts[1:][kept]
    counts = np.diff(np.searchsorted(starts, offsets))
    return SpanHash(data).of(starts, ends), counts


def ngrams(words: np.ndarray, counts: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside each text, and how many each has. With ``whole_short`` a text of
    fewer words, but not none, has one n-gram of all its words."""
    m = len(words)
    out = np.zeros(max(m - n + 1, 0), _U)
    for k in range(n):
        out = out * _U(_BASE) + words[k : m - n + 1 + k] if m >= n else out
    out = mix(out + _U(n))
    have = np.maximum(counts - n + 1, 0)
    firsts = np.cumsum(counts) - counts
    inside = np.repeat(firsts, have) + (np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have))
    out = out[inside]
    if not whole_short or not ((counts > 0) & (counts < n)).any():
        return out, have
    short = np.flatnonzero((counts > 0) & (counts < n))
    value = np.zeros(len(short), _U)
    for j, d in enumerate(short):
        one = _U(0)
        with np.errstate(over="ignore"):
            for w in words[firsts[d] : firsts[d] + counts[d]]:
                one = one * _U(_BASE) + w
        value[j] = one
    value = mix(value + counts[short].astype(_U))
    total = have.copy()
    total[short] = 1
    return np.insert(out, (np.cumsum(have) - have)[short], value), total


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``: equal keys stay together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key))
        end = keys[-1].as_py()
        if held and keys[0].as_py() == last == end:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], "left")) if values[0] != values[-1] else 0
        head = int(np.searchsorted(values, last, "right")) if held and keys[0].as_py() == last else 0
        if cut or head or held:
            first = [*held, batch.slice(0, max(cut, head))] if max(cut, head) else held
            yield pa.Table.from_batches(first)
        held = [batch.slice(max(cut, head))]
        last = end
        if not held[0].num_rows:
            held = []
    if held:
        yield pa.Table.from_batches(held)
