"""Stupid-backoff scores of documents against the counts of their own corpus.

Words and n-grams are hashed to 64 bits. Hashes are cut into ranges by their upper bits: a range is one
partition of the count table and keeps 48 further bits of each hash, sorted. Documents are dealt into
chunks by hash. A chunk sends its distinct n-grams to their ranges, packed in one row per range; a range
adds up the counts of each n-gram over all its rows and answers every chunk with the totals of the
chunk's n-grams in sorted order. A chunk then has the counts of all its n-grams and scores its
documents. The texts are shuffled once: both steps read the same exchange.

Counts leave the scored document out: its own occurrences are subtracted, so that an n-gram of no other
document backs off. For words a b the score of b is ln(c(ab) / c(a)) if the pair occurs elsewhere, else
ln(``alpha`` * max(c(b), 1) / N), where N is the number of words of all other documents; the first word
takes ln(max(c(b), 1) / N). With a larger ``order`` longer contexts are tried first.

A frequent n-gram is one entry per chunk, and a document is never split, so no key overloads a task.

Defined results: null and empty texts have no words and a score of 0. Equal rows are separate documents.
When there is no other document N is 1. An empty table gives an empty table. Columns of the input other
than id and text are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import tokens
from fleetpulse.llm.expressions import whole
from fleetpulse.llm.store import stage

_U = np.uint64
_LOW = 48


def _pack(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(_U)


def _grams(words: np.ndarray, counts: np.ndarray, order: int, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: the n-grams as ``keep`` upper bits of their hashes, and how many each text has."""
    out = []
    for n in range(1, order + 1):
        grams, have = tokens.ngrams(words, counts, n)
        out.append((grams >> _U(64 - keep), have))
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [tokens.word_hashes(data, offsets) for _, _, data, offsets in tokens.runs(column)]
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _requests(docs: DataFrame, order: int, bits: int, flush_bytes: int) -> DataFrame:
    """Rows ``range, chunk, keys, counts``: the distinct n-grams of a chunk (of each part of it, if it is large)."""
    keep = bits + _LOW

    def emit(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])
        rows: tuple[list, list, list, list] = ([], [], [], [])
        at = 0
        while at < len(held):
            to = at
            while to < len(held) and held[to][0] == held[at][0]:
                to += 1
            keys, counts = np.unique(np.concatenate([h[1] for h in held[at:to]]), return_counts=True)
            ranges = (keys >> _U(_LOW)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for column, value in zip(rows, (int(ranges[a]), held[at][0], _pack(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()), strict=True):
                    column.append(value)
            at = to
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
            names=["range", "chunk", "keys", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for first, to, data, offsets in tokens.runs(batch.column(2)):
                words, counts = tokens.word_hashes(data, offsets)
                for grams, have in _grams(words, counts, order, keep):
                    chunk = np.repeat(chunks[first:to], have)
                    turn = np.argsort(chunk, kind="stable")
                    grams, chunk = grams[turn], chunk[turn]
                    cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else [0]
                    held.extend((int(chunk[a]), grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
                size += len(data)
                if size >= flush_bytes:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return docs.mapInArrow(work, "range int, chunk int, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """Rows ``chunk, range, width, totals``: counts over all chunks of each n-gram of the chunk, sorted by
    n-gram, as integers of 4 bytes, or 8 where those are too short."""
    rows = requests.repartition("range").sortWithinPartitions("range")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tokens.grouped(batches, "range"):
            ranges = table.column("range").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                keys = [_unpack(k.as_py()) for k in part.column("keys")]
                counts = [np.frombuffer(c.as_py(), np.uint32) for c in part.column("counts")]
                chunks = part.column("chunk").to_numpy()
                every, place = np.unique(np.concatenate(keys), return_inverse=True)
                totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.uint64)
                width = 4 if totals.max() < 2**32 else 8
                totals = totals.astype(f"u{width}")
                ends = np.cumsum([len(k) for k in keys])
                places = [place[e - len(k) : e] for k, e in zip(keys, ends, strict=True)]
                names = np.unique(chunks)
                answers = [totals[np.unique(np.concatenate([places[i] for i in np.flatnonzero(chunks == c)]))].tobytes() for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array(np.full(len(names), ranges[a]), pa.int32()), pa.array(np.full(len(names), width), pa.int32()),
                     pa.array(answers, pa.binary())],
                    names=["chunk", "range", "width", "totals"])

    return rows.mapInArrow(work, "chunk int, range int, width int, totals binary")


def _scores(words: np.ndarray, counts: np.ndarray, totals: np.ndarray, order: int, keep: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the score without its N terms, how many terms need N, and how many words backed off."""
    grams = _grams(words, counts, order, keep)
    every = np.unique(np.concatenate([g for g, _ in grams]))
    docs = np.arange(len(counts))
    rest = []  # for each order, the counts outside the document, by n-gram
    for g, have in grams:
        place = np.searchsorted(every, g)
        owner = np.repeat(docs, have)
        both, inverse, own = np.unique(owner * len(every) + place, return_inverse=True, return_counts=True)
        rest.append(totals[place].astype(np.float64) - own[inverse])
    n = len(words)
    firsts = np.cumsum(counts) - counts
    position = np.arange(n) - np.repeat(firsts, counts)
    score = np.log(np.maximum(rest[0], 1))  # unigram, still to be divided by N
    needs = np.ones(n, bool)
    backed = np.zeros(n, np.int64)
    for k in range(1, order):
        word = np.flatnonzero(position >= k)  # last words of the (k + 1)-grams, in the same order
        seen = rest[k] > 0
        context_end = word - 1
        held = np.flatnonzero(position >= k - 1)
        context = rest[k - 1][np.searchsorted(held, context_end)]
        score[word] += math.log(alpha)
        backed[word] += 1
        score[word[seen]] = np.log(rest[k][seen]) - np.log(context[seen])
        needs[word[seen]] = False
        backed[word[seen]] = 0
    owner = np.repeat(docs, counts)
    size = len(counts)
    return (np.bincount(owner, score, size), np.bincount(owner, needs, size).astype(np.int64),
            np.bincount(owner, backed > 0, size).astype(np.int64))


def backoff_scores(
    docs: DataFrame, order: int = 2, alpha: float = 0.4, chunk_bytes: int = 6_000_000, range_bytes: int = 16_000_000,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_backed`` (words scored by a shorter context),
    ``log_score`` (sum over words, natural logarithm) and ``mean_log_score``."""
    df = docs.select(docs[f"`{doc_id}`"].alias("id"), whole(docs[f"`{text}`"]).alias("__text"))
    total = df.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    bits = max(1, math.ceil(math.log2(max(2, total / range_bytes))))
    keep = bits + _LOW
    df = df.select(F.pmod(F.xxhash64("id", "__text"), F.lit(chunks)).cast("int").alias("chunk"), "id", "__text")
    df = df.repartition(chunks, "chunk")
    answers = _answers(_requests(df, order, bits, flush_bytes=chunk_bytes))
    kind = df.schema["id"].dataType.simpleString()

    def score(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        by_range = np.argsort(ranges.column("range").to_numpy())
        parts = [np.frombuffer(ranges.column("totals")[int(i)].as_py(), f"u{ranges.column('width')[int(i)]}") for i in by_range]
        totals = np.concatenate(parts) if parts else np.zeros(0)
        column = texts.column("__text").combine_chunks()
        words, counts = _words(column)
        if not len(words):
            zero = np.zeros(len(column))
            sums, needs, backed = zero, zero.astype(np.int64), zero.astype(np.int64)
        else:
            sums, needs, backed = _scores(words, counts, totals, order, keep, alpha)
        return pa.table({"id": texts.column("id"), "n_words": pa.array(counts, pa.int64()), "sums": pa.array(sums, pa.float64()),
                         "needs": pa.array(needs, pa.int64()), "n_backed": pa.array(backed, pa.int64())})

    scored = df.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"id {kind}, n_words long, sums double, needs long, n_backed long")
    scored = stage(scored, "backoff-scores")
    n = scored.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(n) - F.col("n_words"), F.lit(1))
    log_score = F.col("sums") - F.col("needs") * F.log(others)
    return scored.select("id", "n_words", "n_backed", log_score.alias("log_score"),
                         F.when(F.col("n_words") > 0, log_score / F.greatest("n_words", F.lit(1))).alias("mean_log_score"))
