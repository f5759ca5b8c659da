"""Phrase collocations by Rabin-Karp fingerprints.

Texts (A-Z in lower case) are cut into pieces at stops and line ends, pieces into words. Everything is counted
per language. Prefix polynomials over the bytes of a run of texts give the hash of every word, prefix polynomials
over the word hashes the fingerprint of every n-gram. The language is mixed into the fingerprint, so a counted
n-gram is one long.

One scan of the texts per size of n-gram: a task counts its fingerprints in numpy and hands on one row for each,
with a second, independent fingerprint and a pointer to an occurrence (document and byte). The rows are added up
by fingerprint, and those that occur often enough are the frequent n-grams of that size. An n-gram is counted only
if both n-grams of one word less inside it may be frequent, by bits that the frequent fingerprints set in a map of
at most ``MARK_BITS`` bits. A full map spares nothing and loses nothing: what is counted too much is dropped after.

Only frequent phrases are materialised: each from the document that its pointer names. A fingerprint whose second
fingerprints differ is a collision; its occurrences are counted again by their words in one more scan.

Parts of phrases, scores and containment are joins of the frequent phrases with each other. Each is at least as
frequent as the phrase it is part of, so no other counts are needed.

Defined results: null and empty texts have no words. A null language is ``und``. Repeated rows count each time. An
empty table gives an empty table. Columns other than id, text and language are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm import tokens
from fleetpulse.llm.expressions import whole
from fleetpulse.llm.store import likely, stage

MARK_BITS = 26  # the map of frequent fingerprints has at most 2 ** 26 bits, 8 MB
PARTS = 16
HELD = 1_500_000  # n-grams that a task counts before it hands rows on
_U = np.uint64
_STOPS = b".,;:!?\n\x0b\x0c\r"
_GAPS = b" \t"
_SKIPPED = np.zeros(256, bool)
_SKIPPED[list(_STOPS + _GAPS)] = True
_STOP = np.zeros(256, bool)
_STOP[list(_STOPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ONE = rb"[^ \t.,;:!?\n\x0b\x0c\r]+"


class Polynomial:
    """Prefix polynomials modulo 2**64: the hash of every span of a sequence from two of its prefix sums."""

    _powers: dict[int, list[np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        if base not in self._powers or len(self._powers[base][0]) < n + 1:
            pair = []
            for b in (base, pow(base, -1, 2**64)):
                full = np.full(n + 1, b, _U)
                full[0] = 1
                pair.append(np.multiply.accumulate(full))
            self._powers[base] = pair
        up, self.down = self._powers[base]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


#: two independent families: byte values, base over bytes, base over words
_FAMILIES = [
    (tokens.mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)), 0xA0761D6478BD642F, 0xE7037ED1A0B428DB),
    (tokens.mix(np.arange(1, 257, dtype=_U) * _U(0xFF51AFD7ED558CCD)), 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3),
]


class Grams:
    """The words of one run of texts, and the fingerprints of their n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, bits: int = 64) -> None:
        data = _LOWER[data]
        solid = ~_SKIPPED[data]
        edge = np.empty(len(data) + 1, bool)
        edge[:1], edge[-1:] = True, True
        edge[1:-1] = solid[1:] != solid[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        kept = solid[cuts[:-1]] if len(data) else np.zeros(0, bool)
        starts, ends = cuts[:-1][kept], cuts[1:][kept]
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.at = starts - offsets[self.doc]
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        piece = stops[starts] + self.doc  # a new document is a new piece
        self.piece, self.lang, self.mask = piece, lang, _U(2**bits - 1) if bits < 64 else _U(2**64 - 1)
        self.words = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.families = []
        for values, over_bytes, over_words in _FAMILIES:
            word = tokens.mix(Polynomial(values[data], over_bytes | 1).of(starts, ends) + (ends - starts).astype(_U))
            self.families.append(Polynomial(word, over_words | 1))

    def inside(self, size: int) -> np.ndarray:
        """First words of the n-grams of this size that lie inside a piece."""
        m = max(len(self.piece) - size + 1, 0)
        return np.flatnonzero(self.piece[:m] == self.piece[size - 1 : size - 1 + m])

    def _of(self, k: int, firsts: np.ndarray, size: int) -> np.ndarray:
        lang = self.lang[self.doc[firsts]] * _U(2 * k + 1)
        return tokens.mix(self.families[k].of(firsts, firsts + size) + lang + _U(size))

    def fingerprints(self, firsts: np.ndarray, size: int) -> np.ndarray:
        return self._of(0, firsts, size) & self.mask

    def checks(self, firsts: np.ndarray, size: int) -> np.ndarray:
        return (self._of(1, firsts, size) >> _U(32)).astype(np.uint32)


def _totals(grams: Grams, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the phrase without words, which every word of a language counts for."""
    lang = grams.lang[texts]
    return tokens.mix(lang) & grams.mask, (tokens.mix(lang * _U(3) + _U(1)) >> _U(32)).astype(np.uint32)


def _marked(marks: np.ndarray | None, fingerprints: np.ndarray) -> np.ndarray:
    if marks is None:
        return np.ones(len(fingerprints), bool)
    spot = fingerprints & _U(len(marks) * 64 - 1)
    return (marks[spot >> _U(6)] >> (spot & _U(63))) & _U(1) == 1


def _map_of(frequent: DataFrame) -> np.ndarray:
    """The bits that the fingerprints ``fp`` set; about 16 bits for each, at most ``2 ** MARK_BITS`` in all."""
    bits = min(max((16 * frequent.count() - 1).bit_length(), 12), MARK_BITS)
    spot = F.col("fp").bitwiseAND(2**bits - 1)
    words = frequent.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(fp & {2**bits - 1} & 63 as int))").alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (MARK_BITS - 6) rows
    marks = np.zeros(2 ** (bits - 6), _U)
    marks[table.column("w").to_numpy()] = table.column("b").to_numpy().view(_U)
    return marks


def _documents(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``text``, ``lang``, its hash ``lh``, and ``place``, a hash of the whole row that pointers name."""
    df = docs.select(
        docs[f"`{doc_id}`"].alias("id"), whole(docs[f"`{text}`"]).alias("text"),
        F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("und")).alias("lang"))
    return df.select("text", "lang", F.xxhash64("lang").alias("lh"), F.xxhash64("id", "lang", "text").alias("place"))


class _Counter:
    """N-grams of a task, counted whenever ``HELD`` have come together."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(arrays)
        self.rows += len(arrays[0])
        if self.rows >= HELD:
            yield from self.counted()

    def counted(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        fp, check, n, place, at = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order = np.lexsort((check, fp))
        fp, check = fp[order], check[order]
        first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
        out = pa.RecordBatch.from_arrays(
            [pa.array(fp[first].view(np.int64)), pa.array(check[first].view(np.int32)), pa.array(np.add.reduceat(n[order], first)),
             pa.array(place[order][first]), pa.array(at[order][first])], names=["fp", "chk", "n", "place", "at"])
        for k in range(0, out.num_rows, 50_000):
            yield out.slice(k, 50_000)


def _counts(docs: DataFrame, size: int, parts: Broadcast | None, bits: int) -> DataFrame:
    """Per fingerprint of the n-grams of one size: ``fp, n, chk, chk2`` (least and largest second fingerprint) and the
    pointer ``place, at``. With single words go the phrases without words, one a language, at -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if parts is None else parts.value
        counter = _Counter()
        for batch in batches:
            lang, place = (batch.column(c).to_numpy() for c in (1, 2))
            for at, to, data, offsets in tokens.runs(batch.column(0)):
                grams, mine = Grams(data, offsets, lang[at:to].view(_U), bits), place[at:to]
                firsts = grams.inside(size)
                if marks is not None:
                    firsts = firsts[_marked(marks, grams.fingerprints(firsts, size - 1))]
                    firsts = firsts[_marked(marks, grams.fingerprints(firsts + 1, size - 1))]
                yield from counter.add(
                    grams.fingerprints(firsts, size), grams.checks(firsts, size), np.ones(len(firsts), np.int64), mine[grams.doc[firsts]],
                    grams.at[firsts])
                if size == 1:
                    texts = np.flatnonzero(grams.words)
                    yield from counter.add(*_totals(grams, texts), grams.words[texts].astype(np.int64), mine[texts], np.full(len(texts), -1))
        yield from counter.counted()

    rows = docs.select("text", "lh", "place").mapInArrow(work, "fp long, chk int, n long, place long, at long")
    return rows.groupBy("fp").agg(
        F.sum("n").alias("n"), F.min("chk").alias("chk"), F.max("chk").alias("chk2"), F.max("place").alias("place"), F.max_by("at", "place").alias("at"))


def _texts_at(docs: DataFrame, pointers: DataFrame) -> DataFrame:
    """``lang, size, phrase, n`` of pointers ``size, fp, n, place, at``: the words that stand there."""
    # a document has no more pointers than n-grams
    by_doc = pointers.groupBy("place").agg(F.collect_list(F.struct("size", "fp", "n", "at")).alias("found"))
    texts = likely(docs.select("place", "lang", "text"), F.col("place"), by_doc, F.col("place")).where("likely").drop("likely")
    df = texts.join(by_doc.hint("merge"), "place").select("lang", "text", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[int, re.Pattern] = {}
        for batch in batches:
            rows: list[tuple] = []
            for lang, text, found in zip(*batch.columns, strict=True):
                data = _LOWER[np.frombuffer(text.cast(pa.large_string()).as_buffer(), np.uint8)].tobytes() if len(text.as_buffer()) else b""
                where, values = lang.as_py(), found.values
                for size, fp, n, at in zip(*(values.field(k).to_pylist() for k in range(4)), strict=True):
                    phrase = ""
                    if size:
                        if size not in patterns:
                            patterns[size] = re.compile(rb"[ \t]+".join([_ONE] * size))
                        phrase = b" ".join(patterns[size].match(data, at)[0].split()).decode()
                    rows.append((where, size, fp, phrase, n))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "size", "fp", "phrase", "n"])

    found = df.mapInArrow(work, "lang string, size int, fp long, phrase string, n long")
    # equal rows have one place and give the same phrase
    return found.groupBy("size", "fp").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"), F.min("n").alias("n")).select("lang", "size", "phrase", "n")


def _recounted(docs: DataFrame, collided: DataFrame, sizes: list[int], least: int, bits: int) -> DataFrame:
    """The same for collided fingerprints: their occurrences, counted by their words."""
    shipped = docs.sparkSession.sparkContext.broadcast(_map_of(collided))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lh = batch.column(1), batch.column(2).to_numpy()
            for at, to, data, offsets in tokens.runs(batch.column(0)):
                grams = Grams(data, offsets, lh[at:to].view(_U), bits)
                low = _LOWER[data].tobytes()
                out: list[list] = [[], [], [], [], []]

                def put(fp: np.ndarray, size: int, docs_of: np.ndarray, phrases: list[str], n: np.ndarray) -> None:
                    values = [fp.view(np.int64).tolist(), [size] * len(fp), [langs[int(at + d)].as_py() for d in docs_of], phrases, n.tolist()]
                    for column, new in zip(out, values, strict=True):
                        column.extend(new)

                for size in sizes:
                    if size == 0:
                        texts = np.flatnonzero(grams.words)
                        fp, _ = _totals(grams, texts)
                        hit = _marked(shipped.value, fp)
                        put(fp[hit], 0, texts[hit], [""] * int(hit.sum()), grams.words[texts[hit]])
                        continue
                    firsts = grams.inside(size)
                    fp = grams.fingerprints(firsts, size)
                    hit = _marked(shipped.value, fp)
                    firsts, fp = firsts[hit], fp[hit]
                    pattern = re.compile(rb"[ \t]+".join([_ONE] * size))
                    spots = (grams.at + offsets[grams.doc])[firsts]
                    put(fp, size, grams.doc[firsts], [b" ".join(pattern.match(low, int(s))[0].split()).decode() for s in spots], np.ones(len(fp), np.int64))
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["fp", "size", "lang", "phrase", "n"])

    rows = docs.select("text", "lang", "lh").mapInArrow(work, "fp long, size int, lang string, phrase string, n long")
    rows = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"), F.min("fp").alias("fp"))
    return rows.where(F.col("n") >= least).join(collided.hint("merge"), "fp", "left_semi").select("lang", "size", "phrase", "n")


def frequent_phrases(
    docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 64, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, size, phrase, n`` of all phrases of up to ``longest`` words (joined by spaces) that occur ``least`` times
    or more, and with size 0 the number of words of the language. ``bits`` shortens fingerprints, for tests of collisions."""
    df = _documents(docs, doc_id, text, lang)
    context = docs.sparkSession.sparkContext
    parts, out, clashes = None, None, []
    for size in range(1, longest + 1):
        often = stage(_counts(df, size, parts, bits).where(F.col("n") >= least), "phrases-counts")
        clean = often.where("chk = chk2").withColumn("size", F.lit(size))
        if size == 1:
            clean = clean.withColumn("size", F.when(F.col("at") < 0, 0).otherwise(1))
        out = clean if out is None else out.unionByName(clean)
        bad = often.where("chk != chk2").select("fp")
        if not bad.isEmpty():
            clashes.append(([0, 1] if size == 1 else [size], bad))
        if size < longest:
            parts = context.broadcast(_map_of(often))
    phrases = _texts_at(df, out.select("size", "fp", "n", "place", "at"))
    for sizes, bad in clashes:
        phrases = phrases.unionByName(_recounted(df, bad, sizes, least, bits))
    return stage(phrases, "phrases-frequent")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, bits: int = 64,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of ``a`` occurrences, cut into parts of ``l`` and ``r``, scores ``1000000 * a * a / (l * r)`` rounded down; its
    lowest-scoring cut counts, the first one of equals. Phrases inside a longer one of ``least`` occurrences or more
    that has ``inside`` percent of theirs are left out.
    """
    known = frequent_phrases(docs, longest, least, bits, doc_id, text, lang)
    phrases = known.where("size > 0").select("lang", "size", "phrase", "n")
    words = lambda first, size: F.array_join(F.slice(F.split("phrase", " "), first, size), " ")
    long = phrases.where("size > 1").withColumnRenamed("n", "a")
    cuts = long.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(words(1, F.col("k")), words(F.col("k") + 1, F.col("size")))).alias("side", "part"))
    sides = cuts.join(phrases.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("n")))
    both = sides.groupBy("lang", "phrase", "a").agg(*[of(k, s).alias(f"part{k}_{s}") for k in range(1, longest) for s in (0, 1)])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = lambda k: F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(f'part{k}_0')} * {wide(f'part{k}_1')})")
    options = [
        F.when(F.col(f"part{k}_0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"part{k}_0").alias("l"), F.col(f"part{k}_1").alias("r")))
        for k in range(1, longest)
    ]
    scored = both.select("lang", "phrase", "a", F.array_min(F.array(*options)).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: words(i, s))))
    around = long.where("size > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = scored.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    # the best of each of PARTS parts first, so that a language's last order has a fixed number of rows
    part = free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    totals = known.where("size = 0").select("lang", "n")  # a row a language
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
