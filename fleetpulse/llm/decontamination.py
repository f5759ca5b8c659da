"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Words are runs of ASCII letters and digits and of all other characters from U+0080 on, with A-Z in
lower case. Every window of ``WINDOW`` consecutive words of an item is a pattern; an item of fewer
words is one pattern. Words that occur in the items become single characters, so an item is a short
string, a document has one character per word, and a document is scanned once for all patterns. Words
of a document inside an occurrence are hit; hits map back to code points of the original text.

The items travel to the tasks as a broadcast of at most ``block_bytes`` of their text. More items are
dealt into blocks, each with its own scan, and the hits of the scans are merged.

Defined results: null and empty texts have no words and no hits. Items without words or id match nothing.
Items with equal texts are all reported. Repeated rows are each judged. With no items nothing is hit.
An empty table gives an empty table. The document's own columns stay inside ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from fleetpulse.llm.expressions import whole
from fleetpulse.llm.store import stage

WINDOW = 13
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _KEEP else 0x20 for b in range(256)
)
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_HITS = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
_SCHEMA = "struct<item:string,first:bigint,last:bigint>"


def normal_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text. Bytes from 0x80 on are kept, so whole characters stay together."""
    return data.translate(_TABLE).split(b" ")


class Matcher:
    """The automaton of one block of items: ``(id as text, text)``."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        patterns: dict[str, list[str]] = {}
        for item, text in items:
            coded = "".join(self._letter(w) for w in normal_words((text or "").encode()) if w)
            for i in range(max(1, len(coded) - WINDOW + 1) if coded else 0):
                owners = patterns.setdefault(coded[i : i + WINDOW], [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.automaton = ahocorasick.Automaton() if patterns else None
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), owners))
        if patterns:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            code = len(self.letters) + 1
            self.letters[word] = chr(code if code < 0xD800 else code + 0x800)  # surrogates are no characters
        return self.letters[word]

    def scan(self, data: bytes) -> tuple[int, list[dict]]:
        """Number of words, and for each item the merged runs of words that its windows cover."""
        get = self.letters.get
        coded = "".join([get(w, "\0") for w in normal_words(data) if w])
        runs: dict[str, list[list[int]]] = {}
        if self.automaton is not None:
            for last, (n, owners) in self.automaton.iter(coded):
                for item in owners:
                    mine = runs.setdefault(item, [])
                    if mine and last - n + 1 <= mine[-1][1] + 1:
                        mine[-1][0] = min(mine[-1][0], last - n + 1)
                        mine[-1][1] = max(mine[-1][1], last)
                    else:
                        mine.append([last - n + 1, last])
        return len(coded), [{"item": k, "first": a, "last": b} for k, v in runs.items() for a, b in v]


def _scan(df: DataFrame, items: list[tuple[str, str | None]]) -> DataFrame:
    """Add the hits of these items to the column ``hits`` and set ``n_words``."""
    shipped = df.sparkSession.sparkContext.broadcast(items)
    names = df.columns
    schema = df.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shipped.value)
        for batch in batches:
            counts, found = [], []
            texts = batch.column(names.index("__text")).cast(pa.large_binary())
            for value, old in zip(texts, batch.column(names.index("hits")), strict=True):
                n, hits = matcher.scan(value.as_py())
                counts.append(n)
                found.append((old.as_py() or []) + hits if hits else old.as_py())
            arrays = [
                pa.array(counts, pa.int64()) if c == "n_words" else pa.array(found, _HITS) if c == "hits" else batch.column(i)
                for i, c in enumerate(names)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(work, schema)


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = 2_000_000, keep_text: bool = True
) -> DataFrame:
    """Every document (inside ``row``) with ``n_words``, ``n_hit``, ``items`` (sorted ids as text), ``hits``
    (runs of word numbers per item) and ``contaminated``: a twentieth of the words or more is hit."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if keep_text or c != text])
    df = docs.select(
        row.alias("row"), whole(docs[f"`{text}`"]).alias("__text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(f"array<{_SCHEMA}>").alias("hits"))
    listed = items.select(items[f"`{item_id}`"].cast("string").alias("id"), whole(items[f"`{item_text}`"]).alias("text"))
    size = listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        mine = listed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # bounded by block_bytes
        df = _scan(df, [(r.id, r.text) for r in mine if r.id is not None])
        if b + 1 < blocks:
            df = stage(df, "decontamination-block")
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"))))
    start = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, h: F.struct(
        F.greatest(acc["upto"], h["last"]).alias("upto"),
        (acc["n"] + F.greatest(h["last"] - F.greatest(acc["upto"] + 1, h["first"]) + 1, F.lit(0))).alias("n"))
    df = df.withColumn("n_hit", F.aggregate(ordered, start, step, lambda acc: acc["n"]))
    found = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return df.select(
        "row", *(["__text"] if keep_text else []), "n_words", "n_hit", found.alias("items"), "hits",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def original_spans(df: DataFrame) -> DataFrame:
    """Add ``spans`` to the result of ``contamination``: code points (start, end exclusive) of every run
    of hit words in the original text. Texts without hits are not read again."""
    names = [*df.columns, "spans"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, hits in zip(batch.column(names.index("__text")), batch.column(names.index("hits")), strict=True):
                runs = sorted((h["first"], h["last"]) for h in hits.as_py() or [])
                words = [m.span() for m in _WORD.finditer(value.as_py())] if runs else []
                merged: list[list[int]] = []
                for a, b in runs:
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append([{"start": words[a][0], "end": words[b][1]} for a, b in merged])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=names)

    spans = StructType([StructField("spans", ArrayType(StructType().add("start", "long").add("end", "long")))])
    return df.mapInArrow(work, StructType([*df.schema.fields, *spans.fields]))
