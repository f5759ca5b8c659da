"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK``. A block stores its minimum,
and the differences to it packed at the width that ``PERCENT`` of them fit into; what is left of the larger
differences goes into the block's exception list (place and high bits). The start of every block is indexed, so
that a range of ids is read by unpacking the blocks it lies in.

Layout, little endian: ``PFR1``, number of ids (8 bytes), blocks (4), ids a block (4), block starts (8 each, and
the end). A block: minimum (4), width (1), exceptions (1), packed differences (``BLOCK`` * width bits), places of
the exceptions (1 each), their high bits (4 each). The last block is filled up with its last id.

Documents are range-partitioned by id, sorted and encoded with a public tokenizer where they lie. Each partition
becomes files of about ``FILE_IDS`` ids (a longer document is a file of its own), kept as rows of one table: any
store that Spark writes will do. Numbers before a file follow from the small table of file sizes.

Words are tokenized once: white space never takes part in a token, so a text's ids are
those of its words. Words of letters go to the tokenizer many at a time and are told apart by the
end-of-word tokens.

Defined results: null and empty texts have the end id alone. Null ids come last. Equal ids are ordered by a hash
of the text; equal rows are separate documents. An empty table gives empty files. Only id and text are read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from fleetpulse.llm import tokens
from fleetpulse.llm.expressions import whole
from fleetpulse.llm.store import prefix_sums, stage

BLOCK = 256
PERCENT = 90
FILE_IDS = 1_000_000
RUN_BYTES = 8_000_000
KNOWN = 400_000  # pieces of words whose ids a task remembers from run to run
_HEAD = "<4sQII"


# ---- the file format ----


def _places(width: int) -> Iterator[tuple[int, int, int]]:
    """Number of a value in its block, the 64-bit word it starts in, and its first bit there."""
    for j in range(BLOCK):
        yield j, j * width // 64, j * width % 64


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below ``2 ** width`` as rows of bytes."""
    out = np.zeros((BLOCK * width // 64, len(low)), np.uint64)
    for (j, word, bit), values in zip(_places(width), low.T.astype(np.uint64), strict=True):
        out[word] |= values << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= values >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, len(data)), np.uint32)
    for j, word, bit in _places(width):
        value = words[word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - bit))
        out[j] = value & mask
    return out.T


def encode(ids: np.ndarray, percent: int = PERCENT) -> bytes:
    """Ids below 2**32 as one file."""
    n = len(ids)
    m = -(-n // BLOCK)
    x = np.pad(ids.astype(np.uint32), (0, m * BLOCK - n), mode="edge").reshape(m, BLOCK) if n else np.zeros((0, BLOCK), np.uint32)
    least = x.min(1) if m else np.zeros(0, np.uint32)
    x = x - least[:, None]
    rank = max(-(-BLOCK * percent // 100), 1) - 1
    width = np.frexp(np.partition(x, rank, axis=1)[:, rank].astype(np.float64))[1].astype(np.int64)
    high = (x.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    block, place = np.nonzero(high)
    exceptions = np.bincount(block, minlength=m)
    packed = BLOCK // 8 * width
    starts = np.concatenate([[0], np.cumsum(6 + packed + 5 * exceptions)])
    out = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(m, 4)
    out[at + 4], out[at + 5] = width, exceptions
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        low = x[mine] & np.uint32((1 << w) - 1)
        out[at[mine][:, None] + 6 + np.arange(BLOCK // 8 * w)] = _packed(low, w)
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    first = (at + 6 + packed)[block]
    out[first + nth] = place
    out[(first + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return struct.pack(_HEAD, b"PFR1", n, m, BLOCK) + starts.astype("<u8").tobytes() + out.tobytes()


def decode(file: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from ``start`` to ``end`` (exclusive) of a file; only their blocks are unpacked."""
    magic, n, m, size = struct.unpack_from(_HEAD, file)
    if magic != b"PFR1" or size != BLOCK:
        raise ValueError("not a file of token ids")
    start, end = max(start, 0), min(n if end is None else end, n)
    if start >= end:
        return np.zeros(0, np.uint32)
    a, b = start // BLOCK, -(-end // BLOCK)
    starts = np.frombuffer(file, "<u8", m + 1, struct.calcsize(_HEAD))[a : b + 1].astype(np.int64)
    data = np.frombuffer(file, np.uint8, offset=struct.calcsize(_HEAD) + 8 * (m + 1))
    at = starts[:-1]
    least = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4")
    width, exceptions = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    x = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        mine = np.flatnonzero(width == w)
        x[mine] = _unpacked(data[at[mine][:, None] + 6 + np.arange(BLOCK // 8 * w)], w)
    block = np.repeat(np.arange(b - a), exceptions)
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    first = (at + 6 + BLOCK // 8 * width)[block]
    high = np.ascontiguousarray(data[(first + exceptions[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    x[block, data[first + nth]] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (x + least).reshape(-1)[start - a * BLOCK : end - a * BLOCK]


# ---- tokenizing ----


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words."""

    def __init__(self, vocabulary: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task; Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.end_id = end_id
        self.known: dict[str, int] = {}  # pieces of words, and the number of their ids in the pool
        self.pool: list[tuple[np.ndarray, np.ndarray]] = []
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in ids], np.int64)
        return np.array([x for one in ids for x in one], np.uint32), counts

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many to a call: each ends with its only end-of-word token. Where
        their number differs (another kind of vocabulary, or a letter that is none in lower case) each goes alone."""
        parts = [words[k : k + 200] for k in range(0, len(words), 200)]
        made = []
        for part, one in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(one.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            made.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self._each(part))
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.uint32), *[m[0] for m in made]]), np.concatenate([none, *[m[1] for m in made]])

    def _known(self, pieces: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Numbers of these distinct pieces among the lists in ``pool``; new ones are encoded first."""
        known = self.known
        words = pieces.to_pylist()
        new = [w for w in words if w not in known]
        if new:
            flat, counts = encode(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.pool.append((flat, counts))
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct words; letters followed by stops are two pieces, any other word is one."""
        if len(self.known) > KNOWN:
            self.known, self.pool = {}, []
        plain = pc.match_substring_regex(words, r"^\p{L}+[.,;:!?]*$")
        # the one letter whose lower case ends with a mark, which is no letter and goes with the stops
        plain = pc.and_not(plain, pc.match_substring(words, "\u0130")).to_numpy(zero_copy_only=False)
        letters = words.filter(pa.array(plain))
        cores = pc.ascii_lower(pc.ascii_rtrim(letters, ".,;:!?"))  # other letters are left to the tokenizer
        tails = pc.replace_substring_regex(letters, r"^\p{L}+", "")
        cores, tails = cores.dictionary_encode(), tails.dictionary_encode()
        core, tail = self._known(cores.dictionary, self._letters), self._known(tails.dictionary, self._each)
        other = self._known(words.filter(pa.array(~plain)), self._each)
        flat = np.concatenate([ids for ids, _ in self.pool] or [np.zeros(0, np.uint32)])
        counts = np.concatenate([*[c for _, c in self.pool], [0]])
        pieces = np.full((len(words), 2), len(counts) - 1)  # the second one is mostly missing
        pieces[plain, 0], pieces[plain, 1] = core[cores.indices.to_numpy()], tail[tails.indices.to_numpy()]
        pieces[~plain, 0] = other
        self.pool = [(flat, counts[:-1])]
        return gathered(flat, counts, pieces.reshape(-1), 2)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id after each, and how many each has."""
        words = pc.ascii_split_whitespace(column.cast(pa.large_string()))
        each = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        flat, counts = self._distinct(coded.dictionary.cast(pa.large_string()))
        flat, counts = np.append(flat, np.uint32(self.end_id)), np.append(counts, 1)
        ends = np.cumsum(each)
        places = np.insert(coded.indices.to_numpy().astype(np.int64), ends, len(counts) - 1)
        ids, per_word = gathered(flat, counts, places, 1)
        total = np.concatenate([[0], np.cumsum(per_word)])
        return ids, np.diff(total[np.concatenate([[0], ends + np.arange(1, len(each) + 1)])])


def gathered(flat: np.ndarray, counts: np.ndarray, picks: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``picks`` of a flat array of lists, one after the other, and the length of each ``group`` of them."""
    starts = np.cumsum(counts) - counts
    n = counts[picks]
    at = np.repeat(starts[picks] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[at], n.reshape(-1, group).sum(1)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


# ---- operators ----


def token_files(
    docs: DataFrame, tokenizer: str, end_id: int, file_ids: int = FILE_IDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the ids of all documents; one row per file: ``part, nth`` (files are in this order), ``ids`` and ``counts``
    (of its documents), ``n_ids`` and ``data``. ``tokenizer`` is the path of a vocabulary of the tokenizers library."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_vocabulary(tokenizer))  # a file of fixed size
    df = docs.select(docs[f"`{doc_id}`"].alias("id"), whole(docs[f"`{text}`"]).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = df.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shipped.value, end_id)
        part, nth = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            nonlocal nth
            names = pa.concat_arrays(ids)
            number = np.concatenate(counts)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            data = np.concatenate(held)
            nth += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), one(names), one(pa.array(number)),
                 pa.array([len(data)], pa.int64()), pa.array([encode(data)], pa.binary())], names=schema.names)

        for batch in batches:
            for at, to, _, _ in tokens.runs(batch.column(1), RUN_BYTES):
                flat, n = encoder.texts(batch.column(1).slice(at, to - at))
                row, upto = 0, np.cumsum(n)
                while row < len(n):
                    before = sum(map(len, held))
                    first = int(upto[row] - n[row])
                    stop = min(max(row + 1, int(np.searchsorted(upto, first + file_ids - before, "right"))), len(n))
                    ids.append(batch.column(0).slice(at + row, stop - row))
                    counts.append(n[row:stop])
                    held.append(flat[first : upto[stop - 1]])
                    row = stop
                    if before + len(held[-1]) >= file_ids or row < len(n):
                        yield file()
                        ids, counts, held = [], [], []
        if ids:
            yield file()

    schema = StructType.fromDDL("part int, nth int, ids array<int>, counts array<long>, n_ids long, data binary")
    fields = [StructField("ids", ArrayType(kind)) if f.name == "ids" else f for f in schema.fields]
    return stage(df.mapInArrow(work, StructType(fields)), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """``part, nth, start``: the number of ids in all files before."""
    return prefix_sums(files.select("part", "nth", "n_ids"), [], ["part"], [F.col("nth")], "n_ids", "start", "all_ids").select("part", "nth", "start")


def documents_of(files: DataFrame) -> DataFrame:
    """Every document read back from its file: ``id``, ``part, nth`` (its file), ``at`` (ids before it in the file),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, nth, ids, counts, data = (batch.column(c)[k] for c in range(5))
                n = counts.values.to_numpy()
                ends = np.cumsum(n)
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)),
                                                pa.py_buffer(decode(data.as_py()).astype("<u4").tobytes())])
                same = lambda v, m=len(n): pa.array(np.full(m, v.as_py(), np.int32))
                out = pa.RecordBatch.from_arrays(
                    [ids.values, same(part), same(nth), pa.array(ends - n), pa.array(n), column.cast(pa.binary())], names=names)
                for first in range(0, len(n), 10_000):
                    yield out.slice(first, 10_000)

    names = ["id", "part", "nth", "at", "n_tokens", "ids"]
    kind = files.schema["ids"].dataType.elementType
    added = StructType.fromDDL("part int, nth int, at long, n_tokens long, ids binary")
    return files.select("part", "nth", "ids", "counts", "data").mapInArrow(work, StructType([StructField("id", kind), *added.fields]))
