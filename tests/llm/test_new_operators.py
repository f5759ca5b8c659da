"""Fill-in-the-middle, token files and collocations against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import SF, CLASHES, SCHEMA, needs_data, odd_rows, prose  # noqa: E402

from fleetpulse.llm import fim, packing, phrases  # noqa: E402
from fleetpulse.llm.queries import QUERIES  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- fill in the middle ----


def brute_fim(doc_id: int | None, text: str | None, percent: int = 100, spm: int = 50) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


@pytest.mark.parametrize("bound", [0, 1, 7, 126])
def test_rank_index_is_exact(bound):
    r = np.random.default_rng(bound)
    for gaps in ([], [1] * 500, r.integers(1, 4, 300), r.integers(1, 100_000, 300), r.zipf(1.5, 2000) % 10_000 + 1, [10**9, 1, 1, 10**9]):
        offsets = np.concatenate([[0], np.cumsum(gaps)]).astype(np.int64)
        index = fim.RankIndex(offsets, bound)
        assert (index(np.arange(len(offsets))) == offsets).all()
        assert np.abs(index.residuals.astype(int)).max() <= bound + 1
        assert index.firsts[0] == 0 and (np.diff(index.firsts) > 0).all()
    assert len(fim.RankIndex(np.arange(0, 70_000, 70), bound).firsts) == 1, "even lines are one segment"
    with pytest.raises(ValueError):
        fim.RankIndex(np.arange(3), 127)


def test_fill_in_middle(spark, odd, nothing):
    extra = [(500 + k, t, None, None, *(1,) * len(CLASHES)) for k, t in enumerate(
        ["\n", "\n\n\n", "a\n", "a\nb", "no newline", "x <P> y\nz", "<\nS\n>", "P><\nS>", "é\n😀\n" * 50, "\r\n\x0b\n", "<\n<P\n<S\nM>\n>"])]
    df = odd.unionByName(spark.createDataFrame(extra, SCHEMA))
    for percent, spm in ((100, 50), (40, 100), (0, 0)):
        got = fim.fill_in_middle(df.unionByName(df), percent=percent, spm_percent=spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        want = Counter((r[0], brute_fim(r[0], r[1], percent, spm)) for r in [*odd_rows(), *extra] for _ in "12")
        assert Counter((r.row.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
        assert all(r.back == (r.row.text or "") and r.row.kept == 1 for r in got)
    assert fim.fill_in_middle(nothing).count() == 0


# ---- token files ----


@pytest.mark.parametrize("percent", [1, 60, 90, 100])
def test_blocks_round_trip(percent):
    r = np.random.default_rng(percent)
    for n in (0, 1, 255, 256, 257, 3000):
        for high in (1, 2, 50_000, 2**32 - 1):
            ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            if n > 10:
                ids[r.integers(0, n, 4)] = 2**32 - 1
            file = packing.encode(ids, percent)
            assert (packing.decode(file) == ids).all()
            for a, b in ((3, 200), (250, 700), (n - 1, n), (9, 5)):
                assert (packing.decode(file, a, b) == ids[max(a, 0) : max(b, 0)]).all()
    with pytest.raises(ValueError):
        packing.decode(b"none" + file[4:])


def test_outliers_do_not_widen_a_block():
    ids = np.arange(256, dtype=np.uint32) % 16
    plain = len(packing.encode(ids))
    ids[::20] = 40_000
    assert len(packing.encode(ids)) == plain + 5 * 13


def test_words_are_encoded_as_texts():
    encoder = packing.WordEncoder(packing.read_vocabulary(VOCABULARY), 2)
    r = random.Random(5)
    marks = [*"abAB'st,.;:!?é́Σς09-<|> \t\n\x0b\x0c\r\xa0　 \x1c\x85İſ😀‍%\"()", "<|endoftext|>", "'s", "'ll", "hello", "fi", " "]
    texts = ["", " "] + ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    ids, counts = encoder.texts(pa.array(texts))
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [x for one in want for x in one]


def brute_tokens(rows: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read_back(files) -> list[tuple]:
    read = packing.documents_of(files).join(packing.file_starts(files), ["part", "nth"])
    return [tuple(r) for r in read.select("id", F.col("start") + F.col("at"), "n_tokens", F.crc32("ids")).collect()]


@pytest.mark.parametrize("file_ids", [1, 100, 1_000_000])
def test_token_files(odd, nothing, file_ids):
    rows = [r[:2] for r in odd_rows() if r[0] is not None]
    files = packing.token_files(odd.where("doc_id IS NOT NULL").repartition(5), VOCABULARY, 2, file_ids)
    assert sorted(read_back(files)) == sorted(brute_tokens(rows))
    if file_ids == 100:  # a longer document has a file of its own
        assert all(r.n_ids <= 100 or len(r.ids) == 1 for r in files.collect())
    twice = read_back(packing.token_files(odd.unionByName(odd), VOCABULARY, 2, file_ids))
    assert Counter((i, n, crc) for i, _, n, crc in twice) == Counter((i, n, crc) for i, _, n, crc in brute_tokens([r[:2] for r in odd_rows()] * 2))
    upto = 0
    for _, start, n, _ in sorted(twice, key=lambda r: r[1]):
        assert start == upto
        upto += n
    assert read_back(packing.token_files(nothing, VOCABULARY, 2)) == []


@needs_data
def test_token_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == brute_tokens(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))


# ---- collocations ----


def brute_collocations(docs: list[tuple], longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> list[tuple]:
    counts: dict = defaultdict(Counter)
    total: Counter = Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, p, a, lft, rgt, total[lang], s) for rank, (s, a, p, lft, rgt) in enumerate(found[:top], 1)]
    return sorted(out)


def crowd() -> list[tuple]:
    r = random.Random(2)
    words = ["a", "b", "c", "Dd", "é", "é", "x-y", "'", " ", "zz"]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(r.randint(0, 40)):
            text += r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \r"])
        rows.append((k, text, ["en", "de", None, "und", ""][k % 5]))
    return rows + [(200, None, "en"), (201, "", None), (202, "new York City " * 30, "en"), (203, "a " * 500, "xx"), (None, "b c " * 40, "en")] * 2


@pytest.mark.parametrize("longest, bits", [(3, 64), (3, 7), (4, 64), (2, 3)])
def test_collocations(spark, longest, bits):
    """With short fingerprints most n-grams collide, and all are told apart by their words."""
    docs = spark.createDataFrame(crowd(), "doc_id long, text string, lang string")
    got = phrases.collocations(docs, longest, bits=bits, top=15).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_collocations([r[1:] for r in crowd()], longest, top=15)


def test_collocations_on_odd_rows(spark, odd, nothing):
    many = odd
    for _ in range(3):
        many = many.unionByName(many)
    got = phrases.collocations(many).collect()
    assert sorted(map(tuple, got)) == brute_collocations([r[1:3] for r in odd_rows()] * 8)
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(odd.where("text IS NULL")).count() == 0


def test_pieces_and_counts(spark):
    """Phrases do not reach over stops; products beyond 64 bits are exact."""
    docs = spark.createDataFrame([(1, "a b. a b; a b\na b\x0ba b a\tb a b, A B a b a b a b", "en")], "doc_id long, text string, lang string")
    got = {(r.size, r.phrase): r.n for r in phrases.frequent_phrases(docs, least=1).collect()}
    assert got[2, "a b"] == 11 and got[2, "b a"] == 5 and got[0, ""] == 22 and (3, "b a b") in got
