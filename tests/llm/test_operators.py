"""Every operator against its plain Python version, on odd rows and on the small tables."""

from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from fleetpulse.llm import backoff, decontamination, jaccard, lines, mixing, pii, quality, sharding, suffixes, urls  # noqa: E402
from fleetpulse.llm.components import components  # noqa: E402
from fleetpulse.llm.queries import QUERIES, URL_RULES  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
# names that the operators use inside, all as extra columns of the input
CLASHES = ["row", "rid", "id", "tx", "c", "n", "key", "seg", "t", "t2", "size", "weight", "shard", "slot", "curve", "hits", "n_words",
           "kept", "spans", "sig", "chunk", "range", "host", "path", "rule", "verdict", "rank", "reasons", "target", "epochs", "words"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in CLASHES)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = "\n".join(prose(100 + k, 60) for k in range(150))
ITEM = prose(7, 30)
TEXTS = [
    None, "", "   \n\t ", "one", "Ünï cödé 😀 wörds", prose(1, 40), prose(1, 40), prose(1, 39) + " changed", prose(2, 300),
    prose(2, 300).replace("a", "b", 1), LONG, LONG + "\ntail", prose(3, 20) + "\n" + prose(3, 20) + "\n" + prose(3, 20), "x " * 400,
    "a#b $$ %% && " * 30, "SHOUTING!! " * 60, "mail me at joe.x@ex-am.ple.org, 4111 1111 1111 1111 or +1 (415) 555-0100 at 10.0.0.255 and 300.1.1.1",
    "iban DE89 3704 0044 0532 0130 00 token = \"" + "0a" * 20 + "\" " + "1" * 5000, prose(9, 50) + " " + ITEM + " " + prose(10, 60),
    "é" * 900, prose(11, 12) + " " + "é" * 900, ITEM.upper(), "The quick brown fox jumps over it\nThe quick brown fix jumps over it\nthe  quick brown fox jumps over it",
]


def odd_rows() -> list[tuple]:
    extra = (1,) * len(CLASHES)
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", "s0", None][i % 4], *extra) for i, t in enumerate(TEXTS)]
    return rows + [(None, prose(20, 30), None, None, *extra), (None, None, "en", "s1", *extra)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def twice(odd):
    """With every row repeated."""
    return odd.unionByName(odd)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows) -> Counter:
    return Counter(map(repr, rows))


def test_quality_counts(twice, nothing):
    got = quality.quality_verdicts(twice).collect()
    want = Counter((r[0], brute.quality(r[1])) for r in odd_rows() for _ in "12")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r.row.doc_id, tuple(r[c] for c in cols)) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed) and all(r.row.kept == 1 for r in got)
    assert quality.quality_verdicts(nothing).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    """What is ordinary in one source is an outlier in another; a tiny group takes its language's sketch."""
    rows = [(i, "# " * 10 + prose(i, 40), "en", "code") for i in range(150)] + [(200 + i, prose(i, 50), "en", "news") for i in range(150)]
    rows += [(900, "# " * 10 + prose(5, 40), "en", "news"), (901, prose(77, 40), "en", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.row.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert not kept[900] and kept[901] and sum(kept[i] for i in range(150)) == 150 and sum(kept[200 + i] for i in range(150)) == 150


def test_pipeline_rejects_repeats_below_the_base_rule(spark):
    import corpus_pipeline

    again = prose(7000, 10)
    rows = [(i, prose(i, 80), "en", "news") for i in range(150)] + [(900, f"{prose(8000, 60)} {again} {prose(8100, 10)} {again}", "en", "news")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    r = quality.quality_verdicts(docs).where("row.doc_id = 900").first()
    assert not r.base_failed and 150 < r.repeat_permille <= 300
    assert {x.doc_id for x in corpus_pipeline.good_quality(spark, docs, "").collect()} == set(range(150))


def test_sketches_merge(spark):
    rows = [(i, prose(i, 20 + i), "en", "s") for i in range(120)]
    docs = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).cache()
    halves = [quality.sketches(docs.where(F.col("row.doc_id") % 2 == k)) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert by_text(merged.collect()) == by_text(quality.sketches(docs).collect())


def test_urls(spark, nothing):
    cases = [None, "", "x", "http://", "http://net", "http://net/", "HTTPS://A.NET/En/?q", "ftp://m.Example.NET/en/x#y", "http://xnet/", "http://example.com/de/1",
             "http://b.example.com/de", "a://b://net/", "http://x.org/fr/", "http://org/fr/?", "http://x.org:80/fr/", "http://casino-win.example.org/fr/1",
             "http://www.casino-win.example.org/en/", "http://casino-win/en", "http://Ü.net/", "http://x.net/é\nq"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(cases)] * 2, "page_id long, url string, host int, rule int")
    base = [(r.verdict, r.text) for r in URL_RULES]
    table = urls.rule_table(spark, URL_RULES + [urls.label_rule("block", "casino-win")])
    got = urls.filtered_urls(pages, table).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        host, path, rule, verdict = brute.url_verdict(cases[r.row.page_id], base)
        assert (r.host, r.path) == (host, path)
        if rule:
            assert (r.rule, r.verdict) == (rule, verdict)
        else:
            assert r.verdict == ("block" if "casino-win." in host else "allow"), r
    assert urls.filtered_urls(pages.where("false"), table).count() == 0
    assert {r.verdict for r in urls.filtered_urls(pages, table.where("false")).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token():
    assert urls.host_rule("block", "example.net/en/").tokens == ("example", "net", "en")
    assert urls.host_rule("block", "a.b/part").tokens == ("a", "b")  # the url may go on: /partner


def test_mixing(twice, nothing, spark):
    got = mixing.mixed(twice, rows_per_bucket=3).collect()
    again = mixing.mixed(twice.repartition(7), rows_per_bucket=1000).collect()
    assert len(got) == 2 * len(odd_rows())
    key = lambda rows: Counter((r.row.doc_id, r.size, r.taken) for r in rows)
    assert key(got) == key(again)  # neither partitions nor bucket sizes matter
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(brute.WORD.findall(r.row.text or "")) and r.taken <= 3 * r.size
        sizes[r.row.source] += r.size
        taken[r.row.source] += r.taken
    want = brute.targets(sizes)
    for r in got:
        assert abs(r.target - want[r.row.source]) < 1e-3 and r.source_size == sizes[r.row.source]
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    copies = mixing.copies(mixing.mixed(twice))
    assert copies.columns == twice.columns and copies.count() == sum(r.epochs + r.extra for r in got if r.size)
    assert mixing.mixed(nothing).count() == 0


def test_mixing_targets_by_rounds(spark):
    for seed in range(5):
        r = random.Random(seed)
        sizes = {f"s{i}": r.choice([0, 1, 5, 100, 10_000]) for i in range(8)} | {None: 40}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.source_targets(table).collect()}
        want = brute.targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-3 for s in sizes), (seed, got, want)


def test_mixing_prefers_better_documents(spark):
    rows = [(i, ("1 " if i % 2 else "word ") * 20, "a") for i in range(400)] + [(1000, prose(1, 4000), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = [r for r in mixing.mixed(docs, weights=(1, 5)).collect() if r.row.source == "a"]
    extra = Counter(r.row.doc_id % 2 for r in mix if r.extra)
    assert extra[0] > 3 * extra[1]


def test_jaccard(odd, twice, nothing):
    rows = [r for r in odd_rows() if r[0] is not None]
    want = brute.jaccard([r[:2] for r in rows])
    got = {r.id: (r.class_id, r.links) for r in jaccard.jaccard_links(odd.where("doc_id IS NOT NULL")).collect()}
    assert got == want
    again = jaccard.jaccard_links(twice).collect()
    assert len(again) == 2 * len(odd_rows())
    alone = {r.id: (r.copies, r.links) for r in again}
    assert alone[4] == (2, 1) and alone[0] == (1, 0)
    left = jaccard.one_of_each(twice, jaccard.jaccard_links(twice))
    assert left.columns == twice.columns
    classes = {want[r[0]][0] for r in rows if brute.WORD.search(r[1] or "")}
    assert left.where("text RLIKE '[^ \\n\\t]'").count() == len(classes) + 1
    assert jaccard.jaccard_links(nothing).count() == 0


def test_jaccard_recursion_finds_what_all_pairs_find(spark):
    """Small nodes and tiles, so that paths are split, dense nodes are cut into tiles, and links add up."""
    r = random.Random(5)
    base = prose(50, 120).split()
    rows = []
    for i in range(160):  # one large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(500 + i, 60) + " " + prose(50, 40)) for i in range(120)]  # a shared passage
    rows += [(2000 + i, prose(900 + i // 2, 50)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows)
    old, jaccard.TILE = jaccard.TILE, 40
    try:
        got = {x.id: (x.class_id, x.links) for x in jaccard.jaccard_links(docs, small=20).collect()}
    finally:
        jaccard.TILE = old
    assert got == want


def test_jaccard_sends_no_class_where_its_first_node_was_brute_forced(spark, monkeypatch):
    n, staged, keep = 60, [], jaccard.stage
    # the first n classes agree in every other coordinate, all else differs
    rows = [(c, c, [7 if c < n and k % 2 else 100 + c for k in range(jaccard.COORDINATES)]) for c in range(2 * n)]
    classes = spark.createDataFrame(rows, "c long, label long, sig array<int>")
    monkeypatch.setattr(jaccard, "stage", lambda df, name: staged.append((name, keep(df, name))) or staged[-1][1])
    every = [(0, k) for k in range(jaccard.COORDINATES)]
    leaves = jaccard._leaves(classes, every, 0.8, 20, 3, 5, True).groupBy("node").count().collect()
    paths = [df for name, df in staged if name == "jaccard-paths"]
    assert paths and {r["count"] for df in paths for r in df.groupBy("node").count().collect()} == {n}
    assert leaves and {r["count"] for r in leaves} == {n}


def test_jaccard_recall_where_splitting_goes_deep(spark):
    """Thousands of documents draw from few words, so every common node of a pair is crowded and split to the
    last level; nearly all pairs at the threshold must still meet."""
    r, pairs, rows = random.Random(8), 2500, []
    for i in range(pairs):
        both = [f"w{k}" for k in r.sample(range(200), 80)]
        rows += [(2 * i + j, " ".join(both + [f"o{i}x{j}x{k}" for k in range(10)])) for j in (0, 1)]  # 80 of 100 words in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: (x.class_id, x.links) for x in jaccard.jaccard_links(docs, size=1, small=25).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in range(pairs))
    assert found >= 0.998 * pairs, found
    assert sum(n for _, n in got.values()) == 2 * found


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (100, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pii(twice, nothing):
    got = pii.personal_data(twice).collect()
    base = ("email", "ip", "card", "phone")
    want = Counter((r[0], tuple(brute.pii_base(r[1]))) for r in odd_rows() for _ in "12")
    assert Counter((r.row.doc_id, tuple(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in base)) for r in got) == want
    more = {r.row.doc_id: {s.kind: r.row.text[s.start : s.end] for s in r.spans} for r in got if r.row.doc_id == 17}[17]
    assert more["iban"].replace(" ", "") == "DE89370400440532013000" and more["secret"] == "0a" * 20
    assert pii.personal_data(nothing).count() == 0


@pytest.mark.parametrize("text", [
    "a@b.cd_x@y.z a@b@c.d @x.y a.b@c-d.e-f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9999999999999.1.1.1", "4111-1111-1111-1111 41111111111111112 4111  1111",
    "++1 (2) 3-4.5678901 +12 +123456789) +1 23456789012345678", "😀x@y.zz é4111111111111111é", "%+-._@x.y" * 3, "1" * 4000 + "." + "2" * 10, "a" * 20000 + "@",
    "DE89370400440532013001 xDE89370400440532013000 GB82 WEST 1234 5698 7654 32 account"])
def test_pii_patterns(spark, text):
    got = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    found = [f"{s.kind}:{s.start}:{s.end}" for s in got.spans]
    assert [x for x in found if x.split(":")[0] not in ("iban", "secret")] == brute.pii_base(text)
    assert any(x.startswith("iban") for x in found) == ("GB82" in text)


def test_pii_context_and_redaction(spark):
    hexes = "ab" * 20
    docs = spark.createDataFrame([(1, f"commit {hexes} by"), (2, f"password: {hexes} by")], "doc_id long, text string")
    df = pii.personal_data(docs)
    got = {r[0]: r[1] for r in df.select("row.doc_id", pii.redacted(F.col("row.text"), F.col("spans"))).collect()}
    assert got == {1: f"commit {hexes} by", 2: "password: <secret> by"}


def test_backoff(odd, twice, nothing):
    rows = [(i, r[1]) for i, r in enumerate(odd_rows())]
    docs = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    want = brute.backoff(rows)
    for chunk, reach in ((6_000_000, 16_000_000), (2_000, 3_000)):
        got = {r.id: r for r in backoff.backoff_scores(docs, chunk_bytes=chunk, range_bytes=reach).collect()}
        assert len(got) == len(rows)
        for i, (n, backed, score) in want.items():
            assert (got[i].n_words, got[i].n_backed) == (n, backed) and abs(got[i].log_score - score) < 1e-6 * max(1, abs(score))
    assert backoff.backoff_scores(twice).count() == 2 * len(rows) and backoff.backoff_scores(nothing).count() == 0


def test_backoff_trigrams(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x b c")], "doc_id long, text string")
    got = {r.id: r.log_score for r in backoff.backoff_scores(docs, order=3).collect()}
    ln, n = np.log, 7
    # a: 1/7; b after a: 1/1; c after a b: 1/1; d: unseen in all orders, so 0.4 * 0.4 / 7
    assert abs(got[1] - (ln(1 / n) + ln(1) + ln(1) + ln(0.16 / n))) < 1e-9


def test_hilbert_is_a_walk():
    """Every cell once, and neighbours on the curve are neighbours in space."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = pd.DataFrame(np.indices((2**bits,) * dims).reshape(dims, -1).T)
        index = sharding.hilbert_index(points, bits)
        assert sorted(index) == list(range(2 ** (bits * dims)))
        walk = points.iloc[np.argsort(index.to_numpy())].to_numpy()
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(twice, nothing, law):
    got = sharding.sharded(twice, shards=6, law=law, rows_per_bucket=4).collect()
    assert len(got) == 2 * len(odd_rows())
    again = sharding.sharded(twice.repartition(5), shards=6, law=law, rows_per_bucket=4).collect()
    key = lambda rows: Counter((r.row.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(again)
    slots = defaultdict(list)
    weight = Counter()
    for r in got:
        assert r.size == len((r.row.text or "").encode()) + 16 and r.text_crc32 == brute.crc(r.row.text)
        slots[r.shard].append(r.slot)
        weight[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        largest = max(r.size for r in got)
        assert all(abs(weight[s] - sum(weight.values()) / 6) <= largest for s in range(6))
    assert sharding.sharded(nothing, law=law).count() == 0


def test_sharding_prunes(spark):
    """Shards have narrow ranges: few distinct sources and languages each."""
    rows = [(i, "x" * (1 + i % 7) * 50, f"l{i % 4}", f"s{(i // 4) % 16}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.sharded(docs, shards=16).groupBy("shard").agg(
        F.countDistinct("row.source").alias("s"), F.countDistinct("row.lang").alias("l")).agg(F.avg("s"), F.avg("l")).first()
    assert got[0] <= 8 and got[1] <= 3


@pytest.mark.parametrize("length, probe", [(400, 64), (12, 4)])
def test_suffixes(twice, odd, nothing, length, probe):
    texts = [r[1] for r in odd_rows()]
    for df, times in ((odd, 1), (twice, 2)):
        want = Counter((r[0], *x) for r, x in zip(odd_rows() * times, brute.repeated_bytes(texts * times, length), strict=True))
        got = suffixes.without_repeats(df, length, probe, batches=3).collect()
        assert Counter((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == want
        assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffixes.without_repeats(nothing).count() == 0


def test_suffixes_in_any_batches_and_crowds(spark):
    r = random.Random(3)
    passage = prose(70, 40)
    texts = [prose(1000 + i, 30) + passage[r.randrange(60) :] + prose(2000 + i, 30) for i in range(60)] + ["ab" * 300, "ba" * 200, "ab" * 300 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute.repeated_bytes(texts, 50)))
    for batches, crowd in ((1, 50_000), (5, 50_000), (2, 3)):
        old, suffixes.CROWD = suffixes.CROWD, crowd
        try:
            got = {x.row.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in suffixes.without_repeats(docs, 50, 16, batches).collect()}
        finally:
            suffixes.CROWD = old
        assert got == want


def test_passages_of_many_words(spark):
    """Repeats of over 50 words are counted though they are too short to be removed; shorter ones are not."""
    texts = [prose(3000 + i, 80) + " " + passage + " " + prose(4000 + i, 80)
             for i, passage in enumerate([prose(1, 60)] * 2 + [prose(2, 45)] * 2 + [prose(5, 100)] * 2 + [""])] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r for r in suffixes.without_repeats(docs, passage_bytes=200).collect()}
    assert [got[i].n_passages for i in range(9)] == [1, 1, 0, 0, 1, 1, 0, 0, 0]
    assert got[0].n_removed == 0 < got[4].n_removed and 60 <= got[0].n_passage_words <= 62
    want = dict(enumerate(brute.repeated_bytes(texts, 400)))
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for i, r in got.items()} == want


def test_suffix_levels(spark):
    """Seven batches leave levels of 4, 2 and 1."""
    table = spark.createDataFrame([(i, i, i % 5, i, 0, 0, 0) for i in range(70)], "t long, t2 long, key long, seg long, at int, lo int, hi int")
    family = suffixes.SuffixFamily(spark)
    for b in range(7):
        family.ingest(table.where(f"t % 7 = {b}"))
    assert [rank for rank, _ in family.levels] == [2, 1, 0]
    assert {r.key for r in family.repeated().collect()} == set(range(5))


def test_lines(odd, twice, nothing):
    rows = [r[:2] for r in odd_rows() if r[0] is not None]
    want = brute.lines(rows)
    got = {r.id: (r.n_lines, r.equal, r.near) for r in lines.repeated_lines(odd.where("doc_id IS NOT NULL")).collect()}
    assert got == want
    again = lines.repeated_lines(twice).collect()
    assert len(again) == 2 * len(odd_rows())
    assert Counter(sum(len(r.equal) + len(r.near) < r.n_lines for r in again if r.id == i) for i in (5, 8)) == Counter({1: 2})
    assert lines.repeated_lines(nothing).count() == 0
    kept = odd.sparkSession.sql("SELECT 'a\\nb\\nc' AS t, array(1) AS g").select(lines.without_lines(F.col("t"), F.col("g"))).first()[0]
    assert kept == "a\nc"


def test_lines_with_random_edits(spark):
    r = random.Random(11)
    base = [prose(i, n) for i, n in zip(range(12), [4, 5, 6, 8, 12, 20, 40] * 2, strict=False)]
    rows = []
    for i in range(150):
        s = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(s) + 1)
            s[k : k + r.choice([0, 1])] = r.choice(["", "z", "é", "y"])
        rows.append((i, "".join(s) + "\nshort " + str(i % 3)))
    got = {x.id: (x.n_lines, x.equal, x.near) for x in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.lines(rows) and sum(len(x[2]) for x in got.values()) > 20


def test_contamination(twice, nothing, spark):
    items = [(1, ITEM), (2, "a b c"), (3, None), (4, ""), (5, ITEM), (6, "one"), (7, "Ünï CÖDÉ"), (8, prose(2, 20)), (9, "x x x")]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hits int")
    want = Counter((r[0], *brute.contamination(r[1], items)) for r in odd_rows() for _ in "12")
    for block in (2_000_000, 100):
        got = decontamination.contamination(twice, table, block_bytes=block)
        rows = got.collect()
        assert Counter((r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in rows) == want
    spans = {r.row.doc_id: [r.row.text[s.start : s.end] for s in r.spans] for r in decontamination.original_spans(got).where("row.doc_id IN (18, 21)").collect()}
    assert spans == {18: [ITEM], 21: [ITEM.upper()]}
    assert decontamination.contamination(nothing, table).count() == 0
    assert {r.n_hit for r in decontamination.contamination(twice, table.where("false")).collect()} == {0}


@needs_data
def test_queries_without_sql(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = dict(zip(docs.doc_id, brute.repeated_bytes(list(docs.text), 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert got == want
    shards = QUERIES["op7_sharding"](spark, SF).toPandas()
    assert len(shards) == len(docs) and shards.shard.value_counts().max() - shards.shard.value_counts().min() <= 1
    assert dict(zip(shards.doc_id, shards.text_crc32, strict=True)) == {i: brute.crc(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}


def test_line_keys_are_compiled(spark):
    """Spark interprets higher-order functions, and all that is inside them, row by row."""
    docs = spark.createDataFrame([(1, "a line of some words that is long enough\nshort")], "doc_id long, text string")
    found = lines._occurrences(docs, "doc_id", "text", 20)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r.keys) for r in found.orderBy("no").collect()] == [2 * lines.COARSE, 0]
