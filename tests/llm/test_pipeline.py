"""The pipeline's stages against plain Python, and the queries against their SQL."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from check_queries import compare  # noqa: E402
from fleetpulse.llm.oracles import ORACLES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_queries_equal_sql(spark):
    out = compare(spark, SF, list(ORACLES))
    assert all(r.startswith("ok") for r in out.values()), out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(x) for x in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, SF)

    good = run("quality_rules", docs)
    assert good.columns == columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert rows and not any(brute.quality(t)[-1] for _, t in rows)

    single = run("near_duplicates", good)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {c for c, _ in brute.jaccard(rows).values()}

    clean = run("decontamination", single)
    left = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns
    assert set(left) == {r.doc_id for r in single.collect() if not brute.contamination(r.text, items)[-1]}

    mix = run("mixing", clean)
    assert mix.columns == columns
    taken = Counter(r.doc_id for r in mix.collect())
    assert set(taken) <= set(left) and max(taken.values()) <= 3
    sizes = Counter()
    for r in clean.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text))
    got = Counter()
    for r in mix.collect():
        got[r.source] += len(brute.WORD.findall(r.text))
    largest = max(len(brute.WORD.findall(t)) for t in left.values())
    assert all(abs(got[s] - t) <= largest for s, t in brute.targets(sizes).items())

    last = run("sharding", mix).collect()
    assert Counter(r.doc_id for r in last) == taken
    counts = Counter(r.shard for r in last)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1


def test_run_is_the_stages_in_turn(spark):
    first, second = (Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect()) for _ in "12")
    assert first == second and sum(first.values()) > 0
