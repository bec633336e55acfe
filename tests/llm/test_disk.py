"""What operators leave on disk while they run: shuffles and tables that nothing reads again go."""

import os
import random

import pytest

from outagelens.llm import _common, jaccard_join, ngram_lm
from outagelens.session import checkpoint_dir


@pytest.fixture(scope="module")
def llm(spark):
    return _common.ship(spark)


def left(spark, before=()):
    """Names of the stored tables below the checkpoint folder."""
    top = checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("llm-")} - set(before)


def test_stored_keeps_the_setting_and_discard_deletes(llm):
    before = llm.conf.get(_common.CLEANUP, None)
    table = _common.stored(llm.range(1000).groupBy("id").count(), "once")
    assert llm.conf.get(_common.CLEANUP, None) == before
    assert table.count() == 1000 and any(f.startswith("llm-once-") for f in left(llm))
    _common.discard(table)
    assert not any(f.startswith("llm-once-") for f in left(llm))
    with pytest.raises(ValueError):
        _common.discard(llm.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_jaccard_shuffles_sets_once_and_drops_tables(llm):
    rng, before = random.Random(3), left(llm)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in base)) for i in range(30)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.similar_documents(docs).count() == 30
    names = {f.removeprefix("llm-").rsplit("-", 1)[0] for f in left(llm, before)}
    assert "jaccard-prefixes" in names
    assert not names & {"jaccard-lists", "jaccard0-left", "jaccard0-sets", "jaccard-round0", "jaccard-round1"}

    sets = llm.createDataFrame([(1, 2, [1, 2]), (2, 2, [1, 2]), (3, 1, [5])], "cid long, n int, tokens array<long>").repartition(2)
    pairs = llm.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = jaccard_join._joined(pairs, _common.stored(sets, "sets"), "size(array_intersect(x.tokens, y.tokens)) = x.n")
        assert [tuple(r) for r in joined.collect()] == [(1, 2)]
        assert "ReusedExchange" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        llm.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quality_rules_score_by_folds_and_drop_tables(llm):
    before = left(llm)
    rows = [(i, f"abra cadabra band {i} banana", "x") for i in range(40)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2, "doc_id")
    assert ngram_lm.quality_rules(docs).count() == 40
    names = {f.removeprefix("llm-").rsplit("-", 1)[0] for f in left(llm, before)}
    assert {"quality-scores-0", "quality-scores-1"} <= names and not any(n.startswith("kn-") for n in names)
