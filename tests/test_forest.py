"""Forests: table of nodes against the walk, out-of-bag votes against a plain tree by tree growth, odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.models import forest as fo


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)).round(2)
    down = x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) * 0.7 > 0.3
    data = [(i, "down" if d else "up", float(a), None if i % 11 == 0 else float(b), float(c)) for i, (d, (a, b, c)) in enumerate(zip(down, x))]
    data += [(1000, None, 1.0, 1.0, 1.0), (1001, "other", 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "id long, y string, a double, b double, c double").repartition(5)


def plain_weights(seed, tree, key):
    u = int(hashlib.md5(f"{seed}|{tree}|{key}".encode()).hexdigest()[:8], 16) / 2 ** 32
    return sum(u >= p for p in fo.POISSON)


def plain_tree(x, y, w, thresholds, allowed, min_n, node=1):
    """Grown recursively: {node: (feature, threshold index) or share}."""
    n0, n1 = (w * (1 - y)).sum(), (w * y).sum()
    best = None
    if n0 and n1 and n0 + n1 >= min_n:
        for f in allowed(node):
            bins = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(thresholds[f], x[:, f], side="left"))
            for b in sorted(set(bins[w > 0].tolist())):
                left = bins <= b
                l0, l1 = (w * (1 - y))[left].sum(), (w * y)[left].sum()
                r0, r1 = n0 - l0, n1 - l1
                if r0 + r1 == 0:
                    continue
                score = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
                if score > (n0 * n0 + n1 * n1) / (n0 + n1) + fo.GAIN and (best is None or score > best[0]):
                    best = (score, f, b, left)
    if best is None:
        return {node: n1 / max(n0 + n1, 1)}, np.full(len(y), n1 / max(n0 + n1, 1))
    share, tree = np.empty(len(y)), {node: best[1:3]}
    for side, at in ((2 * node, best[3]), (2 * node + 1, ~best[3])):
        own, p = plain_tree(x[at], y[at], w[at], thresholds, allowed, min_n, side)
        tree.update(own)
        share[at] = p
    return tree, share


@pytest.mark.parametrize("mtry,min_n", [(1, 2), (3, 12)])
def test_forest_equals_plain_growth(rows, mtry, min_n):
    trees = 6
    forest = fo.fit_forest(rows, ["a", "b", "c"], "y", ["down", "up"], "id", trees, mtry, min_n, max_bins=16, seed=7)
    data = rows.where("y in ('down', 'up')").orderBy("id").collect()
    x = np.array([[np.nan if v is None else v for v in (r.a, r.b, r.c)] for r in data])
    y = np.array([int(r.y == "down") for r in data])
    thresholds = [np.unique(np.quantile(v[~np.isnan(v)], np.arange(1, 16) / 16)) for v in x.T]
    votes = {r.id: r for r in forest.out_of_bag("id").collect()}
    assert sorted(votes) == [r.id for r in data]
    total, n = np.zeros(len(y)), np.zeros(len(y))
    splits = 0
    for t in range(1, trees + 1):
        w = np.array([plain_weights(7, t, r.id) for r in data])
        tree, share = plain_tree(x, y, w, thresholds, lambda node: fo.node_features(7, t, node, 3, mtry), min_n)
        splits += sum(isinstance(v, tuple) for v in tree.values())
        total += np.where(w == 0, share, 0)
        n += w == 0
    assert splits == sum(len(level["key"]) for level in forest.levels)
    for r, s, k in zip(data, total, n):
        assert votes[r.id].n_trees == k
        assert votes[r.id].prob == (None if k == 0 else pytest.approx(s / k))
    error = fo.oob_error(forest.out_of_bag("id")).first()
    assert error.n == (n > 0).sum() and 0 < error.oob_error < 0.5 and 0 < error.oob_brier < 0.25


def test_table_of_nodes_replays_the_forest(spark, rows):
    forest = fo.fit_forest(rows, ["a", "b", "c"], "y", ["down", "up"], "id", 5, 2)
    walk = {r.id: r.prob for r in forest.votes(rows, "id").collect()}
    table = forest.nodes(spark)
    again = {r.id: r.prob for r in fo.replay(table, rows, ["a", "b", "c"], "id").collect()}
    assert len(walk) == 402 and again == pytest.approx(walk)
    assert table.where("feature is null").count() == table.where("feature is not null").count() + 5
    gains = forest.importance()
    assert gains[0][0] == "a" and all(g >= 0 for _, g in gains) and len(gains) == 3


def test_one_class_and_no_rows(spark, rows):
    one = fo.fit_forest(rows.where("y = 'up'"), ["a"], "y", ["down", "up"], "id", 3)
    assert {r.prob for r in one.votes(rows, "id").collect()} == {0.0} and not one.levels
    none = fo.fit_forest(rows.where(F.lit(False)), ["a"], "y", ["down", "up"], "id", 3)
    assert none.out_of_bag("id").count() == 0 and fo.oob_error(none.out_of_bag("id")).first().n == 0


def test_default_is_a_thousand_deep_trees():
    import inspect
    params = inspect.signature(fo.fit_forest).parameters
    assert params["trees"].default == 1000 and params["max_depth"].default == 30
