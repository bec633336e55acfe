"""Bagged trees and random forests with out-of-bag votes (L2, L3) as tables of nodes.

Every tree draws its own bootstrap weights: Poisson(1) counts from
md5(seed|tree|key), the multinomial bootstrap without a table of draws, so they
need no shuffle and no state. All trees grow together, a level a round: each
task walks its rows down the splits found so far and counts weights by (node,
feature, bin, class); the counts combine before one shuffle of a few numbers a
node, where the best Gini split of every node is chosen. A tree votes only for
rows that it left out (weight 0), which gives the out-of-bag error without a
second data set. What is on the driver is the model: splits and class counts
of its nodes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators.quantiles import exact_quantiles

# P(Poisson(1) <= k) for k = 0..8
POISSON = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(9)]
GAIN = 1e-9       # a split must improve the score by more than rounding
NODE_BITS = 40    # a node's number below its tree's number in one key


def weights(seed, trees: int, key: str) -> Column:
    """Bootstrap weight of the row in every tree, an array."""
    cdf = F.array(*[F.lit(p) for p in POISSON])
    return F.transform(F.sequence(F.lit(1), F.lit(trees)),
                       lambda t: F.size(F.filter(cdf, lambda p: p <= uniform(seed, t, key))).cast("tinyint"))


def node_features(seed, tree: int, node: int, n_features: int, mtry: int) -> list[int]:
    """Features that a node may split on: the mtry smallest md5 uniforms."""
    if mtry >= n_features:
        return list(range(n_features))
    code = lambda f: int(hashlib.md5(f"{seed}|{tree}|{node}|{f}".encode()).hexdigest()[:8], 16)
    return sorted(sorted(range(n_features), key=lambda f: (code(f), f))[:mtry])


def _bins(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: 0 for a missing one, else one more than the thresholds below it."""
    out = np.empty(x.shape, np.int16)
    for f, t in enumerate(thresholds):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(t, x[:, f], side="left"))
    return out


def _walk(bins: np.ndarray, levels: list[dict[str, np.ndarray]], trees: int) -> np.ndarray:
    """Node of each row in each tree (rows x trees), numbered as in a heap: 1, then 2i and 2i + 1."""
    node = np.ones((len(bins), trees), np.int64)
    base = np.arange(trees, dtype=np.int64) << NODE_BITS
    rows = np.arange(len(bins))[:, None]
    for level in levels:
        keys = node + base
        at = np.minimum(np.searchsorted(level["key"], keys), len(level["key"]) - 1)
        splits = level["key"][at] == keys
        right = bins[rows, level["feature"][at]] > level["bin"][at]
        node = np.where(splits, 2 * node + right, node)
    return node


def _features(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _counts(levels: list, thresholds: list, active: np.ndarray, allowed: np.ndarray, trees: int):
    """Weights by (active node, feature, bin) and class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins(_features(batch, "_x"), thresholds)
            weight = batch.column("_w").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, trees)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            keys = _walk(bins, levels, trees) + (np.arange(trees, dtype=np.int64) << NODE_BITS)
            at = np.minimum(np.searchsorted(active, keys), len(active) - 1)
            row, tree = np.nonzero((active[at] == keys) & (weight > 0))
            place = at[row, tree]
            parts = []
            width = max(len(t) for t in thresholds) + 2
            for f in range(bins.shape[1]):
                own = allowed[place, f]
                cell = (place[own] * bins.shape[1] + f) * width + bins[row[own], f]
                parts.append((cell, weight[row[own], tree[own]], y[row[own]]))
            cell, w, event = (np.concatenate(p) for p in zip(*parts))
            found, back = np.unique(cell, return_inverse=True)
            n1 = np.bincount(back, w * event, len(found)).astype(np.int64)
            n0 = np.bincount(back, w * (1 - event), len(found)).astype(np.int64)
            rest, b = np.divmod(found, width)
            a, f = np.divmod(rest, bins.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(f), pa.array(b), pa.array(n0), pa.array(n1)],
                                             names=["a", "f", "b", "n0", "n1"])
    return run


class Forest:
    """A fitted forest: thresholds of the bins, splits by level, class counts of every node."""

    def __init__(self, features: list[str], thresholds: list[np.ndarray], trees: int):
        self.features, self.thresholds, self.trees = features, thresholds, trees
        self.levels: list[dict[str, np.ndarray]] = []
        self.counts: dict[int, tuple[int, int]] = {}  # key of a node -> weight of the other class, of the event
        self.rows: DataFrame | None = None            # the training rows with their weights

    def _shares(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(self.counts), np.int64)
        pairs = np.array([self.counts[k] for k in keys.tolist()], float).reshape(-1, 2)
        return keys, pairs[:, 1] / np.maximum(pairs.sum(axis=1), 1)

    def votes(self, df: DataFrame, key: str, out_of_bag: bool = False) -> DataFrame:
        """Rows (key, n_trees, prob): trees that vote and the mean share of the event in their leaves.

        With ``out_of_bag`` the rows are the training rows and only trees that left a row out vote for it;
        a row that every tree drew has no probability."""
        levels, thresholds, trees = self.levels, self.thresholds, self.trees
        keys, share = self._shares()
        base = np.arange(trees, dtype=np.int64) << NODE_BITS

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                node = _walk(_bins(_features(batch, "_x"), thresholds), levels, trees)
                p = share[np.searchsorted(keys, node + base)]
                takes = np.ones(p.shape, bool)
                if out_of_bag:
                    takes = batch.column("_w").flatten().to_numpy(zero_copy_only=False).reshape(-1, trees) == 0
                n = takes.sum(axis=1)
                mean = np.where(takes, p, 0.0).sum(axis=1) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(mean, mask=n == 0)],
                                                 names=["key", "n_trees", "prob"])

        rows = df.select(key, "_x", "_w") if out_of_bag else df.select(key, _vector(self.features).alias("_x"))
        kind = dict(rows.dtypes)[key]
        return rows.mapInArrow(run, f"key {kind}, n_trees long, prob double").withColumnRenamed("key", key)

    def out_of_bag(self, key: str) -> DataFrame:
        """Rows (key, _y, n_trees, prob) of the training rows."""
        return self.votes(self.rows, key, out_of_bag=True).join(self.rows.select(key, "_y"), key)

    def importance(self) -> list[tuple[str, float]]:
        """(feature, decrease of the weighted Gini impurity by its splits, a mean over trees), largest first."""
        total = np.zeros(len(self.features))
        for level in self.levels:
            np.add.at(total, level["feature"], level["gain"])
        return sorted(zip(self.features, (total / max(self.trees, 1)).tolist()), key=lambda x: (-x[1], x[0]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table: (tree, node, feature, threshold, n_other, n_event); a leaf has no feature.

        A value up to the threshold, or a missing one, goes to node 2i, others to 2i + 1; without a threshold
        only missing values go to 2i."""
        splits = {int(k): (int(f), int(b)) for level in self.levels for k, f, b in zip(level["key"], level["feature"], level["bin"])}
        rows = []
        for k, (n0, n1) in sorted(self.counts.items()):
            f, b = splits.get(k, (None, None))
            cut = None if f is None or b == 0 else float(self.thresholds[f][b - 1])
            rows.append((k >> NODE_BITS, k & ((1 << NODE_BITS) - 1), None if f is None else self.features[f], cut, n0, n1))
        return spark.createDataFrame([(t + 1, *r) for t, *r in rows],
                                     "tree int, node long, feature string, threshold double, n_other long, n_event long")


def _vector(features: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def _best(counts: DataFrame) -> DataFrame:
    """Best split of each node: largest sum over both sides of squared class weights by their total (ties: first feature, first bin)."""
    upto = Window.partitionBy("a", "f").orderBy("b")  # the bins of a node and a feature
    whole = Window.partitionBy("a", "f")
    c = counts.groupBy("a", "f", "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    c = c.repartition("a")  # features x bins rows of a node: the windows and the choice need no further shuffle
    c = c.select("a", "f", "b", F.sum("n0").over(upto).alias("l0"), F.sum("n1").over(upto).alias("l1"),
                 F.sum("n0").over(whole).alias("t0"), F.sum("n1").over(whole).alias("t1"))
    c = c.withColumns({"r0": F.col("t0") - F.col("l0"), "r1": F.col("t1") - F.col("l1")}).where("r0 + r1 > 0")
    side = lambda s: (F.col(f"{s}0") * F.col(f"{s}0") + F.col(f"{s}1") * F.col(f"{s}1")) / (F.col(f"{s}0") + F.col(f"{s}1"))
    c = c.withColumn("score", side("l") + side("r")).withColumn("gain", F.col("score") - side("t")).where(F.col("score") > side("t") + GAIN)
    best = F.min(F.struct((-F.col("score")).alias("s"), "f", "b", "l0", "l1", "r0", "r1", "gain"))
    return c.groupBy("a").agg(best.alias("m")).select("a", "m.*")


def fit_forest(train: DataFrame, features: list[str], label: str, levels: list[str], key: str, trees: int = 1000,
               mtry: int | None = None, min_n: int = 2, max_depth: int = 30, max_bins: int = 32, seed=2021) -> Forest:
    """Grow ``trees`` Gini trees on bootstrap weights; without ``mtry`` every
    feature may split a node (bagging).  Split candidates are the distinct
    quantiles of a feature at ``max_bins`` - 1 even steps; missing values go
    left.  Nodes under ``min_n`` weight, pure ones and those at ``max_depth``
    are leaves.  Rows with another label are left out."""
    spark = train.sparkSession
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    rows = train.where(F.col(label).isin(levels)).select(
        key, (F.col(label) == levels[0]).cast("int").alias("_y"), _vector(features).alias("_x"), weights(seed, trees, key).alias("_w"))
    # every level is a pass of array work over these rows: spread them, whatever the plan before them coalesced
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).checkpoint(eager=True)
    long = rows.select(F.posexplode("_x").alias("f", "v")).where("v is not null and not isnan(v)")
    cuts: dict[int, set] = {}
    for r in exact_quantiles(long, "v", [i / max_bins for i in range(1, max_bins)], by=["f"]).collect():  # max_bins numbers a feature
        cuts.setdefault(r["f"], set()).add(r["q"])
    forest = Forest(list(features), [np.array(sorted(cuts.get(f, ()))) for f in range(len(features))], trees)
    forest.rows = rows
    drawn = F.transform("_w", lambda w: F.struct(w.cast("long").alias("w")))
    totals = rows.select("_y", F.posexplode(drawn).alias("t", "s")).groupBy("t").agg(
        F.sum(F.col("s.w") * (1 - F.col("_y"))).alias("n0"), F.sum(F.col("s.w") * F.col("_y")).alias("n1")).collect()  # a line a tree
    forest.counts = {r["t"] << NODE_BITS | 1: (r["n0"], r["n1"]) for r in totals}
    fresh = dict(forest.counts)
    p = len(features)
    for _ in range(max_depth):
        grows = sorted(k for k, (n0, n1) in fresh.items() if n0 and n1 and n0 + n1 >= min_n)
        if not grows:
            break
        active = np.array(grows, np.int64)
        allowed = np.zeros((len(grows), p), bool)
        for i, k in enumerate(grows):
            allowed[i, node_features(seed, (k >> NODE_BITS) + 1, k & ((1 << NODE_BITS) - 1), p, mtry or p)] = True
        counts = rows.mapInArrow(_counts(forest.levels, forest.thresholds, active, allowed, trees), "a long, f long, b long, n0 long, n1 long")
        best = sorted(_best(counts).collect(), key=lambda r: r["a"])  # a line a node of the level
        if not best:
            break
        forest.levels.append({"key": active[[r["a"] for r in best]], "feature": np.array([r["f"] for r in best]),
                              "bin": np.array([r["b"] for r in best]), "gain": np.array([r["gain"] for r in best])})
        fresh = {}
        for r in best:
            k = int(active[r["a"]])
            child = (k >> NODE_BITS) << NODE_BITS | 2 * (k & ((1 << NODE_BITS) - 1))
            fresh[child], fresh[child + 1] = (r["l0"], r["l1"]), (r["r0"], r["r1"])
        forest.counts.update(fresh)
    return forest


def oob_error(votes: DataFrame) -> DataFrame:
    """One row (n, oob_error, oob_brier) of rows (_y, prob): share of wrong majority votes and mean squared error of the probability."""
    wrong = F.when(F.col("prob") > 0.5, F.lit(1)).otherwise(F.lit(0)) != F.col("_y")
    return votes.where("prob is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("double")).alias("oob_error"),
                                               F.avg(F.pow(F.col("prob") - F.col("_y"), 2)).alias("oob_brier"))


def replay(nodes: DataFrame, rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """Predictions from the table of nodes alone: rows (key, prob).

    An iterated equi-join: a row meets its node of each tree and moves to the
    child until every node is a leaf; rounds are the depth of the trees."""
    held = rows.select(key, F.map_from_arrays(F.array(*[F.lit(c) for c in features]), _vector(features)).alias("_m"))
    held = held.checkpoint(eager=True)
    trees = nodes.agg(F.max("tree")).first()[0] or 0  # one number
    at = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(trees)) if trees else F.array().cast("array<int>")).alias("tree"),
                     F.lit(1).cast("long").alias("node"))
    done = []
    while True:
        met = at.join(nodes, ["tree", "node"]).checkpoint(eager=True)
        done.append(met.where("feature is null").select(key, F.try_divide("n_event", F.col("n_other") + F.col("n_event")).alias("p")))
        value = F.element_at("_m", F.col("feature"))
        left = value.isNull() | F.isnan(value) | F.coalesce(value <= F.col("threshold"), F.lit(False))
        at = met.where("feature is not null").select(key, "_m", "tree", (2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"))
        if met.where("feature is not null").limit(1).count() == 0:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(key).agg(F.avg("p").alias("prob"))


# ---------------------------------------------------------------- the same in SQL, for checks

def forest_sql(rows: str, key: str, features: list[str], trees: int, mtry: int, min_n: int, max_depth: int, max_bins: int, seed) -> str:
    """Table expressions that grow the same forest from the rows of the table
    expression ``rows`` (key, y, learns, features) that learn: ``fv`` (tree,
    key, w, share, node) holds each row's leaf, ``fg`` (f, gain) the splits."""
    u = lambda *k: "(('0x' || substr(md5(" + " || '|' || ".join([f"'{seed}'", *[f"CAST({x} AS VARCHAR)" for x in k]]) + "), 1, 8))::BIGINT"
    p = len(features)
    steps = ", ".join(f"{i}.0 / {max_bins}" for i in range(1, max_bins))
    bins = " UNION ALL ".join(
        f"SELECT {key}, {f} AS f, CASE WHEN {c} IS NULL THEN 0 ELSE 1 + len(list_filter((SELECT list_distinct(quantile_cont("
        f"CAST({c} AS DOUBLE), [{steps}])) FROM {rows} WHERE learns), lambda t: t < CAST({c} AS DOUBLE))) END AS b FROM {rows}"
        for f, c in enumerate(features))
    draw = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in POISSON)
    parts = [f"fb AS MATERIALIZED ({bins})",
             f"fw AS MATERIALIZED (SELECT tree, {key}, y, CASE WHEN learns THEN {draw} ELSE 0 END AS w FROM (SELECT t.tree, r.{key}, r.y, r.learns, {u('t.tree', f'r.{key}')} / 4294967296.0) AS u "
             f"FROM {rows} r, (SELECT unnest(range(1, {trees + 1})) AS tree) t))",
             f"s0 AS MATERIALIZED (SELECT tree, {key}, y, w, CAST(1 AS BIGINT) AS node FROM fw)"]
    for d in range(max_depth + 1):
        parts.append(f"n{d} AS MATERIALIZED (SELECT tree, node, sum(w * (1 - y)) AS n0, sum(w * y) AS n1 FROM s{d} GROUP BY tree, node)")
        if d == max_depth:
            parts.append(f"l{d} AS (SELECT s.*, n1 / greatest(n0 + n1, 1) AS share FROM s{d} s JOIN n{d} USING (tree, node))")
            break
        parts += [
            f"a{d} AS (SELECT tree, node, f FROM n{d}, (SELECT unnest(range({p})) AS f) WHERE n0 > 0 AND n1 > 0 AND n0 + n1 >= {min_n} "
            f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {u('tree', 'node', 'f')}), f) <= {mtry})",
            f"h{d} AS (SELECT a.tree, a.node, a.f, b.b, sum(w * (1 - y)) AS n0, sum(w * y) AS n1 FROM s{d} s JOIN a{d} a USING (tree, node) "
            f"JOIN fb b ON b.{key} = s.{key} AND b.f = a.f WHERE s.w > 0 GROUP BY ALL)",
            f"c{d} AS (SELECT tree, node, f, b, sum(n0) OVER u AS l0, sum(n1) OVER u AS l1, sum(n0) OVER t AS t0, sum(n1) OVER t AS t1 "
            f"FROM h{d} WINDOW u AS (PARTITION BY tree, node, f ORDER BY b), t AS (PARTITION BY tree, node, f))",
            f"g{d} AS (SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 - l0 + t1 - l1) AS score "
            f"FROM c{d} WHERE t0 - l0 + t1 - l1 > 0)",
            f"x{d} AS MATERIALIZED (SELECT tree, node, f, b, score - (t0 * t0 + t1 * t1) / (t0 + t1) AS gain FROM g{d} WHERE score > (t0 * t0 + t1 * t1) / (t0 + t1) + {GAIN!r} "
            f"QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, b) = 1)",
            f"l{d} AS (SELECT s.*, n1 / greatest(n0 + n1, 1) AS share FROM s{d} s JOIN n{d} USING (tree, node) ANTI JOIN x{d} USING (tree, node))",
            f"s{d + 1} AS MATERIALIZED (SELECT s.tree, s.{key}, s.y, s.w, 2 * s.node + CASE WHEN b.b > x.b THEN 1 ELSE 0 END AS node "
            f"FROM s{d} s JOIN x{d} x USING (tree, node) JOIN fb b ON b.{key} = s.{key} AND b.f = x.f)"]
    parts.append("fg AS (" + " UNION ALL ".join(f"SELECT f, gain FROM x{d}" for d in range(max_depth)) + ")")
    parts.append("fv AS (" + " UNION ALL ".join(f"SELECT tree, {key}, y, w, share, node FROM l{d}" for d in range(max_depth + 1)) + ")")
    return ", ".join(parts)
