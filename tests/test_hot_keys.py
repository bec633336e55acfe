"""Distributed operators stay exact when one key holds a third of the rows
and spans many partitions (checked against pandas on the driver)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outagelens.operators import aggregates as ag
from outagelens.operators import frames as fr


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(42)
    n = 6000
    keys = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 400, n))
    pdf = pd.DataFrame({"k": keys.astype("int64"), "t": rng.permutation(n).astype("int64"),
                        "v": rng.integers(0, 50, n).astype("float64")})
    pdf.loc[pdf.sample(frac=0.05, random_state=1).index, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype({"v": "float64"})).withColumn(
        "v", F.when(F.isnan("v"), F.lit(None)).otherwise(F.col("v"))).repartition(13)
    return df, pdf


def test_lag_same_key_hot(spark, hot):
    df, pdf = hot
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = ag.lag_same_key(df, "k", ["t"], "v", "nv", partitions=17).select("k", "t", "nv").toPandas()
        small = ag.lag_same_key(df, "k", ["t"], "v", "nv").select("k", "t", "nv").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    exp = pdf.sort_values(["k", "t"]).copy()
    prev = exp.groupby("k")["v"].shift(1)
    first = exp.groupby("k").cumcount() == 0
    exp["nv"] = np.where(first, exp["v"], prev)
    for res in (got, small):  # with and without an explicit partition count
        m = exp.merge(res, on=["k", "t"], suffixes=("_e", "_g"))
        assert len(m) == len(pdf)
        assert ((m.nv_e.isna() & m.nv_g.isna()) | (m.nv_e == m.nv_g)).all()


def test_slice_and_running_count_hot(hot):
    df, pdf = hot
    got = fr.slice_rows(df, ["k"], ["t"], 2, 9).select("k", "t").toPandas()
    exp = pdf.sort_values(["k", "t"]).assign(rn=lambda d: d.groupby("k").cumcount() + 1)
    exp = exp[(exp.rn >= 2) & (exp.rn <= 9)][["k", "t"]]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, exp.values))


def test_top_n_with_ties_hot(hot):
    df, pdf = hot
    got = fr.top_n_with_ties(df, ["k"], "v", 3, desc=True).select("k", "t").toPandas()
    p = pdf.copy()
    p["rk"] = p.groupby("k")["v"].rank(method="min", ascending=False, na_option="bottom")
    exp = p[p.rk <= 3][["k", "t"]]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, exp.values))


def test_first_per_key_and_top_one_hot(hot):
    df, pdf = hot
    got = fr.first_per_key(df, ["k"], ["t"]).select("k", "t").toPandas()
    exp = pdf.sort_values(["k", "t"]).groupby("k").head(1)[["k", "t"]]
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, exp.values))
    top = fr.top_one(df, ["k"], "v", desc=True, tiebreak=["t"]).select("k", "t").toPandas()
    p = pdf.assign(nl=pdf.v.isna(), sk=-pdf.v).sort_values(["k", "nl", "sk", "t"]).groupby("k").head(1)
    assert sorted(map(tuple, top.values)) == sorted(map(tuple, p[["k", "t"]].values))


def test_quantiles_hot(spark, hot):
    from outagelens.operators.quantiles import exact_quantiles
    df, pdf = hot
    got = {(r.k, r.p): r.q for r in exact_quantiles(df, "v", [0.25, 0.5], by=["k"]).collect()}
    for k in (0, 1, 7):
        vals = pdf[pdf.k == k].v.dropna()
        for p in (0.25, 0.5):
            assert got[(k, p)] == pytest.approx(float(np.quantile(vals, p)))


def test_null_group_keeps_its_rows(spark):
    rows = [(None, i, 1.0) for i in range(50)] + [("a", i, 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = fr.running_totals(df, ["i"], {"cs": F.col("v")}, group=["g"], partitions=3)
    got = {(r.g, r.i): r.cs for r in out.collect()}
    assert len(got) == 100 and got[(None, 49)] == 50.0 and got[("a", 49)] == 100.0
    lagged = ag.lag_same_key(df, "g", ["i"], "v", "nv").collect()
    assert len(lagged) == 100


def test_top_n_with_ties_keeps_nulls_of_a_short_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("a", None), ("b", 5.0), ("b", 4.0), ("b", 3.0), ("b", None),
            (None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = fr.top_n_with_ties(df, ["k"], "v", 3).collect()
    kept = sorted((r["k"] or "", r["v"] or 0.0) for r in got)
    assert kept == sorted((k or "", v or 0.0) for k, v in rows if (k, v) != ("b", None))


def test_running_totals_null_group_no_group_and_empty(spark):
    df = spark.range(1000).selectExpr("id", "nullif(id % 4, 0) AS g", "nullif(id, 7) AS v").repartition(9)
    for group in ([], ["g"]):
        got = fr.running_totals(df, ["id"], {"s": F.col("v"), "n": F.lit(1.5)}, group=group, partitions=11).collect()
        assert len(got) == 1000
        for r in got:
            before = [i for i in range(r["id"] + 1) if not group or i % 4 == r["id"] % 4]
            assert (r["s"], r["n"]) == (sum(i for i in before if i != 7), 1.5 * len(before))
    empty = fr.running_totals(df.where("id < 0"), ["id"], {"s": F.col("v")}, group=["g"])
    assert empty.count() == 0 and empty.columns == ["id", "g", "v", "s"]


def test_running_totals_shuffles_the_data_once(spark):
    df = spark.range(1000).selectExpr("id", "id % 4 AS g")
    plan = fr.running_totals(df, ["id"], {"n": F.lit(1)}, group=["g"])._jdf.queryExecution().executedPlan().toString()
    # behind the checkpoint only the one-row-per-partition table moves
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(_t0") == 1 and plan.count("Exchange hashpartitioning") == 1
