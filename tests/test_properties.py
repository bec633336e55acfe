"""Properties: splits, folds, balancing, determinism under repartitioning,
prefix sums, quantiles, numeric approximations, model outputs."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.operators import frames as fr
from outagelens.operators import resample as rsm
from outagelens.operators import fits
from outagelens.operators import stats as stx
from outagelens.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def frame(spark):
    from conftest import SF_MID
    from outagelens.plans.q_learning import model_frame
    from outagelens.sources.tables import Tables
    return model_frame(Tables(spark, SF_MID)).cache()


def test_split_proportions_per_stratum(frame):
    sp = rsm.initial_split(frame, "status", "outage_id", 0.8, 7)
    g = {(r.status, r.split): r.n for r in sp.groupBy("status", "split").agg(F.count("*").alias("n")).collect()}
    for s in ("down", "up"):
        n = g.get((s, "training"), 0) + g.get((s, "testing"), 0)
        assert g[(s, "training")] == math.floor(n * 0.8)


def test_folds_disjoint_and_complete(frame):
    f = rsm.vfold(frame, "status", "outage_id", 10, 3)
    assert f.count() == frame.count()
    assert f.select("outage_id").distinct().count() == frame.count()
    sizes = [r.n for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2


def test_same_rows_under_other_partitioning(spark, frame):
    a = {(r.outage_id, r.split) for r in rsm.initial_split(frame, "status", "outage_id", 0.8, 11).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        b = {(r.outage_id, r.split) for r in rsm.initial_split(frame.repartition(37), "status", "outage_id", 0.8,
                                                              11).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_balancing_counts(frame):
    counts = {r.status: r.n for r in frame.groupBy("status").agg(F.count("*").alias("n")).collect()}
    n_min, n_max = min(counts.values()), max(counts.values())
    down = {r.status: r.n for r in rsm.downsample(frame, "status", "outage_id").groupBy("status")
            .agg(F.count("*").alias("n")).collect()}
    assert set(down.values()) == {n_min}
    up = {r.status: r.n for r in rsm.upsample(frame, "status", "outage_id", ["down", "up"]).groupBy("status")
          .agg(F.count("*").alias("n")).collect()}
    assert set(up.values()) == {n_max}
    ro = rsm.rose(frame.select("outage_id", "status", "sin_energia", "mg_trabajando"), "status", "outage_id",
                  ["sin_energia", "mg_trabajando"], ["down", "up"])
    rc = {r.status: r.n for r in ro.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert set(rc.values()) == {n_max}


def test_recipe_uses_training_rows_only(frame):
    from outagelens.operators.recipes import Normalize, Recipe
    sp = rsm.initial_split(frame, "status", "outage_id", 0.8, 5)
    train = sp.filter("split = 'training'")
    rec = Recipe([Normalize(["sin_energia"])]).fit(train)
    m, s = rec.fitted[0]._stats["sin_energia"]
    vals = [r.sin_energia for r in train.select("sin_energia").collect()]
    assert m == pytest.approx(statistics.fmean(vals))
    assert s == pytest.approx(statistics.stdev(vals))
    z = rec.transform(train).agg(F.avg("sin_energia").alias("m")).first().m
    assert abs(z) < 1e-9


def test_running_totals_and_row_ids(spark):
    rows = [(g, i, float(i % 7)) for g in ("a", "b") for i in range(1000)] + [("c", 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = fr.running_totals(df, ["i"], {"cs": F.col("v")}, group=["g"], partitions=7).collect()
    got = {(r.g, r.i): r.cs for r in out}
    for g in ("a", "b"):
        acc = 0.0
        for i in range(1000):
            acc += i % 7
            assert got[(g, i)] == acc
    ids = sorted(r.id for r in fr.row_ids(df, ["g", "i"], "id", partitions=5).collect())
    assert ids == list(range(1, len(rows) + 1))


def test_exact_quantiles_type7(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(2.0, 1001).tolist()
    df = spark.createDataFrame([(float(v), "a" if i % 3 else "b") for i, v in enumerate(x)], "x double, g string")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", [0.1, 0.5, 0.9], by=["g"]).collect()}
    for g in ("a", "b"):
        vals = [v for i, v in enumerate(x) if (("a" if i % 3 else "b") == g)]
        for p in (0.1, 0.5, 0.9):
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_normal_approximations(spark):
    nd = statistics.NormalDist()
    ps = [0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    q = [r.q for r in df.select(F.expr(stx.qnorm_sql("p")).alias("q")).collect()]
    for p, v in zip(ps, q):
        assert v == pytest.approx(nd.inv_cdf(p), abs=2e-9 * max(1, abs(v)) + 1.2e-9)
    zs = [-4.0, -1.3, 0.0, 0.7, 2.5]
    dz = spark.createDataFrame([(z,) for z in zs], "z double")
    c = [r.c for r in dz.select(F.expr(stx.pnorm_sql("z")).alias("c")).collect()]
    for z, v in zip(zs, c):
        assert v == pytest.approx(nd.cdf(z), abs=1e-7)


def test_pretty_breaks_like_r():
    assert stx.pretty_breaks(0, 1, 5) == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert stx.pretty_breaks(1, 100, 8, min_n=1) == list(range(0, 101, 10))
    assert stx.pretty_breaks(-3.2, 17.9, 7, min_n=1) == [-5, 0, 5, 10, 15, 20]


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(10, 2, 2000)], "x double")
    d = fits.kernel_density(df, "x").orderBy("point").collect()
    step = d[1].x - d[0].x
    assert sum(r.density for r in d) * step == pytest.approx(1.0, abs=0.01)


def test_correlation_drop_rule():
    from outagelens.operators.recipes import correlation_drops
    pairs = [("a", "b", 0.95), ("a", "c", 0.2), ("b", "c", 0.5)]
    assert correlation_drops(["a", "b", "c"], pairs, 0.9) == ["b"]


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from outagelens.operators import metrics as mt
    rng = np.random.default_rng(1)
    rows = [(i, "down" if rng.random() < 0.3 else "up", float(round(rng.random(), 2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, truth string, prob double").withColumn("m", F.lit("x"))
    ours = mt.roc_auc(df, ["m"], "down").first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="y", metricName="areaUnderROC")
    ref = ev.evaluate(df.withColumn("y", F.when(F.col("truth") == "down", 1.0).otherwise(0.0)))
    assert ours == pytest.approx(ref, abs=1e-9)


def test_predictions_are_probabilities(spark):
    from conftest import SF_MID
    import __spark_entry__ as E
    p = E.queries()["l01_logistic_regression"](spark, SF_MID)
    r = p.agg(F.min("prob").alias("lo"), F.max("prob").alias("hi"), F.count("*").alias("n")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0 and r.n > 0


def test_named_recipes_fit_and_apply(frame):
    """Every named recipe fits on training rows only and applies to test
    rows; balancing steps change the training rows only (R9)."""
    from outagelens.operators.recipes import named_recipes
    sp = rsm.initial_split(frame.drop("siteid", "tanque"), "status", "outage_id", 0.8, 5)
    train, test = sp.filter("split = 'training'"), sp.filter("split = 'testing'")
    recs = named_recipes("status", "outage_id", ["mtto", "tipo_bateria"], ["sin_energia", "mg_trabajando"],
                         ["down", "up"])
    n_test = test.count()
    for name, make in recs.items():
        rec = make().fit(train)
        assert rec.transform(test).count() == n_test, name
        counts = [r.n for r in rec.juice().groupBy("status").agg(F.count("*").alias("n")).collect()]
        assert len(set(counts)) == 1, (name, counts)  # every recipe balances
    assert len(recs) == 8


def test_rename_names(spark):
    """``str_replace_all("numeric\\\\.", "")`` on column names."""
    from outagelens.operators.columns import rename_with
    df = spark.createDataFrame([(1.0, 2.0)], "`numeric.mean` double, `numeric.p50` double")
    assert rename_with(df, lambda c: c.replace("numeric.", "")).columns == ["mean", "p50"]


def test_correlation_matches_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    from conftest import SF_SMALL
    from outagelens.sources.tables import Tables
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = Tables(spark, SF_SMALL).lineitem
    ours = {(r.var1, r.var2): r.corr for r in stx.corr_matrix(li, cols, shift=None).collect()}
    v = VectorAssembler(inputCols=cols, outputCol="f").transform(li)
    m = Correlation.corr(v, "f").first()[0].toArray()
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                assert ours[(a, b)] == pytest.approx(m[i][j], abs=1e-12)


def test_normalize_matches_standard_scaler(frame):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from outagelens.operators.recipes import Normalize, Recipe
    cols = ["sin_energia", "mg_trabajando"]
    rec = Recipe([Normalize(cols)]).fit(frame)
    ours = rec.transform(frame).orderBy("outage_id").select(*cols).collect()
    v = VectorAssembler(inputCols=cols, outputCol="f").transform(frame)
    sc = StandardScaler(inputCol="f", outputCol="z", withMean=True, withStd=True).fit(v)
    ref = sc.transform(v).orderBy("outage_id").select("z").collect()
    for a, b in zip(ours, ref):
        assert a[0] == pytest.approx(b.z[0], abs=1e-9) and a[1] == pytest.approx(b.z[1], abs=1e-9)


def test_smote_points_on_segment(spark, frame):
    from outagelens.operators import neighbors as nb
    tr = frame.select("outage_id", "status", "sin_energia", "dia")
    syn = nb.smote(tr, "status", "outage_id", ["sin_energia", "dia"], ["down", "up"], k=5).collect()
    src = {r.outage_id: (r.sin_energia, float(r.dia), r.status) for r in tr.collect()}
    counts = {r.status: r.n for r in tr.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert len(syn) == max(counts.values()) - min(counts.values())
    for r in syn:
        b, n = src[r.base_id], src[r.neighbor_id]
        assert b[2] == n[2] == r.status and r.base_id != r.neighbor_id
        for x, lo_hi in ((r.sin_energia, (b[0], n[0])), (r.dia, (b[1], n[1]))):
            assert min(lo_hi) - 1e-9 <= x <= max(lo_hi) + 1e-9
