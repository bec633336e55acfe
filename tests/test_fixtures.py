"""Semantic traps on tiny hand-written frames (FIXTURES.md section A)."""

import datetime as dt

from pyspark.sql import functions as F

from outagelens.functions import nulls as nx
from outagelens.functions import text as tx
from outagelens.functions.names import clean_names
from outagelens.operators import aggregates as ag
from outagelens.operators import frames as fr
from outagelens.operators import joins as jn
from outagelens.operators import recipes as rc


def ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S")


def test_not_in_keeps_na_r_form(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "x string")
    r_form = df.filter(fr.not_in_keep_na("x", ["A"])).collect()
    sql_form = df.filter(~F.col("x").isin("A")).collect()
    assert sorted([r.x for r in r_form], key=str) == ["B", None] or {r.x for r in r_form} == {"B", None}
    assert [r.x for r in sql_form] == ["B"]


def test_latest_period_skips_null(spark):
    df = spark.createDataFrame([(1, ts("2021-01-01 00:00:00")), (2, ts("2021-02-01 00:00:00")), (3, None)],
                               "id int, fecha timestamp_ntz")
    assert [r.id for r in fr.at_latest(df, "fecha").collect()] == [2]


def test_sum_strict_and_row_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, x double")
    out = {r.k: r.s for r in df.groupBy("k").agg(ag.sum_strict("x").alias("s")).collect()}
    assert out == {"a": None, "b": 2.0}
    m = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, 3.0)], "a double, b double, c double")
    assert [r.m for r in m.select(ag.row_mean_strict(["a", "b", "c"]).alias("m")).collect()] == [None, 2.0]


def test_first_per_key_uses_explicit_order(spark):
    df = spark.createDataFrame([(1, 3, "z"), (1, 1, "y"), (1, 1, "x"), (2, 5, "w")], "k int, o int, v string")
    out = {r.k: (r.o, r.v) for r in fr.first_per_key(df, ["k"], ["o", "v"]).collect()}
    assert out == {1: (1, "x"), 2: (5, "w")}


def test_full_join_null_safe(spark):
    a = spark.createDataFrame([(None, "a0"), ("S1", "a1")], "siteid string, na string")
    b = spark.createDataFrame([(None, "b0"), ("S2", "b2")], "siteid string, nb string")
    plain = jn.full_join_coalesce([a, b], "siteid")
    safe = jn.full_join_coalesce([a, b], "siteid", null_safe=True)
    assert plain.count() == 4
    rows = {(r.siteid, r.na, r.nb) for r in safe.collect()}
    assert rows == {(None, "a0", "b0"), ("S1", "a1", None), ("S2", None, "b2")}


def test_full_join_rows_without_key(spark):
    """A third of the keys missing in each source: those rows stay, each once, and take no part in the joins."""
    def frame(col, step):
        return spark.range(0, 3000, step).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("siteid"), F.col("id").alias(col))
    got = jn.full_join_coalesce([frame("a", 1), frame("b", 2), frame("c", 5)], "siteid")
    assert got.columns == ["siteid", "a", "b", "c"]
    assert got.filter("siteid is null").count() == 1000 + 500 + 200 and got.filter("siteid is not null").count() == 2000
    assert got.filter("siteid = 10 and a = 10 and b = 10 and c = 10").count() == 1


def test_null_keys_are_paired_in_several_tasks(spark):
    """All pairs of rows without a key, in a chain whose third source has none; no task makes most of them."""
    def frame(col, rows, nulls):
        return spark.range(rows).select(F.when(F.col("id") >= nulls, F.col("id")).alias("siteid"), F.col("id").alias(col))
    got = jn.full_join_coalesce([frame("a", 4110, 4100), frame("b", 2130, 2100), frame("c", 4, 0)], "siteid", null_safe=True)
    assert got.columns == ["siteid", "a", "b", "c"]
    lost = got.filter("siteid is null")
    of = lost.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("a") * 2100 + F.col("b")).alias("s")).collect()
    pairs = 4100 * 2100
    assert sum(r.n for r in of) == pairs and max(r.n for r in of) < 0.6 * pairs and sum(r.s for r in of) == pairs * (pairs - 1) // 2
    assert lost.filter("c is not null").count() == 0
    assert sorted((r.siteid, r.a, r.b, r.c) for r in got.filter("siteid is not null").collect()) == sorted(
        [(i, i, None, None) for i in range(4100, 4110)] + [(i, None, i, None) for i in range(2100, 2130)] + [(i, None, None, i) for i in range(4)])


def test_null_keys_of_one_source_and_of_none(spark):
    a = spark.createDataFrame([(1, "a1"), (None, "a0"), (None, "a0")], "siteid int, na string")
    b = spark.createDataFrame([(1, "b1")], "siteid bigint, nb string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(jn.full_join_coalesce([a, b], "siteid", null_safe=True)) == sorted([(1, "a1", "b1"), (None, "a0", None), (None, "a0", None)], key=str)
    assert rows(jn.full_join_coalesce([b, a], "siteid", null_safe=True)) == sorted([(1, "b1", "a1"), (None, None, "a0"), (None, None, "a0")], key=str)
    assert rows(jn.full_join_coalesce([a.dropna(), b], "siteid", null_safe=True)) == [(1, "a1", "b1")]


def test_sparse_dummy_many_levels(spark):
    """A million levels: sparse vectors through a table of levels; missing, unseen and reference values."""
    n = 1_000_000
    train = spark.range(n).select("id", F.format_string("s%07d", "id").alias("site"))
    step = rc.SparseDummy(["site"]).fit(train)
    odd = spark.createDataFrame([(-1, None), (-2, None), (-3, "unseen")], "id long, site string")
    out = step.transform(train.filter("id % 100000 < 2").unionByName(odd)).select("id", "site_at", "site_dummy").collect()
    assert len(out) == 23
    for r in out:
        if r.id < 0:
            assert r.site_at is None and r.site_dummy is None
        else:
            assert r.site_at == r.id - 1 and r.site_dummy.size == n - 1
            assert list(r.site_dummy.indices) == ([r.id - 1] if r.id else [])
    assert rc.SparseDummy(["site"]).fit(train.limit(0)).transform(odd).filter("site_at is null").count() == 3


def test_lag_same_ticket(spark):
    df = spark.createDataFrame([(1, ts("2021-01-05 00:00:00")), (1, ts("2021-01-09 00:00:00")),
                                (2, ts("2021-03-01 00:00:00"))], "t int, fecha timestamp_ntz")
    out = ag.lag_same_key(df, "t", ["fecha"], "fecha", "nueva").orderBy("t", "fecha").collect()
    assert [r.nueva for r in out] == [ts("2021-01-05 00:00:00"), ts("2021-01-05 00:00:00"), ts("2021-03-01 00:00:00")]


def test_unicode_trim_and_squish(spark):
    df = spark.createDataFrame([("\t  HFC@X1  \n",), ("a  \t b",)], "s string")
    out = [r.v for r in df.select(tx.trim_ws(tx.strip_prefix(tx.trim_ws("s"), "^HFC@")).alias("v")).collect()]
    assert out == ["X1", "a  \t b"]
    assert [r.v for r in df.select(tx.squish("s").alias("v")).collect()] == ["HFC@X1", "a b"]


def test_punct_keeps_symbols(spark):
    df = spark.createDataFrame([("a.b-c, $d+e^f|g (h)",)], "s string")
    assert df.select(tx.remove_punct("s").alias("v")).first().v == "abc $d+e^f|g h"
    assert df.select(tx.snake_words(F.lit("  sitio   la  joya ")).alias("v")).first().v == "sitio_la_joya"


def test_ascii_fold_and_upper(spark):
    df = spark.createDataFrame([("Peñón  Ñuñoa São Straße ",)], "s string")
    assert df.select(tx.clean_text("s").alias("v")).first().v == "PENON  NUNOA SAO STRAssE"


def test_if_else_null_and_try_cast(spark):
    df = spark.createDataFrame([(2,), (0,), (None,)], "a int")
    assert [r.v for r in df.select(nx.if_else(F.col("a") >= 1, "down", "up").alias("v")).collect()] == \
        ["down", "up", None]
    t = spark.createDataFrame([("155",), ("OTRO",), (None,)], "s string")
    assert [r.v for r in t.select(nx.parse_int("s").alias("v")).collect()] == [155, None, None]
    assert [r.v for r in t.select(nx.recode("s", {"155": "x"}).alias("v")).collect()] == ["x", None, None]


def test_title_case_and_names(spark):
    df = spark.createDataFrame([("sin ENERGIA mg",)], "s string")
    assert df.select(tx.title_case("s").alias("v")).first().v == "Sin Energia Mg"
    assert clean_names(["Site ID", "site_id", "Año Fiscal", "%Pct", "numeric.mean"]) == \
        ["site_id", "site_id_2", "ano_fiscal", "percent_pct", "numeric_mean"]


def test_drift_match_gua037(spark):
    """Battery row at 16:56:32 with 2.76 h on battery; two generator rows near
    it: the longer one (4.0086 h) is the partner; rows 11 min away and with
    no battery time never match."""
    bat = spark.createDataFrame([
        (1, "GUA037", ts("2020-07-27 16:56:32"), 2.76),
        (2, "GUA037", ts("2020-07-28 10:00:00"), 0.0),
        (3, "GUA040", ts("2020-07-27 12:00:00"), 1.0),
    ], "battery_id int, siteid string, occurred_on timestamp_ntz, rob double").filter("rob > 0")
    mg = spark.createDataFrame([
        (10, "GUA037", ts("2020-07-27 16:50:00"), 3.5),
        (11, "GUA037", ts("2020-07-27 17:01:00"), 4.0086),
        (12, "GUA037", ts("2020-07-28 10:00:00"), 9.0),
        (13, "GUA040", ts("2020-07-27 12:11:00"), 2.0),
        (14, "GUA040", ts("2020-07-27 12:09:00"), 1.0),
    ], "outage_id int, siteid string, inicio timestamp_ntz, duration double")
    out = jn.tolerance_match(bat, mg, "battery_id", "siteid", "occurred_on", "inicio", 600,
                             prefer=[-F.col("duration")], right_id="outage_id")
    got = {r.battery_id: r.outage_id for r in out.collect()}
    assert got == {1: 11, 3: 14}


def test_interval_join_bounds_inclusive(spark):
    iv = spark.createDataFrame([(1, "S", ts("2020-08-25 10:00:00"), ts("2020-08-25 11:00:00")),
                                (2, "S", ts("2020-08-01 00:00:00"), ts("2020-09-03 00:00:00")),
                                (3, "T", ts("2020-08-25 10:00:00"), ts("2020-08-25 11:00:00"))],
                               "oid int, site string, s timestamp_ntz, e timestamp_ntz")
    pts = spark.createDataFrame([("S", ts("2020-08-25 10:00:00"), 5.0), ("S", ts("2020-08-25 11:00:00"), 7.0),
                                 ("S", ts("2020-08-25 11:00:01"), 99.0), ("S", ts("2020-08-25 09:31:00"), 50.0),
                                 ("S", ts("2020-09-02 23:00:00"), 3.0), ("S", ts("2020-08-25 10:30:00"), None)],
                                "site string, t timestamp_ntz, v double")
    out = {r.oid: r.g for r in jn.interval_max(iv, pts, ["oid", "site", "s", "e"], "site", "s", "e", "t", "v",
                                               "g").collect()}
    assert out == {1: 7.0, 2: 99.0}
    wide = {r.oid: r.g for r in jn.interval_max(iv, pts, ["oid", "site", "s", "e"], "site", "s", "e", "t", "v",
                                                "g", margin_seconds=1800).collect()}
    assert wide[1] == 99.0


def test_geo_join_100m(spark):
    """0.1 km radius: a ticket 99 m from a site matches, one 101 m away does not."""
    from outagelens.functions.mathx import EARTH_RADIUS_KM
    import math
    deg = 1.0 / (math.pi / 180 * EARTH_RADIUS_KM)  # degrees of latitude per km on the sphere
    sites = spark.createDataFrame([("A", 14.6, -90.5), ("B", 14.6 + 0.5 * deg, -90.5)], "siteid string, lat double, "
                                                                                        "lon double")
    tk = spark.createDataFrame([(1, 14.6 + 0.099 * deg, -90.5), (2, 14.6 - 0.101 * deg, -90.5),
                                (3, 14.6 + 0.25 * deg, -90.5)], "tid int, lat double, lon double")
    out = jn.geo_left_join(tk, sites, 0.1)
    got = sorted((r.tid, r.siteid) for r in out.collect())
    assert got == [(1, "A"), (2, None), (3, None)]


def test_knn_vote_inverse_distance(spark):
    from outagelens.operators.neighbors import knn_vote
    train = spark.createDataFrame([(1, 0.0, "down"), (2, 1.0, "down"), (3, 10.0, "up"), (4, 11.0, "up"),
                                   (5, 12.0, "up")], "id long, x double, y string")
    test = spark.createDataFrame([(10, 0.5, "down"), (11, 11.5, "up")], "id long, x double, y string")
    p = {r.id: r.prob for r in knn_vote(train, test, "id", "y", ["x"], 3, "down").collect()}
    # test 10: neighbours 1 (0.5), 2 (0.5), 3 (9.5) -> weights 2, 2, 1/9.5
    assert p[10] == __import__("pytest").approx(4 / (4 + 1 / 9.5))
    assert p[11] == 0.0


def test_repeated_outages_gua025(spark):
    """Q17: several outages of one site in one day are reported with their
    count; a single outage on another day is not."""
    rows = [(i, "GUA025", ts(f"2020-08-25 {h:02d}:10:00")) for i, h in enumerate([1, 3, 4, 8, 9, 12, 15, 18, 22])]
    rows += [(20, "GUA025", ts("2020-08-26 10:00:00")), (21, "GUA030", ts("2020-08-25 10:00:00"))]
    df = spark.createDataFrame(rows, "outage_id int, siteid string, inicio timestamp_ntz") \
        .withColumn("dia", F.to_date("inicio"))
    out = fr.dupes(df, ["siteid", "dia"]).collect()
    assert len(out) == 9 and {r.dupe_count for r in out} == {9} and {r.siteid for r in out} == {"GUA025"}


def test_degenerate_groups_give_null_not_errors(spark):
    """ANSI mode: single-class groups, constant columns and n = 2 give NULL
    statistics instead of division-by-zero errors."""
    from outagelens.operators import metrics as mt
    from outagelens.operators import stats as stx
    from outagelens.operators.recipes import Normalize, Recipe
    p = spark.createDataFrame([("m", "up", 0.2), ("m", "up", 0.7)], "model string, truth string, prob double")
    assert mt.roc_curve(p, ["model"], "down").count() == 4
    assert mt.pr_curve(p, ["model"], "down").count() == 3
    assert mt.roc_auc(p, ["model"], "down").first().roc_auc is None
    c = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0)], "x double, y double")
    assert stx.least_squares(c, [("y", "x")]).first().se_slope is None
    lv = stx.long_values(c, ["x"])
    assert stx.jarque_bera(lv, ["variable"]).first().statistic is None
    assert Recipe([Normalize(["x"])]).fit(c).transform(c).first().x is None
    one = spark.createDataFrame([("a", "p"), ("a", "q")], "a string, b string")
    assert stx.chi_square(one, "a", "b").first().cramers_v is None


def test_interval_ending_before_start_matches_nothing(spark):
    iv = spark.createDataFrame([(1, "S", ts("2020-08-25 11:00:00"), ts("2020-08-25 10:00:00"))],
                               "oid int, site string, s timestamp_ntz, e timestamp_ntz")
    pts = spark.createDataFrame([("S", ts("2020-08-25 10:30:00"), 5.0)], "site string, t timestamp_ntz, v double")
    assert jn.interval_max(iv, pts, ["oid", "site", "s", "e"], "site", "s", "e", "t", "v", "g").count() == 0


def test_interval_join_day_bucket_mode_agrees(spark):
    iv = spark.createDataFrame([(1, "S", ts("2020-08-25 10:00:00"), ts("2020-08-25 11:00:00")),
                                (2, "S", ts("2020-08-01 00:00:00"), ts("2020-09-03 00:00:00"))],
                               "oid int, site string, s timestamp_ntz, e timestamp_ntz")
    pts = spark.createDataFrame([("S", ts("2020-08-25 10:00:00"), 5.0), ("S", ts("2020-08-25 11:00:01"), 99.0),
                                 ("S", ts("2020-09-02 23:00:00"), 3.0)], "site string, t timestamp_ntz, v double")
    a = jn.interval_matches(iv, pts, "site", "s", "e", "t").select("oid", "v").collect()
    b = jn.interval_matches(iv, pts, "site", "s", "e", "t", long_after_seconds=48 * 3600).select("oid", "v").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) == [(1, 5.0), (2, 3.0), (2, 5.0), (2, 99.0)]
