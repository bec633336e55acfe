"""Exploratory statistics queries on the outage features
(sin_energia, mg_trabajando by status) and on lineitem measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import rnd
from ..operators import fits
from ..operators import stats as stx
from ..sources.tables import Tables
from . import sqlparts as sq
from .etl_outages import OUTAGE_FEATURES_SQL, outage_features
from .registry import register

VARS = ["sin_energia", "mg_trabajando"]
LONG_SQL = (f"WITH f AS ({OUTAGE_FEATURES_SQL}), lv AS (SELECT status, variable, value FROM "
            "(SELECT status, sin_energia, mg_trabajando FROM f) UNPIVOT INCLUDE NULLS (value FOR variable IN "
            "(sin_energia, mg_trabajando))) ")


def _long(t: Tables) -> DataFrame:
    return stx.long_values(outage_features(t), VARS, by=["status"])


@register("e01_tukey_trim", ids=("E1", "M6"),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), q AS (SELECT quantile_cont(sin_energia, 0.25) AS q1, "
              "quantile_cont(sin_energia, 0.75) AS q3 FROM f) SELECT outage_id, sin_energia FROM f, q "
              "WHERE sin_energia > q1 - 1.5 * (q3 - q1) AND sin_energia < q3 + 1.5 * (q3 - q1)")
def e01(t: Tables) -> DataFrame:
    return stx.tukey_trim(outage_features(t).select("outage_id", "sin_energia"), "sin_energia")


@register("e02_box_stats", ids=("E2", "U5"),
          sql=LONG_SQL + ", q AS (SELECT status, variable, quantile_cont(value, 0.25) AS q1, "
              "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM lv WHERE value IS NOT NULL "
              "GROUP BY 1, 2), fq AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q) "
              "SELECT fq.status, fq.variable, " + sq.rnd("q1") + " AS q1, " + sq.rnd("median") + " AS median, "
              + sq.rnd("q3") + " AS q3, " + sq.rnd("lower") + " AS lower, " + sq.rnd("upper") + " AS upper, "
              + sq.rnd("min(CASE WHEN value BETWEEN lower AND upper THEN value END)") + " AS whisker_low, "
              + sq.rnd("max(CASE WHEN value BETWEEN lower AND upper THEN value END)") + " AS whisker_high, "
              "sum(CASE WHEN value BETWEEN lower AND upper THEN 0 ELSE 1 END) AS n_outliers, count(*) AS n "
              "FROM lv JOIN fq ON lv.status IS NOT DISTINCT FROM fq.status AND lv.variable = fq.variable "
              "WHERE value IS NOT NULL GROUP BY fq.status, fq.variable, q1, median, q3, lower, upper")
def e02(t: Tables) -> DataFrame:
    b = stx.box_stats(_long(t), ["status"])
    return b.select("status", "variable", *[rnd(c).alias(c) for c in
                                            ("q1", "median", "q3", "lower", "upper", "whisker_low", "whisker_high")],
                    "n_outliers", "n")


@register("e03_histogram_log10", ids=("E3", "M2"),
          sql="WITH d AS (SELECT log10(l_extendedprice) AS x FROM lineitem WHERE l_extendedprice > 0), "
              "r AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS N FROM d), "
              "b AS (SELECT CAST(CASE WHEN (hi - lo) / 30 > 0 THEN least(floor((x - lo) / ((hi - lo) / 30)), 29) "
              "ELSE 0 END AS BIGINT) AS bin, lo, hi, N FROM d, r) SELECT bin, " + sq.rnd("lo + bin * (hi - lo) / 30", 9)
              + " AS xmin, " + sq.rnd("lo + (bin + 1) * (hi - lo) / 30", 9) + " AS xmax, count(*) AS n, "
              + sq.rnd("count(*) / (N * ((hi - lo) / 30))", 9) + " AS density FROM b GROUP BY bin, lo, hi, N")
def e03(t: Tables) -> DataFrame:
    h = stx.histogram(t.lineitem, "l_extendedprice", bins=30, log10=True)
    return h.select("bin", rnd("xmin", 9).alias("xmin"), rnd("xmax", 9).alias("xmax"), "n",
                    rnd("density", 9).alias("density"))


_PRETTY_SQL = (
    "WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n "
    "FROM lineitem), c AS (SELECT lo, hi, (hi - lo) / (ceil(log2(n)) + 1) AS cell FROM s), "
    "b AS (SELECT lo, hi, cell, power(10.0, floor(log10(cell))) AS base FROM c), "
    "u AS (SELECT lo, hi, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN "
    "CASE WHEN 5 * base - cell < 2.75 * (cell - 2 * base) THEN "
    "CASE WHEN 10 * base - cell < 1.5 * (cell - 5 * base) THEN 10 * base ELSE 5 * base END "
    "ELSE 2 * base END ELSE base END AS unit FROM b), "
    "e AS (SELECT lo, hi, unit, floor(lo / unit + 1e-7) AS ns0, ceil(hi / unit - 1e-7) AS nu0 FROM u), "
    "p AS (SELECT unit, CASE WHEN ns0 * unit > lo + 1e-10 * unit THEN ns0 - 1 ELSE ns0 END AS ns, "
    "CASE WHEN nu0 * unit < hi - 1e-10 * unit THEN nu0 + 1 ELSE nu0 END AS nu FROM e) ")


@register("e04_sturges_histogram", ids=("E4",),
          sql=_PRETTY_SQL + ", h AS (SELECT CAST(least(greatest(ceil(l_extendedprice / unit - ns) - 1, 0), "
              "nu - ns - 1) AS BIGINT) AS bin, ns, unit FROM lineitem, p WHERE l_extendedprice IS NOT NULL) "
              "SELECT bin, (bin + ns) * unit AS lower, (bin + ns + 1) * unit AS upper, count(*) AS n FROM h "
              "GROUP BY bin, ns, unit")
def e04(t: Tables) -> DataFrame:
    return stx.sturges_histogram(t.lineitem, "l_extendedprice")


@register("e05_kernel_density", ids=("E5",),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), x AS (SELECT CAST(sin_energia AS DOUBLE) AS x FROM f "
              "WHERE sin_energia IS NOT NULL), st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, "
              "max(x) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM x), "
              "bw AS (SELECT *, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) "
              "ELSE coalesce(CASE WHEN sd > 0 THEN sd END, 1.0) END * power(n, -0.2) AS bw FROM st), "
              "g AS (SELECT *, mn - 3.0 * bw AS lo, (mx + 3.0 * bw - (mn - 3.0 * bw)) / 511 AS step FROM bw), "
              "pos AS (SELECT (x - lo) / step AS u FROM x, g), "
              "cells AS (SELECT i, sum(w) AS w FROM (SELECT floor(u) AS i, 1 - (u - floor(u)) AS w FROM pos UNION ALL "
              "SELECT floor(u) + 1, u - floor(u) FROM pos) GROUP BY i), "
              "sp AS (SELECT i, w, unnest(range(0, 512)) AS j FROM cells) "
              "SELECT j AS point, " + sq.rnd("min(lo) + j * min(step)", 8) + " AS x, "
              + sq.rnd("sum(w * exp(-0.5 * ((j - i) * step / bw) * ((j - i) * step / bw)) / "
                       f"({math.sqrt(2 * math.pi)!r} * bw * n))", 8) + " AS density FROM sp, g GROUP BY j")
def e05(t: Tables) -> DataFrame:
    d = fits.kernel_density(outage_features(t), "sin_energia")
    return d.select(F.col("point").cast("long").alias("point"), rnd("x", 8).alias("x"),
                    rnd("density", 8).alias("density"))


@register("e06_mean_median", ids=("E6", "M6"),
          sql=LONG_SQL + "SELECT status, variable, " + sq.rnd("avg(value)") + " AS mean, "
              + sq.rnd("median(value)") + " AS median FROM lv GROUP BY 1, 2 UNION ALL SELECT 'pooled', variable, "
              + sq.rnd("avg(value)") + ", " + sq.rnd("median(value)") + " FROM lv GROUP BY 2")
def e06(t: Tables) -> DataFrame:
    lv = _long(t)
    by = stx.mean_median(lv, ["status"])
    pooled = stx.mean_median(lv, []).withColumn("status", F.lit("pooled"))
    out = by.unionByName(pooled)
    return out.select("status", "variable", rnd("mean").alias("mean"), rnd("median").alias("median"))


_LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("e07_correlation_matrix", ids=("E7", "M1"),
          sql=" UNION ALL ".join(
              f"SELECT '{a}' AS var1, '{b}' AS var2, " + sq.rnd(f"corr(ln({a} + 2), ln({b} + 2))", 9)
              + " AS corr FROM lineitem" for i, a in enumerate(_LCOLS) for b in _LCOLS[i + 1:]))
def e07(t: Tables) -> DataFrame:
    c = stx.corr_matrix(t.lineitem, _LCOLS, shift=2.0)
    return c.select("var1", "var2", rnd("corr", 9).alias("corr"))


_PAIRS = [("l_extendedprice", "l_quantity"), ("l_tax", "l_discount")]


@register("e08_least_squares_lines", ids=("E8",),
          sql=" UNION ALL ".join(
              f"SELECT '{y}' AS y, '{x}' AS x, CAST(regr_count({y}, {x}) AS BIGINT) AS n, " + sq.rnd(f"regr_slope({y}, {x})", 9)
              + " AS slope, " + sq.rnd(f"regr_intercept({y}, {x})", 6) + " AS intercept, "
              + sq.rnd(f"sqrt(greatest(regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x}), 0) / "
                       f"(regr_count({y}, {x}) - 2))", 6) + " AS sigma, "
              + sq.rnd(f"sqrt(greatest(regr_syy({y}, {x}) - regr_slope({y}, {x}) * regr_sxy({y}, {x}), 0) / "
                       f"(regr_count({y}, {x}) - 2)) / sqrt(regr_sxx({y}, {x}))", 9) + " AS se_slope, "
              + sq.rnd(f"regr_r2({y}, {x})", 9) + " AS r2 FROM lineitem" for y, x in _PAIRS))
def e08(t: Tables) -> DataFrame:
    ls = stx.least_squares(t.lineitem, _PAIRS)
    return ls.select("y", "x", "n", rnd("slope", 9).alias("slope"), rnd("intercept", 6).alias("intercept"),
                     rnd("sigma", 6).alias("sigma"), rnd("se_slope", 9).alias("se_slope"), rnd("r2", 9).alias("r2"))


@register("e09_grouped_bar_counts", ids=("E9", "T5", "D5"),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), g AS (SELECT mes, arranco_mg, status, count(*) AS n FROM f "
              "GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY n DESC, mes, arranco_mg, status NULLS FIRST) "
              "AS orden FROM g")
def e09(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    g = outage_features(t).groupBy("mes", "arranco_mg", "status").agg(F.count(F.lit(1)).alias("n"))
    # ordering of the aggregated bars (a small table)
    w = Window.orderBy(F.col("n").desc(), "mes", "arranco_mg", F.col("status").asc_nulls_first())
    return g.withColumn("orden", F.row_number().over(w).cast("long"))


@register("e10_chi_square", ids=("E10",),
          sql="WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), "
              "ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), "
              "t AS (SELECT sum(o) AS tot FROM c), e AS (SELECT o, ra * cb / tot AS e, tot FROM c JOIN ra USING (a) "
              "JOIN cb USING (b), t), s AS (SELECT sum((o - e) * (o - e) / e) + (max(tot) - sum(e)) AS statistic, "
              "max(tot) AS tot FROM e) SELECT " + sq.rnd("statistic", 6) + " AS statistic, "
              "CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS BIGINT) AS df, "
              + sq.rnd("sqrt(statistic / (tot * (least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1)))", 9)
              + " AS cramers_v FROM s")
def e10(t: Tables) -> DataFrame:
    c = stx.chi_square(t.orders, "o_orderstatus", "o_orderpriority")
    return c.select(rnd("statistic", 6).alias("statistic"), "df", rnd("cramers_v", 9).alias("cramers_v"))


_CHI_SQL = ("WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), "
            "ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b), "
            "t AS (SELECT sum(o) AS tot FROM c), e AS (SELECT o, ra * cb / tot AS e, tot FROM c JOIN ra USING (a) "
            "JOIN cb USING (b), t), s AS (SELECT sum((o - e) * (o - e) / e) + (max(tot) - sum(e)) AS statistic, "
            "max(tot) AS tot, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS df FROM e) ")


@register("e10b_chi_square_pvalue", ids=("E10",),
          sql=_CHI_SQL + "SELECT CAST(df AS BIGINT) AS df, " + sq.rnd("statistic", 6) + " AS statistic, "
              + sq.rnd("exp(-statistic / 2) * list_sum(list_transform(range(CAST(df / 2 AS BIGINT)), "
                       "lambda i: pow(statistic / 2, i) / gamma(i + 1)))", 9)
              + " AS p_value FROM s WHERE df % 2 = 0")
def e10b(t: Tables) -> DataFrame:
    """p-value of the same test from MLlib's ChiSquareTest (levels indexed)."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import ChiSquareTest
    o = t.orders
    idx = StringIndexer(inputCols=["o_orderstatus", "o_orderpriority"], outputCols=["a", "b"]).fit(o).transform(o)
    v = VectorAssembler(inputCols=["a"], outputCol="features").transform(idx)
    r = ChiSquareTest.test(v, "features", "b")
    # (the oracle uses the closed-form survival function for even df)
    return r.select(F.col("degreesOfFreedom")[0].cast("long").alias("df"),
                    rnd(vector_to_array("statistics")[0], 6).alias("statistic"),
                    rnd(vector_to_array("pValues")[0], 9).alias("p_value"))


@register("e11_near_zero_var", ids=("E11", "R4"),
          sql="WITH lv AS (SELECT variable, value FROM (SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
              "CAST(l_discount AS VARCHAR) AS l_discount, l_returnflag, CAST(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END "
              "AS VARCHAR) AS rare FROM lineitem) UNPIVOT (value FOR variable IN (l_linenumber, l_discount, "
              "l_returnflag, rare))), vc AS (SELECT variable, value, count(*) AS cnt FROM lv GROUP BY 1, 2), "
              "top AS (SELECT variable, max(cnt) AS top1, count(*) AS nd, sum(cnt) AS n FROM vc GROUP BY 1), "
              "g AS (SELECT vc.variable, top1, nd, n, sum(CASE WHEN cnt = top1 THEN 1 ELSE 0 END) AS nat, "
              "max(CASE WHEN cnt < top1 THEN cnt END) AS second FROM vc JOIN top USING (variable) GROUP BY 1, 2, 3, 4), "
              "m AS (SELECT variable, CASE WHEN nd = 1 THEN 0.0 ELSE top1 / (CASE WHEN nat >= 2 THEN top1 ELSE second "
              "END) END AS freq_ratio, 100.0 * nd / n AS percent_unique, nd = 1 AS zero_var FROM g) "
              "SELECT variable, " + sq.rnd("freq_ratio", 9) + " AS freq_ratio, " + sq.rnd("percent_unique", 9)
              + " AS percent_unique, zero_var, zero_var OR (freq_ratio > 19.0 AND percent_unique <= 10.0) AS nzv FROM m")
def e11(t: Tables) -> DataFrame:
    l = t.lineitem.select("l_linenumber", "l_discount", "l_returnflag",
                          F.when(F.col("l_quantity") > 49, 1).otherwise(0).alias("rare"))
    n = stx.near_zero_var(l, ["l_linenumber", "l_discount", "l_returnflag", "rare"])
    return n.select("variable", rnd("freq_ratio", 9).alias("freq_ratio"),
                    rnd("percent_unique", 9).alias("percent_unique"), "zero_var", "nzv")


@register("e12_jarque_bera", ids=("E12",),
          sql=LONG_SQL + ", m AS (SELECT status, variable, avg(value) AS mean, count(value) AS n FROM lv GROUP BY 1, 2), "
              "d AS (SELECT lv.status, lv.variable, n, value - mean AS d FROM lv JOIN m ON lv.status IS NOT DISTINCT "
              "FROM m.status AND lv.variable = m.variable), mo AS (SELECT status, variable, n, avg(d * d) AS m2, "
              "avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM d GROUP BY 1, 2, 3), "
              "jb AS (SELECT status, variable, n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) "
              "/ 4.0) AS statistic FROM mo) SELECT status, variable, 'Jarque-Bera' AS method, "
              + sq.rnd("statistic", 6) + " AS statistic, " + sq.rnd("exp(-statistic / 2)", 9) + " AS p_value FROM jb")
def e12(t: Tables) -> DataFrame:
    j = stx.jarque_bera(_long(t), ["status", "variable"])
    return j.select("status", "variable", "method", rnd("statistic", 6).alias("statistic"),
                    rnd("p_value", 9).alias("p_value"))


@register("e12b_ks_normality", ids=("E12",),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), x AS (SELECT CAST(sin_energia AS DOUBLE) AS x FROM f WHERE sin_energia IS NOT NULL), "
              "st AS (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM x), "
              "d AS (SELECT any_value(n) AS n, max(greatest(i / n - c, c - (i - 1) / n)) AS d FROM (SELECT row_number() OVER (ORDER BY x) AS i, "
              "n, " + stx.pnorm_sql("((x - m) / s)") + " AS c FROM x, st)) "
              "SELECT 'Kolmogorov-Smirnov' AS method, " + sq.rnd("d", 9) + " AS statistic, "
              + sq.rnd(fits.kolmogorov_p_sql("sqrt(n) * d"), 9) + " AS p_value FROM d")
def e12b(t: Tables) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance to the fitted normal."""
    k = fits.ks_normality(outage_features(t), "sin_energia")
    return k.select("method", rnd("statistic", 9).alias("statistic"), rnd("p_value", 9).alias("p_value"))


@register("e13_qq_points", ids=("E13",),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), x AS (SELECT sin_energia AS sample FROM f WHERE sin_energia IS NOT NULL), "
              "st AS (SELECT count(*) AS n, avg(sample) AS m, stddev_samp(sample) AS s FROM x), "
              "r AS (SELECT row_number() OVER (ORDER BY sample) AS i, sample FROM x), "
              "p AS (SELECT i, sample, (i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / "
              "(n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) AS p, n, m, s FROM r, st), "
              f"q AS (SELECT *, {stx.qnorm_sql('p')} AS theoretical FROM p) "
              "SELECT i, sample, " + sq.rnd("p", 9) + " AS p, " + sq.rnd("theoretical", 6) + " AS theoretical, "
              + sq.rnd("m + s * theoretical", 6) + " AS fitted FROM q")
def e13(t: Tables) -> DataFrame:
    q = stx.qq_points(outage_features(t), "sin_energia")
    return q.select("i", "sample", rnd("p", 9).alias("p"), rnd("theoretical", 6).alias("theoretical"),
                    rnd("fitted", 6).alias("fitted"))


@register("e14_goodness_of_fit", ids=("E14",),
          sql=f"WITH RECURSIVE f AS ({OUTAGE_FEATURES_SQL}), x AS (SELECT CAST(sin_energia AS DOUBLE) AS x FROM f "
              "WHERE sin_energia IS NOT NULL), st AS (SELECT count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, "
              "min(x) AS lo, max(x) AS hi, avg(ln(x)) AS lm, stddev_samp(ln(x)) AS ls FROM x), "
              + fits.gamma_sql("x", "x") + ", r AS (SELECT row_number() OVER (ORDER BY x) AS i, x FROM x), "
              "c AS (SELECT i, n, unnest(['norm', 'lnorm', 'gamma', 'unif']) AS distribution, unnest(["
              + stx.pnorm_sql("((r.x - m) / s)") + ", " + stx.pnorm_sql("((ln(r.x) - lm) / ls)")
              + ", gc.cdf, (r.x - lo) / (hi - lo)]) AS cdf FROM r JOIN gc ON gc.x = r.x, st), "
              "d AS (SELECT distribution, any_value(n) AS n, max(greatest(i / n - cdf, cdf - (i - 1) / n)) AS d FROM c GROUP BY 1) "
              "SELECT distribution, " + sq.rnd("d", 6) + " AS ks_distance, " + sq.rnd(fits.kolmogorov_p_sql("sqrt(n) * d"), 6)
              + " AS score, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS rank FROM d")
def e14(t: Tables) -> DataFrame:
    g = fits.goodness_of_fit(outage_features(t), "sin_energia")
    return g.select("distribution", rnd("ks_distance", 6).alias("ks_distance"), rnd("score", 6).alias("score"), "rank")


BREAKS = [0.0, 1000.0, 5000.0, 20000.0, 50000.0, 100000.0]


@register("e03b_histogram_fixed_breaks", ids=("E3",),
          sql="WITH b AS (SELECT CASE " + " ".join(
              f"WHEN l_extendedprice {'>=' if i == 0 else '>'} {BREAKS[i]} AND l_extendedprice <= {BREAKS[i + 1]} "
              f"THEN {i}" for i in range(len(BREAKS) - 1)) + " END AS bin FROM lineitem) "
              "SELECT CAST(bin AS BIGINT) AS bin, (" + str(BREAKS) + ")[bin + 1] AS lower, (" + str(BREAKS)
              + ")[bin + 2] AS upper, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin")
def e03b(t: Tables) -> DataFrame:
    return stx.fixed_breaks_histogram(t.lineitem, "l_extendedprice", BREAKS)


@register("e02b_outlier_rows", ids=("E2",),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), lv AS (SELECT outage_id, status, variable, value FROM "
              "(SELECT outage_id, status, sin_energia, mg_trabajando FROM f) UNPIVOT (value FOR variable IN "
              "(sin_energia, mg_trabajando))), q AS (SELECT status, variable, quantile_cont(value, 0.25) AS q1, "
              "quantile_cont(value, 0.75) AS q3 FROM lv GROUP BY 1, 2) "
              "SELECT lv.outage_id, lv.status, lv.variable, lv.value FROM lv JOIN q ON lv.status IS NOT DISTINCT FROM "
              "q.status AND lv.variable = q.variable WHERE lv.value < q1 - 1.5 * (q3 - q1) "
              "OR lv.value > q3 + 1.5 * (q3 - q1)")
def e02b(t: Tables) -> DataFrame:
    lv = stx.long_values(outage_features(t), VARS, by=["outage_id", "status"])
    return stx.outlier_rows(lv, ["status"]).select("outage_id", "status", "variable", "value")
