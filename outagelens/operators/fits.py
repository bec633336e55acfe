"""Fitted distributions and kernel density: E5, E12 (Kolmogorov-Smirnov), E14.

All statistics of a column come from one aggregate row; sorted positions come
from the distributed row ids, and every distance from one pass over them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import row_ids
from .quantiles import quantile_columns
from .stats import pnorm_sql

TERMS = 100   # of the Kolmogorov series
STEPS = 300   # of the incomplete gamma function


# ------------------------------------------------------------------ E12 ---


def kolmogorov_p(distance: Column, n: Column) -> Column:
    """P(D >= distance) by Kolmogorov's limit: 2 sum (-1)^(k-1) exp(-2 k^2 z^2),
    z = sqrt(n) D, or for small z, where that sum converges slowly, one minus
    sqrt(2 pi) / z sum exp(-(2k-1)^2 pi^2 / (8 z^2))."""
    z = F.sqrt(n.cast("double")) * distance
    ks = F.sequence(F.lit(1), F.lit(TERMS))
    total = lambda term: F.aggregate(F.transform(ks, term), F.lit(0.0), lambda a, v: a + v)
    sign = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    large = 2 * total(lambda k: sign(k) * F.exp(-2.0 * k * k * z * z))
    small = 1 - F.lit(math.sqrt(2 * math.pi)) / z * total(lambda k: F.exp(-(2 * k - 1) * (2 * k - 1) * (math.pi ** 2 / 8) / (z * z)))
    return F.when(z <= 0, 1.0).when(z < 1, small).otherwise(F.least(F.greatest(large, F.lit(0.0)), F.lit(1.0)))


def kolmogorov_p_sql(z: str) -> str:
    """The same limit as SQL text, by the alternating sum alone (enough terms for z above 0.05)."""
    return (f"least(greatest(2 * list_sum(list_transform(range(1, 400), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * "
            f"exp(-2.0 * k * k * ({z}) * ({z})))), 0.0), 1.0)")


def _gap(cdf: Column, n: int) -> Column:
    """Largest gap between the step function of the sample and a distribution function."""
    return F.max(F.greatest(F.col("i") / n - cdf, cdf - (F.col("i") - 1) / n))


def ks_normality(df: DataFrame, value: str) -> DataFrame:
    """One row (method, statistic, p_value): the exact distance between the
    sample and the normal distribution of its mean and standard deviation,
    and Kolmogorov's limit of its probability.  No row without two values."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    st = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    if not st["s"]:
        return df.sparkSession.createDataFrame([], "method string, statistic double, p_value double")
    r = row_ids(x, ["x"], "i").withColumn("_z", (F.col("x") - st["m"]) / st["s"])
    d = r.agg(_gap(F.expr(pnorm_sql("_z")), st["n"]).alias("statistic"))
    return d.select(F.lit("Kolmogorov-Smirnov").alias("method"), "statistic",
                    kolmogorov_p(F.col("statistic"), F.lit(st["n"])).alias("p_value"))


# ------------------------------------------------------------------ E14 ---


def digamma(x: float, order: int = 0) -> float:
    """Digamma (order 0) or trigamma (1) of a positive number: shifted up by recurrence, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out += -1 / x if order == 0 else 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    if order == 0:
        return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_shape(mean: float, mean_log: float) -> float | None:
    """Maximum-likelihood shape: log a - digamma(a) = log mean - mean log, by Newton steps on 1 / a."""
    s = math.log(mean) - mean_log
    if not s > 1e-12:  # a constant column has no gamma fit
        return None
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        f = math.log(a) - digamma(a) - s
        step = f / (a * a * (1 / a - digamma(a, 1)))
        new = 1 / (1 / a + step)
        if abs(new - a) <= 1e-14 * a:
            return new
        a = new
    return a


def gamma_cdf(x: Column, shape: float, scale: float) -> Column:
    """Regularised lower incomplete gamma function P(shape, x / scale) as a
    column expression: the power series left of shape + 1, and one minus
    Legendre's continued fraction, evaluated from its end, right of it."""
    z = x / F.lit(scale)
    front = F.exp(shape * F.log(z) - z - F.lit(math.lgamma(shape)))
    term = lambda acc, k: F.struct((acc["t"] * z / (shape + k)).alias("t"), (acc["s"] + acc["t"] * z / (shape + k)).alias("s"))
    start = F.struct(F.lit(1 / shape).alias("t"), F.lit(1 / shape).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, term, lambda acc: acc["s"])
    # b_k = z + 2k + 1 - shape, a_k = k (k - shape)
    tail = F.aggregate(F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1)), z + (2 * STEPS + 3 - shape),
                       lambda acc, k: z + (2.0 * k - 1 - shape) - k * (k - shape) / acc)
    return F.when(x <= 0, 0.0).when(z < shape + 1, front * series).otherwise(1 - front / tail)


def goodness_of_fit(df: DataFrame, value: str) -> DataFrame:
    """Normal, log-normal, gamma (maximum likelihood) and uniform fits of a
    column: rows (distribution, ks_distance, score, rank), the score being
    Kolmogorov's probability of the distance.  Log-normal and gamma need
    positive values; fits that a constant column does not have are left out."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    log = F.when(F.col("x") > 0, F.log("x"))
    st = x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"),
               F.max("x").alias("hi"), F.avg(log).alias("lm"), F.stddev_samp(log).alias("ls")).first()
    cdfs: dict[str, Column] = {}
    if st["n"]:
        if st["s"]:
            cdfs["norm"] = F.expr(pnorm_sql(f"((x - ({st['m']!r})) / {st['s']!r})"))
        if st["lo"] > 0 and st["ls"]:
            cdfs["lnorm"] = F.expr(pnorm_sql(f"((ln(x) - ({st['lm']!r})) / {st['ls']!r})"))
        shape = gamma_shape(st["m"], st["lm"]) if st["lo"] > 0 else None
        if shape:
            cdfs["gamma"] = gamma_cdf(F.col("x"), shape, st["m"] / shape)
        if st["hi"] > st["lo"]:
            cdfs["unif"] = (F.col("x") - st["lo"]) / (st["hi"] - st["lo"])
    if not cdfs:
        return df.sparkSession.createDataFrame([], "distribution string, ks_distance double, score double, rank int")
    one = row_ids(x, ["x"], "i").agg(*[_gap(c, st["n"]).alias(name) for name, c in cdfs.items()])
    rows = one.select(F.explode(F.array_sort(F.array(*[F.struct(F.col(c).alias("ks_distance"), F.lit(c).alias("distribution"))
                                                       for c in cdfs]))).alias("r"), F.array_sort(F.array(*cdfs)).alias("_all"))
    return rows.select("r.distribution", "r.ks_distance", kolmogorov_p(F.col("r.ks_distance"), F.lit(st["n"])).alias("score"),
                       F.array_position("_all", F.col("r.ks_distance")).cast("int").alias("rank"))


def gamma_sql(sample: str, x: str) -> str:
    """The gamma fit by other formulas, as table expressions over ``sample``: the shape by
    bisection on the derivative of lgamma, ``gc`` (x, cdf) by the power series for every value."""
    slope = "(lgamma(a * 1.0001) - lgamma(a * 0.9999)) / (a * 0.0002)"
    return (f"gs AS (SELECT avg({x}) AS gm, ln(avg({x})) - avg(ln({x})) AS s FROM {sample}), "
            "gb AS (SELECT 0 AS step, CAST(1e-3 AS DOUBLE) AS lo, CAST(1e3 AS DOUBLE) AS hi UNION ALL "
            f"SELECT step + 1, CASE WHEN g > s THEN a ELSE lo END, CASE WHEN g > s THEN hi ELSE a END FROM (SELECT step, lo, hi, a, "
            f"ln(a) - {slope} AS g, (SELECT s FROM gs) AS s FROM (SELECT step, lo, hi, (lo + hi) / 2 AS a FROM gb)) WHERE step < 60), "
            "ga AS (SELECT (lo + hi) / 2 AS a, gm / ((lo + hi) / 2) AS b FROM gb, gs WHERE step = 60), "
            f"gc AS (SELECT DISTINCT {x} AS x, least(list_sum(list_transform(range(0, 600), lambda k: exp((a + k) * ln({x} / b) - {x} / b "
            f"- lgamma(a + k + 1)))), 1.0) AS cdf FROM {sample}, ga)")


# ------------------------------------------------------------------- E5 ---


def kernel_density(df: DataFrame, value: str, n_grid: int = 512, cut: float = 3.0) -> DataFrame:
    """E5 Gaussian density on a grid with the nrd0 bandwidth, always ``n_grid``
    rows (point, x, density).

    Linear binning: every value is split between the two grid points around
    it, in proportion to its distance from each, and the weights are summed
    (an aggregate of at most ``n_grid`` rows, whatever the number of values).
    Every point then takes the kernel of every weight: a full convolution
    without a cut."""
    x = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    q = quantile_columns(x, "x", {"q1": 0.25, "q3": 0.75}).first()  # two numbers
    st = x.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("mn"), F.max("x").alias("mx")).first()
    n, sd = st["n"], st["sd"]
    if not n:
        return df.sparkSession.createDataFrame([], "point long, x double, density double")
    spread = (q["q3"] - q["q1"]) / 1.34
    low = spread if sd is None else min(sd, spread)
    bw = 0.9 * (low if low > 0 else (sd if sd else 1.0)) * n ** -0.2
    lo = st["mn"] - cut * bw
    step = (st["mx"] + cut * bw - lo) / (n_grid - 1)
    at = (F.col("x") - lo) / step
    halves = F.array(F.struct(F.floor(at).alias("i"), (1 - (at - F.floor(at))).alias("w")),
                     F.struct((F.floor(at) + 1).alias("i"), (at - F.floor(at)).alias("w")))
    cells = x.select(F.explode(halves).alias("h")).groupBy("h.i").agg(F.sum("h.w").alias("w"))
    points = cells.select("w", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_grid - 1).cast("long"))).alias("j"))
    z = (F.col("j") - F.col("i")) * F.lit(step) / F.lit(bw)
    dens = points.groupBy("j").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
    return dens.select(F.col("j").alias("point"), (F.lit(lo) + F.col("j") * F.lit(step)).alias("x"),
                       (F.col("s") / (math.sqrt(2 * math.pi) * bw * n)).alias("density"))
