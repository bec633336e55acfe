"""Exploratory statistics behind each plot and test.

Everything is aggregation: quantiles through the exact sort-based
``exact_quantiles``, moments and correlations as single ``agg`` passes.
Closed-form approximations (normal CDF / quantile) are written once as SQL
text so the same expression runs in Spark (``F.expr``) and in the oracle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import join_null_safe
from .quantiles import quantile_columns


def long_values(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., variable, value) with value as double (U5 for statistics)."""
    by = list(by or [])
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, cols, "variable", "value")


# -------------------------------------------------------------- E1, E2 ----


def fences(df: DataFrame, value: str, by: list[str], k: float = 1.5) -> DataFrame:
    q = quantile_columns(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by)
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})


def tukey_trim(df: DataFrame, value: str, by: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """E1 ``trim_t``: rows strictly inside (Q1 - k IQR, Q3 + k IQR)."""
    by = list(by or [])
    f = fences(df, value, by, k).select(*by, "lower", "upper")
    if by:
        j = df.join(f, by)
    else:  # one row of fences: a scalar subquery each
        j = df.withColumns({"lower": f.select("lower").scalar(), "upper": f.select("upper").scalar()})
    return j.filter((F.col(value) > F.col("lower")) & (F.col(value) < F.col("upper"))).drop("lower", "upper")


def box_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """Five numbers, whisker ends and outlier count per (by..., variable)."""
    keys = by + ["variable"]
    f = fences(long, "value", keys)
    j = join_null_safe(long.filter(F.col("value").isNotNull()), f.select(*keys, "lower", "upper"), keys)
    inside = (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper"))
    w = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return join_null_safe(f, w, keys)


# -------------------------------------------------------------- E3, E4 ----


def histogram(df: DataFrame, value: str, bins: int = 30, log10: bool = True, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (of log10 x for x > 0); the last
    bin is closed; density = n / (N * width)."""
    by = list(by or [])
    x = F.log10(F.col(value)) if log10 else F.col(value).cast("double")
    src = df.filter(F.col(value) > 0) if log10 else df
    d = src.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    rng = d.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count(F.lit(1)).alias("_total"))
    j = join_null_safe(d, rng, by) if by else d.withColumns({c: rng.select(c).scalar() for c in ("lo", "hi", "_total")})
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    h = j.withColumn("bin", b.cast("long")).groupBy(*by, "bin", "lo", "hi", "_total").agg(
        F.count(F.lit(1)).alias("n"))
    w = (F.col("hi") - F.col("lo")) / bins
    return h.select(*by, "bin", (F.col("lo") + F.col("bin") * w).alias("xmin"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("xmax"), "n",
                    F.when(w > 0, F.col("n") / (F.col("_total") * w)).alias("density"))


# Documented rule of round steps: 1, 2, 5 or 10 times a power of ten; a larger unit is
# preferred by this bias, five by another one (the defaults of R's ``pretty``).
_UNITS = (1, 2, 5, 10)
_BIAS = 1.5
_BIAS_OF_FIVE = 0.5 + 1.5 * _BIAS


def round_step(width: float) -> float:
    """The round unit for intervals of about ``width``: the next larger unit is
    taken when the biased distance to the smaller one exceeds its own."""
    power = 10.0 ** math.floor(math.log10(width))
    unit = power
    for small, large in zip(_UNITS, _UNITS[1:]):
        bias = _BIAS_OF_FIVE if large == 5 else _BIAS
        limit = (large + bias * small) / (1 + bias)  # 1.4, 2.8 and 7
        if width > limit * power:
            unit = large * power
    return unit


def pretty_params(lo: float, up: float, ndiv: int, min_n: int | None = None) -> tuple[int, int, float]:
    """Round breaks over [lo, up] in about ``ndiv`` intervals, as (first, last,
    unit): first * unit, ..., last * unit.  At least ``min_n`` intervals (a
    third of ndiv by default, one for a constant)."""
    size = max(abs(lo), abs(up))
    constant = up - lo <= 1e-14 * size * max(1, ndiv)
    if constant:
        width = 1.0 if size == 0 else size if size <= 10 else 9 + size / 10
        least = 1 if min_n is None else min_n
    else:
        width = (up - lo) / max(1, ndiv)
        least = ndiv // 3 if min_n is None else min_n
    unit = round_step(max(width, 1e-300))
    first, last = math.floor(lo / unit + 1e-10), math.ceil(up / unit - 1e-10)
    missing = max(0, least - (last - first))
    larger_half = missing - missing // 2
    # the odd interval goes below a range of positive numbers, above any other
    below, above = (larger_half, missing // 2) if first >= 0 else (missing // 2, larger_half)
    return first - below, last + above, unit


def pretty_breaks(lo: float, up: float, ndiv: int, min_n: int | None = None) -> list[float]:
    """R's ``pretty()`` break values; ``hist`` calls it with min_n = 1."""
    ns, nu, unit = pretty_params(lo, up, ndiv, min_n)
    return [round(i * unit, 12) for i in range(ns, nu + 1)]


def sturges_histogram(df: DataFrame, value: str) -> DataFrame:
    """E4 ``hist(plot=FALSE)``: Sturges class count ceil(log2 n) + 1, pretty
    breaks from (min, max, n) - three numbers on the driver - and counts per
    right-closed interval (first interval closed on the left too)."""
    st = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    k = math.ceil(math.log2(st["n"])) + 1 if st["n"] else 1
    ns, nu, unit = pretty_params(float(st["lo"]), float(st["hi"]), k, min_n=1)
    x = F.col(value).cast("double")
    last = nu - ns - 1
    idx = F.least(F.greatest(F.ceil(x / F.lit(unit) - F.lit(float(ns))) - 1, F.lit(0)), F.lit(last)).cast("long")
    counts = df.filter(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", ((F.col("bin") + ns) * F.lit(unit)).alias("lower"),
                         ((F.col("bin") + ns + 1) * F.lit(unit)).alias("upper"), "n")


# -------------------------------------------------------------- E6-E8 -----


def mean_median(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median per (by..., variable); pass by=[] for the pooled lines."""
    keys = by + ["variable"]
    m = long.groupBy(*keys).agg(F.avg("value").alias("mean"))
    med = quantile_columns(long, "value", {"median": 0.5}, by=keys)
    return join_null_safe(m, med, keys)


def corr_matrix(df: DataFrame, cols: list[str], shift: float | None = 2.0) -> DataFrame:
    """Pearson correlation of every pair (on log(x + shift)) in one pass."""
    tr = (lambda c: F.log(F.col(c) + shift)) if shift is not None else (lambda c: F.col(c))
    d = df.select(*[tr(c).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = d.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                                   F.col(f"{a}__{b}").alias("corr")) for a, b in pairs])).alias("r"))
    return long.select("r.*")


def least_squares(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Y ~ x line per pair: slope, intercept, residual sd, slope std error, r^2."""
    aggs = []
    for y, x in pairs:
        aggs.append(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"),
                             F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
                             F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"),
                             F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
                             F.regr_r2(y, x).alias("r2")).alias(f"{y}__{x}"))
    one = df.agg(*aggs)
    long = one.select(F.explode(F.array(*[F.col(f"{y}__{x}") for y, x in pairs])).alias("r")).select("r.*")
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    sigma = F.sqrt(F.try_divide(F.greatest(sse, F.lit(0.0)), F.col("n") - 2))
    return long.select("y", "x", "n", "slope", "intercept", sigma.alias("sigma"),
                       F.try_divide(sigma, F.sqrt("sxx")).alias("se_slope"), "r2")


# ------------------------------------------------------------- E10, E11 ---


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square statistic of independence, df and Cramer's V.

    Cells never observed have o = 0 and contribute their expected count, so
    the statistic is sum_obs (o - e)^2 / e + (N - sum_obs e): no grid of all
    level pairs is built."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o")).scalar()
    j = cells.join(ra, a).join(cb, b)
    e = F.col("ra") * F.col("cb") / total
    stat = j.agg((F.sum(F.pow(F.col("o") - e, 2) / e) + (total - F.sum(e))).alias("statistic"),
                 F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"))
    return stat.select("statistic", ((F.col("r") - 1) * (F.col("c") - 1)).cast("long").alias("df"),
                       F.sqrt(F.try_divide(F.col("statistic"), total * (F.least("r", "c") - 1))).alias("cramers_v"))


def near_zero_var(df: DataFrame, cols: list[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """E11 ``nearZeroVar(saveMetrics=TRUE)`` per column, without windows:
    top and second value counts come from two aggregate passes."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "variable", "value") \
        .filter(F.col("value").isNotNull())
    vc = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = vc.groupBy("variable").agg(F.max("cnt").alias("top1"), F.count(F.lit(1)).alias("n_distinct"),
                                     F.sum("cnt").alias("n"))
    j = vc.join(top, "variable")
    g = j.groupBy("variable", "top1", "n_distinct", "n").agg(
        F.sum(F.when(F.col("cnt") == F.col("top1"), 1).otherwise(0)).alias("n_at_top"),
        F.max(F.when(F.col("cnt") < F.col("top1"), F.col("cnt"))).alias("second"))
    second = F.when(F.col("n_at_top") >= 2, F.col("top1")).otherwise(F.col("second"))
    fr_ = F.when(F.col("n_distinct") == 1, F.lit(0.0)).otherwise(F.col("top1") / second)
    pu = 100.0 * F.col("n_distinct") / F.col("n")
    out = g.select("variable", fr_.alias("freq_ratio"), pu.alias("percent_unique"),
                   (F.col("n_distinct") == 1).alias("zero_var"))
    return out.withColumn("nzv", F.col("zero_var") | ((F.col("freq_ratio") > freq_cut) &
                                                       (F.col("percent_unique") <= unique_cut)))


# ------------------------------------------------------------- E12-E14 ----


def moments(long: DataFrame, keys: list[str]) -> DataFrame:
    m = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    j = join_null_safe(long, m, keys)
    d = F.col("value") - F.col("mean")
    return j.groupBy(*keys, "n", "mean").agg(F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"),
                                             F.avg(d * d * d * d).alias("m4"))


def jarque_bera(long: DataFrame, keys: list[str]) -> DataFrame:
    """JB = n/6 (S^2 + (K-3)^2 / 4) from population moments; p = exp(-JB/2)
    (chi-square, 2 df)."""
    m = moments(long, keys)
    s = F.try_divide(F.col("m3"), F.pow("m2", 1.5))  # NULL for a constant column
    k = F.try_divide(F.col("m4"), F.col("m2") * F.col("m2"))
    jb = F.col("n") / 6.0 * (s * s + (k - 3) * (k - 3) / 4.0)
    return m.select(*keys, F.lit("Jarque-Bera").alias("method"), jb.alias("statistic"),
                    F.exp(-jb / 2).alias("p_value"))


# Coefficients of the normal-quantile rational approximation
# (P. J. Acklam, 2003), central region |p - 0.5| <= 0.47575.
_QA = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
       -3.066479806614716e+01, 2.506628277459239e+00]
_QB = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
       -1.328068155288572e+01]
_QC = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
       4.374664141464968e+00, 2.938163982698783e+00]
_QD = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def _horner(coefs: list[float], v: str) -> str:
    out = f"({coefs[0]!r})"
    for c in coefs[1:]:
        out = f"({out} * {v} + ({c!r}))"
    return out


def qnorm_sql(p: str) -> str:
    """Inverse standard normal CDF as SQL text (same text in Spark and DuckDB)."""
    plow = 0.02425
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    central = f"({_horner(_QA, r)} * {q} / ({_horner(_QB, r)} * {r} + 1.0))"
    ql = f"sqrt(-2.0 * ln({p}))"
    lower = f"({_horner(_QC, ql)} / ({_horner(_QD, ql)} * {ql} + 1.0))"
    qu = f"sqrt(-2.0 * ln(1.0 - {p}))"
    upper = f"(-{_horner(_QC, qu)} / ({_horner(_QD, qu)} * {qu} + 1.0))"
    return f"(CASE WHEN {p} < {plow} THEN {lower} WHEN {p} > {1 - plow} THEN {upper} ELSE {central} END)"


# Zelen & Severo (Abramowitz-Stegun 26.2.17) normal CDF coefficients.
_PB = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def pnorm_sql(z: str) -> str:
    """Standard normal CDF as SQL text (|error| < 7.5e-8)."""
    t = f"(1.0 / (1.0 + 0.2316419 * abs({z})))"
    poly = f"({t} * ({_PB[0]} + {t} * ({_PB[1]} + {t} * ({_PB[2]} + {t} * ({_PB[3]} + {t} * {_PB[4]})))))"
    tail = f"(exp(-0.5 * {z} * {z}) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1.0 - {tail} ELSE {tail} END)"


def qq_points(df: DataFrame, value: str, conf: float = 0.95) -> DataFrame:
    """Sample vs theoretical normal quantiles (ppoints positions) with a
    pointwise band sd / dnorm(q) * sqrt(p (1 - p) / n) * z."""
    from .frames import row_ids
    x = df.select(F.col(value).cast("double").alias("sample")).filter(F.col("sample").isNotNull())
    n = x.agg(F.count(F.lit(1))).scalar()
    stats = x.agg(F.avg("sample").alias("m"), F.stddev_samp("sample").alias("s"))
    m, s = stats.select("m").scalar(), stats.select("s").scalar()
    r = row_ids(x, ["sample"], "i")
    a = F.when(n <= 10, F.lit(3.0 / 8)).otherwise(F.lit(0.5))
    r = r.withColumn("p", (F.col("i") - a) / (n + 1 - 2 * a))
    r = r.withColumn("theoretical", F.expr(qnorm_sql("p")))
    z = F.lit(_qnorm_py(0.5 + conf / 2))
    dn = F.exp(-0.5 * F.col("theoretical") * F.col("theoretical")) / math.sqrt(2 * math.pi)
    se = s / dn * F.sqrt(F.col("p") * (1 - F.col("p")) / n)
    fit = m + s * F.col("theoretical")
    return r.select("i", "sample", "p", "theoretical", fit.alias("fitted"), (fit - z * se).alias("lower"),
                    (fit + z * se).alias("upper"))


def _qnorm_py(p: float) -> float:
    """Driver-side twin of ``qnorm_sql`` for one constant."""
    q = p - 0.5
    if abs(q) <= 0.47575:
        r = q * q
        num = reduce(lambda acc, c: acc * r + c, _QA[1:], _QA[0])
        den = reduce(lambda acc, c: acc * r + c, _QB[1:], _QB[0]) * r + 1.0
        return num * q / den
    ql = math.sqrt(-2 * math.log(p if q < 0 else 1 - p))
    num = reduce(lambda acc, c: acc * ql + c, _QC[1:], _QC[0])
    den = reduce(lambda acc, c: acc * ql + c, _QD[1:], _QD[0]) * ql + 1.0
    return num / den if q < 0 else -num / den


def fixed_breaks_histogram(df: DataFrame, value: str, breaks: list[float]) -> DataFrame:
    """E3 with fixed breaks: counts per right-closed interval (first one
    closed on both sides, as ``hist``); values outside the breaks are left out."""
    x = F.col(value).cast("double")
    idx = None
    for i in range(len(breaks) - 1):
        lo, hi = breaks[i], breaks[i + 1]
        cond = (x >= lo) & (x <= hi) if i == 0 else (x > lo) & (x <= hi)
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))
    b = df.select(idx.alias("bin")).filter(F.col("bin").isNotNull())
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = F.array(*[F.lit(float(v)) for v in breaks])
    return counts.select(F.col("bin").cast("long").alias("bin"), F.element_at(edges, F.col("bin") + 1).alias("lower"),
                         F.element_at(edges, F.col("bin") + 2).alias("upper"), "n")


def outlier_rows(long: DataFrame, by: list[str], k: float = 1.5) -> DataFrame:
    """E2 outlier points: rows outside (Q1 - k IQR, Q3 + k IQR) of their
    (by..., variable) group, with the fences (equi join back on the group)."""
    keys = by + ["variable"]
    f = fences(long, "value", keys, k).select(*keys, "lower", "upper")
    j = join_null_safe(long.filter(F.col("value").isNotNull()), f, keys)
    return j.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
