"""Fitted distributions, Kolmogorov's limit and densities against published values and direct sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.operators import fits
from outagelens.operators import stats as stx


def test_digamma_and_trigamma():
    assert fits.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-12)   # minus Euler's constant
    assert fits.digamma(0.5) == pytest.approx(-1.9635100260214235, abs=1e-12)
    assert fits.digamma(1, 1) == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    assert fits.digamma(0.5, 1) == pytest.approx(math.pi ** 2 / 2, abs=1e-11)


def test_gamma_cdf_published_values(spark):
    # (shape, x, P(shape, x)): chi-square quantiles, Erlang and exponential sums
    known = [(0.5, 1.920729, 0.95), (0.5, 3.317448, 0.99), (2.5, 5.535249, 0.95), (1.0, 2.0, 1 - math.exp(-2)),
             (3.0, 2.0, 1 - math.exp(-2) * 5), (10.0, 5.0, 1 - math.exp(-5) * sum(5 ** k / math.factorial(k) for k in range(10))),
             (50.0, 67.1, 1 - math.exp(-67.1) * sum(67.1 ** k / math.factorial(k) for k in range(50))), (2.0, 0.0, 0.0), (2.0, -1.0, 0.0)]
    for shape, x, p in known:
        got = spark.createDataFrame([(2 * x,)], "x double").select(fits.gamma_cdf(F.col("x"), shape, 2.0)).first()[0]
        assert got == pytest.approx(p, abs=2e-7), (shape, x)


def test_kolmogorov_limit_published_values(spark):
    known = {0.5: 0.963945, 0.8: 0.544142, 1.0: 0.269999, 1.2238: 0.10, 1.3581: 0.05, 1.6276: 0.01, 0.2: 1.0}
    n = 400
    rows = spark.createDataFrame([(z, z / math.sqrt(n)) for z in known] + [(0.0, 0.0)], "z double, d double")
    got = {r.z: r.p for r in rows.select("z", fits.kolmogorov_p(F.col("d"), F.lit(n)).alias("p")).collect()}
    for z, p in known.items():
        assert got[z] == pytest.approx(p, abs=5e-5)
    assert got[0.0] == 1.0


def test_ranking_finds_the_distribution(spark):
    rng = np.random.default_rng(5)
    samples = {"gamma": rng.gamma(2.2, 3.0, 3000), "norm": rng.normal(50, 3, 3000), "lnorm": rng.lognormal(1, 1, 3000),
               "unif": rng.uniform(2, 9, 3000)}
    for name, values in samples.items():
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        rows = sorted(fits.goodness_of_fit(frame, "x").collect(), key=lambda r: r["rank"])
        assert rows[0].distribution == name and [r["rank"] for r in rows] == [1, 2, 3, 4]
        assert rows[0].score > 0.05 and rows[-1].score < 1e-6
    shape = fits.gamma_shape(samples["gamma"].mean(), np.log(samples["gamma"]).mean())
    assert shape == pytest.approx(2.2, rel=0.08)


def test_degenerate_samples(spark):
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    none = one.where("x < 0")
    for frame in (one, none):
        assert fits.goodness_of_fit(frame, "x").count() == 0 and fits.ks_normality(frame, "x").count() == 0
    signed = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "x double")
    assert {r.distribution for r in fits.goodness_of_fit(signed, "x").collect()} == {"norm", "unif"}
    assert fits.kernel_density(none, "x").count() == 0 and fits.kernel_density(one, "x").count() == 512


def test_ks_distance_with_ties(spark):
    values = np.round(np.random.default_rng(2).normal(size=200), 1)
    got = fits.ks_normality(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").first()
    cdf = lambda v: 0.5 * (1 + math.erf((v - values.mean()) / values.std(ddof=1) / math.sqrt(2)))
    x = np.sort(values)
    direct = max(max((i + 1) / 200 - cdf(v), cdf(v) - i / 200) for i, v in enumerate(x))
    assert got.statistic == pytest.approx(direct, abs=1e-6)


def test_density_follows_the_direct_kernel_sum(spark):
    values = np.random.default_rng(7).exponential(10, 400)
    rows = sorted(fits.kernel_density(spark.createDataFrame([(float(v),) for v in values], "x double"), "x").collect(), key=lambda r: r.point)
    assert [r.point for r in rows] == list(range(512))
    iqr = np.subtract(*np.quantile(values, [0.75, 0.25]))
    bw = 0.9 * min(values.std(ddof=1), iqr / 1.34) * 400 ** -0.2
    at = np.array([r.x for r in rows])
    direct = np.exp(-0.5 * ((at[:, None] - values) / bw) ** 2).sum(axis=1) / (400 * bw * math.sqrt(2 * math.pi))
    assert np.abs(direct - [r.density for r in rows]).max() < 2e-3 * direct.max()
    assert sum(r.density for r in rows) * (at[1] - at[0]) == pytest.approx(1, abs=2e-3)


@pytest.mark.parametrize("lo,up,n,breaks", [(0, 1, 5, [0, 0.2, 0.4, 0.6, 0.8, 1.0]), (0, 7.3, 4, [0, 2, 4, 6, 8]),
                                            (1234, 5678, 5, [1000, 2000, 3000, 4000, 5000, 6000]), (-0.03, 0.04, 6, [-0.03, -0.02, -0.01, 0, 0.01, 0.02, 0.03, 0.04])])
def test_round_breaks(lo, up, n, breaks):
    assert stx.pretty_breaks(lo, up, n) == pytest.approx(breaks)


def test_round_steps():
    assert [stx.round_step(w) for w in (1.0, 1.4, 1.41, 2.8, 2.81, 7.0, 7.01, 9.9)] == [1, 1, 2, 2, 5, 5, 10, 10]
    assert stx.round_step(0.03) == pytest.approx(0.05) and stx.pretty_params(4.0, 4.0, 5)[2] > 0
