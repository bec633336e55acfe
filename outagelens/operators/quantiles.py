"""Exact quantiles (R type 7 = DuckDB quantile_cont) without per-group buffers.

``percentile``/``median`` keep every value of a group in one aggregation
buffer, which breaks when one group holds a third of the data.  Here the
distinct values are counted, given distributed running totals, and the two
order statistics around each target position are picked by an equi join on
the group and a grouped minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Rows (by..., p, q): type-7 quantile of ``value`` (NULLs ignored).

    1. count each distinct (group, value) - partial aggregation;
    2. one global running total in (group, value) order gives every distinct
       value its interval of global positions [start, end];
    3. a target position lies in exactly one interval: intervals are cut
       into buckets of width W (about two bucket rows per distinct value) and
       matched to the targets by an equi join on the bucket.
    Cost follows the number of distinct values; no group is ever held by one
    task or buffer."""
    from .frames import join_null_safe, running_totals
    by = list(by or [])
    x = df.select(*by, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    vc = x.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(vc, [*by, "_x"], {"_end": F.col("_c")})
    cum = cum.withColumn("_start", F.col("_end") - F.col("_c") + 1)
    sizes = cum.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("d")).first()  # two numbers
    if not sizes["n"]:
        empty = [T.StructField(b, df.schema[b].dataType) for b in by]
        return df.sparkSession.createDataFrame([], T.StructType([*empty, T.StructField("p", T.DoubleType()),
                                                                 T.StructField("q", T.DoubleType())]))
    width = max(1, sizes["n"] // max(sizes["d"], 1))
    groups = cum.groupBy(*by).agg(F.min("_start").alias("_g0"), F.sum("_c").alias("_n"))
    targets = (groups.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_h", (F.col("_n") - 1) * F.col("p") + 1)
               .withColumn("_lo", F.col("_g0") + F.floor("_h").cast("long") - 1)
               .withColumn("_hi", F.col("_g0") + F.ceil("_h").cast("long") - 1))
    pos = targets.select(F.explode(F.array("_lo", "_hi")).alias("_t")).distinct() \
        .withColumn("_b", F.floor(F.col("_t") / width))
    spans = cum.select("_x", "_start", "_end", F.explode(F.sequence(
        F.floor(F.col("_start") / width), F.floor(F.col("_end") / width))).alias("_b"))
    at = spans.join(pos, "_b").filter((F.col("_t") >= F.col("_start")) & (F.col("_t") <= F.col("_end")))
    at = at.select("_t", "_x")
    lo = at.select(F.col("_t").alias("_lo"), F.col("_x").alias("_xlo"))
    hi = at.select(F.col("_t").alias("_hi"), F.col("_x").alias("_xhi"))
    out = targets.join(lo, "_lo").join(hi, "_hi")
    frac = F.col("_h") - F.floor("_h")
    q = F.col("_xlo") + frac * (F.col("_xhi") - F.col("_xlo"))
    return out.select(*by, "p", q.alias("q"))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Wide form: one column per named probability (e.g. {"q1": .25, "q3": .75})."""
    by = list(by or [])
    long = exact_quantiles(df, value, list(named.values()), by)
    aggs = [F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in named.items()]
    return long.groupBy(*by).agg(*aggs) if by else long.agg(*aggs)
