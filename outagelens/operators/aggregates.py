"""Aggregations and windows.

All grouped statistics are plain ``groupBy().agg()`` so Spark does map-side
partial aggregation; exact medians/quantiles go through ``quantiles``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mathx import rnd
from .quantiles import quantile_columns


def sum_strict(c) -> Column:
    """A1 R ``sum`` without na.rm: NULL when any input is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def max_strict(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(F.lit(1)) == F.count(c), F.max(c))


def row_mean_strict(cols: list) -> Column:
    """A10 ``rowMeans`` without na.rm: NULL if any input is NULL."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return reduce(lambda a, b: a + b, cs) / len(cs)


def frequency(df: DataFrame, col: str, digits: int = 1) -> DataFrame:
    """A5 ``tabyl(x)`` + percent text: n, share, "12.3%"."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / total
    return g.select(col, "n", share.alias("percent"),
                    F.concat(F.format_string(f"%.{digits}f", rnd(share * 100, digits)), F.lit("%")).alias("pct"))


def crosstab_totals(df: DataFrame, a: str, b: str, total_label: str = "Total") -> DataFrame:
    """A6 ``tabyl(a, b) + adorn_totals(c("row","col"))`` in long form via CUBE."""
    g = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return g.select(F.when(F.col("_ga") == 1, F.lit(total_label)).otherwise(F.col(a).cast("string")).alias(a),
                    F.when(F.col("_gb") == 1, F.lit(total_label)).otherwise(F.col(b).cast("string")).alias(b), "n")


def row_percentages(df: DataFrame, a: str, b: str, digits: int = 2) -> DataFrame:
    """A7 row percentages with counts: "45.12% (n)" (half-up rounding)."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # window over the aggregated table (one row per cell)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(a))
    return g.select(a, b, "n", F.concat(F.format_string(f"%.{digits}f", rnd(share * 100, digits)), F.lit("% ("),
                                        F.col("n").cast("string"), F.lit(")")).alias("celda"))


def skim(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (variable, mean, median, max, min) for numeric columns.

    Mean/max/min come from one aggregate pass unpivoted; medians from the
    exact sort-based quantile."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.max(c).cast("double").alias("max"),
                            F.min(c).cast("double").alias("min")).alias(c) for c in cols])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("s"))
                                          for c in cols])).alias("r"))
    long = long.select("r.variable", "r.s.mean", "r.s.max", "r.s.min")
    vals = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("r")).select("r.variable", "r.v")
    med = quantile_columns(vals, "v", {"median": 0.5}, by=["variable"])
    return long.join(med, "variable", "left")


def profile(df: DataFrame) -> DataFrame:
    """A12 ``plot_intro``: rows, columns, discrete/continuous columns, missing
    cells, complete rows - one aggregate pass."""
    from .columns import cols_of_type
    numeric = cols_of_type(df, "numeric")
    nulls = [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns]
    missing = reduce(lambda a, b: a + b, nulls)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(df.columns) - len(numeric)).cast("long").alias("discrete_columns"),
        F.lit(len(numeric)).cast("long").alias("continuous_columns"),
        F.sum(missing).cast("long").alias("missing_cells"),
        F.sum(F.when(missing == 0, 1).otherwise(0)).cast("long").alias("complete_rows"))


def lag_same_key(df: DataFrame, key: str, order: list[str], col: str, out: str,
                 partitions: int | None = None) -> DataFrame:
    """Previous row's ``col`` when it belongs to the same key (in
    ``order``, a total order), else the row's own value.

    Rows are range-partitioned by (key, order) and checkpointed; the lag is
    taken inside each partition, and the first row of a partition takes the
    last value of the one before when that has the same key (one row per
    partition, broadcast).  A key holding a third of all rows is spread over
    many partitions; the plan is the same at every size.  A NULL key is a
    key too."""
    from .frames import follows_previous, partition_edges, run_starts, sorted_slices
    slices = sorted_slices(df, [key, *order], partitions)
    kind = df.schema[col].dataType
    schema = T.StructType([*slices.schema.fields, T.StructField("_prev", kind), T.StructField("_starts", T.BooleanType()),
                           T.StructField("_first", T.BooleanType())])

    def run(batches):
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(col)
            ahead = pa.nulls(1, own.type) if before is None else before.column(col)
            first = np.zeros(batch.num_rows, dtype=bool)
            first[0] = before is None
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.concat_arrays([ahead, own]).slice(0, batch.num_rows),
                 pa.array(run_starts(batch, ["_pid", key], before)), pa.array(first)], names=schema.names)
            before = batch.slice(batch.num_rows - 1, 1)

    def tails(batches):
        last = None
        for batch in batches:
            last = batch.column(col).slice(batch.num_rows - 1, 1)
        return [last]

    edges = partition_edges(slices.select(*dict.fromkeys(["_pid", key, col])), [key], tails, [kind])
    w = Window.orderBy("_pid")
    carry = edges.select("_pid", follows_previous([key]).alias("_has_prev"), F.lag("_s0").over(w).alias("_carry"))
    j = slices.mapInArrow(run, schema).join(F.broadcast(carry), "_pid")
    value = F.when(~F.col("_starts"), F.col("_prev")).when(F.col("_first") & F.col("_has_prev"), F.col("_carry")) \
        .otherwise(F.col(col))
    return j.withColumn(out, value).drop("_pid", "_prev", "_starts", "_first", "_carry", "_has_prev")


def crosstab_wide(df: DataFrame, a: str, b: str, levels_b: list[str], total_label: str = "Total") -> DataFrame:
    """A6 as displayed: one row per level of ``a`` plus a total row, one column
    per level of ``b`` (explicit list) plus a total column (CUBE, then pivot)."""
    long = crosstab_totals(df, a, b, total_label)
    wide = long.groupBy(a).pivot(b, [*levels_b, total_label]).agg(F.sum("n"))
    return wide.fillna(0, subset=[*levels_b, total_label])
