"""Queries for aggregations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import rnd
from ..operators import aggregates as ag
from ..operators import frames as fr
from ..sources.tables import Tables
from . import sqlparts as sq
from .registry import register

_QTY_NULL = "CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_quantity END"


def _qty_null():
    return F.when(F.col("l_linenumber") % 6 == 0, F.lit(None)).otherwise(F.col("l_quantity"))


@register("a01_group_by_month", ids=("A1", "D3"),
          sql=f"SELECT l_suppkey, date_trunc('month', l_shipdate) AS mes, sum(l_quantity) AS cantidad, "
              f"CASE WHEN count(*) = count({_QTY_NULL}) THEN sum({_QTY_NULL}) END AS cantidad_estricta "
              "FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)")
def a01(t: Tables) -> DataFrame:
    l = t.lineitem.withColumn("q_na", _qty_null())
    return l.groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").alias("mes")).agg(
        F.sum("l_quantity").alias("cantidad"), ag.sum_strict("q_na").alias("cantidad_estricta"))


@register("a02_two_level_reaggregation", ids=("A2",),
          sql="WITH d AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS mes, sum(l_quantity) AS q "
              "FROM lineitem GROUP BY 1, 2), "
              "f AS (SELECT l_partkey, CASE WHEN month(mes) = 1 THEN mes + INTERVAL 1 MONTH ELSE mes END AS mes, q FROM d) "
              "SELECT l_partkey, mes, sum(q) AS cantidad FROM f GROUP BY 1, 2")
def a02(t: Tables) -> DataFrame:
    d = t.lineitem.groupBy("l_partkey", F.date_trunc("month", "l_shipdate").alias("mes")) \
        .agg(F.sum("l_quantity").alias("q"))
    fixed = d.withColumn("mes", F.when(F.month("mes") == 1, F.add_months("mes", 1).cast("timestamp_ntz"))
                         .otherwise(F.col("mes")))
    return fixed.groupBy("l_partkey", "mes").agg(F.sum("q").alias("cantidad"))


@register("a03_max_ignore_na", ids=("A3",),
          sql=f"SELECT l_suppkey, max({_QTY_NULL}) AS max_q, "
              f"CASE WHEN count(*) = count({_QTY_NULL}) THEN max({_QTY_NULL}) END AS max_q_strict "
              "FROM lineitem GROUP BY l_suppkey")
def a03(t: Tables) -> DataFrame:
    l = t.lineitem.withColumn("q_na", _qty_null())
    return l.groupBy("l_suppkey").agg(F.max("q_na").alias("max_q"), ag.max_strict("q_na").alias("max_q_strict"))


@register("a04_count_sizes", ids=("A4", "B4"),
          sql="SELECT 'orders' AS tabla, o_orderstatus AS grupo, count(*) AS n FROM orders GROUP BY 2 "
              "UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def a04(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_orderstatus").alias("grupo")).agg(F.count(F.lit(1)).alias("n"))
    b = t.lineitem.groupBy(F.col("l_linestatus").alias("grupo")).agg(F.count(F.lit(1)).alias("n"))
    return fr.bind_rows_id({"orders": a, "lineitem": b}, "tabla")


@register("a05_frequency_percent", ids=("A5",),
          sql="SELECT o_orderpriority, count(*) AS n, count(*) / sum(count(*)) OVER () AS percent, "
              "printf('%.1f', " + sq.rnd("100.0 * count(*) / sum(count(*)) OVER ()", 1) + ") || '%' AS pct "
              "FROM orders GROUP BY o_orderpriority")
def a05(t: Tables) -> DataFrame:
    return ag.frequency(t.orders, "o_orderpriority")


@register("a06_crosstab_totals", ids=("A6",),
          sql="SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS o_orderstatus, "
              "CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, "
              "count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a06(t: Tables) -> DataFrame:
    return ag.crosstab_totals(t.orders, "o_orderstatus", "o_orderpriority")


@register("a07_row_percentages", ids=("A7",),
          sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n, printf('%.2f', "
              + sq.rnd("100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus)", 2)
              + ") || '% (' || CAST(count(*) AS VARCHAR) || ')' AS celda FROM orders GROUP BY 1, 2")
def a07(t: Tables) -> DataFrame:
    return ag.row_percentages(t.orders, "o_orderstatus", "o_orderpriority")


_LI_ALL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
           "l_returnflag, l_linestatus, l_shipdate")


@register("a08_first_per_key", ids=("A8", "W3"),
          sql=f"SELECT {_LI_ALL} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, "
              "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
              "l_linestatus) AS rn FROM lineitem) WHERE rn = 1")
def a08(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus"]
    return fr.first_per_key(t.lineitem, ["l_orderkey"], order)


@register("a09_get_dupes", ids=("A9", "W4"),
          sql=f"SELECT {_LI_ALL}, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dupe_count "
              "FROM lineitem QUALIFY dupe_count > 1")
def a09(t: Tables) -> DataFrame:
    return fr.dupes(t.lineitem, ["l_orderkey", "l_linenumber"])


@register("a10_row_mean_strict", ids=("A10",),
          sql="SELECT p_partkey, (p_retailprice + CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice * 1.1 END "
              "+ CAST(p_size AS DOUBLE)) / 3 AS media FROM part")
def a10(t: Tables) -> DataFrame:
    p = t.part
    b = F.when(F.col("p_partkey") % 8 == 0, F.lit(None)).otherwise(F.col("p_retailprice") * 1.1)
    return p.select("p_partkey", ag.row_mean_strict([F.col("p_retailprice"), b, F.col("p_size").cast("double")])
                    .alias("media"))


_SKIM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a11_skim_summary", ids=("A11", "M6"),
          sql=" UNION ALL ".join(
              f"SELECT '{c}' AS variable, {sq.rnd(f'avg({c})')} AS mean, {sq.rnd(f'median({c})')} AS median, "
              f"CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min FROM lineitem" for c in _SKIM_COLS))
def a11(t: Tables) -> DataFrame:
    s = ag.skim(t.lineitem, _SKIM_COLS)
    return s.select("variable", rnd("mean").alias("mean"), rnd("median").alias("median"), "max", "min")


@register("a12_data_profile", ids=("A12",),
          sql="WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS prio, "
              "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS total FROM orders) "
              "SELECT count(*) AS rows, CAST(3 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS discrete_columns, "
              "CAST(2 AS BIGINT) AS continuous_columns, "
              "CAST(sum((prio IS NULL)::INT + (total IS NULL)::INT) AS BIGINT) AS missing_cells, "
              "CAST(sum(CASE WHEN prio IS NULL OR total IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS complete_rows FROM x")
def a12(t: Tables) -> DataFrame:
    o = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("total"))
    return ag.profile(o)


# -------------------------------------------------------------- windows --


@register("w01_lag_same_ticket", ids=("W1", "W2"),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nueva_fecha, l_shipdate <> nueva_fecha AS validacion "
              "FROM (SELECT *, CASE WHEN row_number() OVER w > 1 THEN lag(l_shipdate) OVER w ELSE l_shipdate END "
              "AS nueva_fecha FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, "
              "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus))")
def w01(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus"]
    out = ag.lag_same_key(t.lineitem, "l_orderkey", order, "l_shipdate", "nueva_fecha")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nueva_fecha",
                      (F.col("l_shipdate") != F.col("nueva_fecha")).alias("validacion"))


@register("w05_rank_groups", ids=("W5", "G6"),
          sql="WITH m AS (SELECT s_nationkey, s_suppkey, avg(l_quantity) AS metric FROM lineitem "
              "JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), "
              "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY metric DESC, "
              "s_suppkey) AS rn FROM m) WHERE rn = 1) "
              "SELECT s_nationkey, s_suppkey, " + sq.rnd("metric") + " AS metric, "
              "row_number() OVER (ORDER BY metric DESC, s_nationkey) AS rank FROM best")
def w05(t: Tables) -> DataFrame:
    m = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .groupBy("s_nationkey", "s_suppkey").agg(F.avg("l_quantity").alias("metric")))
    best = fr.top_one(m, ["s_nationkey"], "metric", desc=True, tiebreak=["s_suppkey"])
    # global rank over the per-group winners (one row per group: small)
    return best.select("s_nationkey", "s_suppkey", rnd("metric").alias("metric"),
                       F.row_number().over(Window.orderBy(F.col("metric").desc(), "s_nationkey")).cast("long")
                       .alias("rank"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("a06b_crosstab_wide", ids=("A6", "U4"),
          sql="WITH c AS (SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Total' ELSE o_orderstatus END AS s, "
              "CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS p, count(*) AS n "
              "FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)) SELECT s AS o_orderstatus, "
              + ", ".join(f"coalesce(sum(n) FILTER (WHERE p = '{v}'), 0) AS \"{v}\"" for v in _PRIORITIES + ["Total"])
              + " FROM c GROUP BY s")
def a06b(t: Tables) -> DataFrame:
    return ag.crosstab_wide(t.orders, "o_orderstatus", "o_orderpriority", _PRIORITIES)
