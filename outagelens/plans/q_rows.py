"""Queries for filters, sort/top-k/sampling and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_sql
from ..operators import frames as fr
from ..operators import reshape as rs
from ..sources.tables import Tables
from .registry import register

# ----------------------------------------------------------- filters F --


@register("f01_filter_and", ids=("F1",),
          sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders "
              "WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND "
              "(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END) <> '5-LOW'")
def f01(t: Tables) -> DataFrame:
    o = t.orders
    prio = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return o.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000) & (prio != "5-LOW")) \
        .select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("f02_or_within_and", ids=("F2",),
          sql="SELECT o_orderkey FROM orders WHERE (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') "
              "AND o_orderstatus = 'O' AND o_totalprice < 150000")
def f02(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.filter(((p == "1-URGENT") | (p == "2-HIGH")) & (F.col("o_orderstatus") == "O")
                           & (F.col("o_totalprice") < 150000)).select("o_orderkey")


@register("f03_in_list", ids=("F3",),
          sql="SELECT c_custkey, c_mktsegment FROM customer WHERE "
              "(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END) IN ('BUILDING', 'MACHINERY')")
def f03(t: Tables) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return t.customer.filter(seg.isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


_SEG_NULL = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"


@register("f04_not_in_both_forms", ids=("F4",),
          sql=f"SELECT c_custkey, 'r' AS form FROM customer WHERE NOT coalesce(({_SEG_NULL}) IN ('BUILDING'), false) "
              f"UNION ALL SELECT c_custkey, 'sql' AS form FROM customer WHERE ({_SEG_NULL}) NOT IN ('BUILDING')")
def f04(t: Tables) -> DataFrame:
    c = t.customer.withColumn("seg", F.when(F.col("c_custkey") % 7 == 0, F.lit(None))
                              .otherwise(F.col("c_mktsegment")))
    r_form = c.filter(fr.not_in_keep_na("seg", ["BUILDING"])).select("c_custkey", F.lit("r").alias("form"))
    sql_form = c.filter(~F.col("seg").isin("BUILDING")).select("c_custkey", F.lit("sql").alias("form"))
    return r_form.unionByName(sql_form)


@register("f05_null_tests", ids=("F5",),
          sql=f"SELECT c_custkey, ({_SEG_NULL}) IS NULL AS sin_segmento FROM customer")
def f05(t: Tables) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", seg.isNull().alias("sin_segmento"))


@register("f06_regex_anti_match", ids=("F6",),
          sql="SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^red|^blue')")
def f06(t: Tables) -> DataFrame:
    return t.part.filter(~F.col("p_name").rlike("^red|^blue")).select("p_partkey", "p_name")


@register("f07_latest_period", ids=("F7",),
          sql="SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('month', o_orderdate) = "
              "(SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def f07(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderdate", F.date_trunc("month", "o_orderdate").alias("periodo"))
    return fr.at_latest(o, "periodo").drop("periodo")


@register("f08_if_any", ids=("F8",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem "
              "WHERE NOT (coalesce(l_discount = 0, false) OR coalesce(l_tax = 0, false) OR "
              "coalesce(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity = 1 END, false))")
def f08(t: Tables) -> DataFrame:
    l = t.lineitem
    qty1 = F.when(F.col("l_linenumber") % 4 == 0, F.lit(None)).otherwise(F.col("l_quantity") == 1)
    return l.filter(~fr.any_true([F.col("l_discount") == 0, F.col("l_tax") == 0, qty1])) \
        .select("l_orderkey", "l_linenumber", "l_partkey")


@register("f09_between_inclusive", ids=("F9",),
          sql="SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
              "AND TIMESTAMP '2024-01-09 12:00:00' AND value BETWEEN 10 AND 50")
def f09(t: Tables) -> DataFrame:
    e = t.events
    return e.filter(F.col("ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
                                        F.lit("2024-01-09 12:00:00").cast("timestamp_ntz"))
                    & F.col("value").between(10, 50)).select("event_id")


@register("f10_slice_rows", ids=("F10", "G8"),
          sql="SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER "
              "(PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn BETWEEN 2 AND 9")
def f10(t: Tables) -> DataFrame:
    return fr.slice_rows(t.events, ["user_id"], ["ts", "event_id"], 2, 9) \
        .select("user_id", "event_id")


# ---------------------------------------------------------------- sort T --


@register("t01_arrange_nulls_last", ids=("T1",),
          sql="SELECT c_custkey, row_number() OVER (ORDER BY (CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END) "
              "DESC NULLS LAST, c_custkey) AS pos FROM customer")
def t01(t: Tables) -> DataFrame:
    c = t.customer.withColumn("bal", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    # the position column is a global ordering, computed without a one-partition window
    return fr.row_ids(c.select("c_custkey", (-F.col("bal")).alias("neg"),
                               F.col("bal").isNull().alias("isnull")),
                      ["isnull", "neg", "c_custkey"], "pos").select("c_custkey", "pos")


@register("t02_top_n_with_ties", ids=("T2",),
          sql="SELECT l_suppkey, l_orderkey, l_linenumber, q FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey "
              "ORDER BY q DESC NULLS LAST) AS rk FROM (SELECT *, nullif(l_quantity, 50) AS q FROM lineitem)) WHERE rk <= 3")
def t02(t: Tables) -> DataFrame:
    l = t.lineitem.withColumn("q", F.nullif("l_quantity", F.lit(50)))
    return fr.top_n_with_ties(l, ["l_suppkey"], "q", 3, desc=True).select("l_suppkey", "l_orderkey", "l_linenumber", "q")


@register("t03_top_one", ids=("T3",),
          sql="SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER "
              "(PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def t03(t: Tables) -> DataFrame:
    return fr.top_one(t.customer, ["c_nationkey"], "c_acctbal", desc=True, tiebreak=["c_custkey"]) \
        .select("c_nationkey", "c_custkey", "c_acctbal")


@register("t04_sample_n", ids=("T4",),
          sql=f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql(2021, 'o_orderkey')}, o_orderkey LIMIT 100")
def t04(t: Tables) -> DataFrame:
    return fr.sample_n(t.orders.select("o_orderkey"), 100, 2021, ["o_orderkey"])


@register("t05_category_order", ids=("T5",),
          sql="SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS orden, "
              "row_number() OVER (ORDER BY median(p_retailprice), p_type) AS orden_mediana FROM part GROUP BY p_type")
def t05(t: Tables) -> DataFrame:
    from pyspark.sql import Window
    from ..operators.quantiles import quantile_columns
    med = quantile_columns(t.part, "p_retailprice", {"med": 0.5}, by=["p_type"])
    g = fr.join_null_safe(t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), med, ["p_type"], "left")
    # after aggregation: one row per level, a small table
    return g.select("p_type", "n",
                    F.row_number().over(Window.orderBy(F.col("n").desc(), "p_type")).cast("long").alias("orden"),
                    F.row_number().over(Window.orderBy("med", "p_type")).cast("long").alias("orden_mediana"))


# ------------------------------------------------------------ reshape U --


@register("u01_bind_rows", ids=("U1",),
          sql="SELECT c_custkey AS siteid, c_name AS nombre, c_acctbal AS saldo, NULL::VARCHAR AS fuente FROM customer "
              "UNION ALL SELECT s_suppkey, s_name, NULL::DOUBLE, 'supplier' FROM supplier")
def u01(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("siteid"), F.col("c_name").alias("nombre"),
                          F.col("c_acctbal").alias("saldo"))
    b = t.supplier.select(F.col("s_suppkey").alias("siteid"), F.col("s_name").alias("nombre"),
                          F.lit("supplier").alias("fuente"))
    return fr.bind_rows(a, b)


@register("u02_union_with_id", ids=("U2",),
          sql=" UNION ALL ".join(f"SELECT '{k}' AS estado, o_orderpriority, count(*) AS n FROM orders "
                                 f"WHERE o_orderstatus = '{k}' GROUP BY 2" for k in "FOP"))
def u02(t: Tables) -> DataFrame:
    parts = {k: t.orders.filter(F.col("o_orderstatus") == k).groupBy("o_orderpriority")
             .agg(F.count(F.lit(1)).alias("n")) for k in "FOP"}
    return fr.bind_rows_id(parts, "estado")


_EAV_SQL = ("SELECT p_partkey AS siteid, name, value FROM (SELECT p_partkey, p_brand, p_type, "
            "CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (value FOR name IN (p_brand, p_type, p_size))")


@register("u03_pivot_wider_eav", ids=("U3",),
          sql=f"WITH eav AS ({_EAV_SQL}) SELECT siteid, max(value) FILTER (WHERE name = 'p_brand') AS p_brand, "
              "max(value) FILTER (WHERE name = 'p_type') AS p_type, max(value) FILTER (WHERE name = 'p_size') AS p_size "
              "FROM eav GROUP BY siteid")
def u03(t: Tables) -> DataFrame:
    eav = rs.part_as_eav(t.part)
    return rs.pivot_wider(eav, ["siteid"], "name", "value", ["p_brand", "p_type", "p_size"])


@register("u04_pivot_metrics", ids=("U4",),
          sql="SELECT o_orderstatus, "
              + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in
                          ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
              + " FROM orders GROUP BY o_orderstatus")
def u04(t: Tables) -> DataFrame:
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", levels).agg(F.count(F.lit(1)))
    return out.fillna(0, subset=levels)


@register("u05_pivot_longer", ids=("U5",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, variable, valor FROM lineitem "
              "UNPIVOT (valor FOR variable IN (l_quantity, l_discount, l_tax))")
def u05(t: Tables) -> DataFrame:
    return rs.pivot_longer(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"],
                           ["l_quantity", "l_discount", "l_tax"], "variable", "valor")
