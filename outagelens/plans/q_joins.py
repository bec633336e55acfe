"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mathx as mx
from ..operators import joins as jn
from ..sources.tables import Tables
from . import sqlparts as sq
from . import standins as si
from .registry import register


@register("j01_inner_join", ids=("J1",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderdate FROM lineitem "
              "JOIN orders ON l_orderkey = o_orderkey")
def j01(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey", "inner")


@register("j02_composite_key", ids=("J2",),
          sql="WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, max(l_quantity) AS max_q FROM lineitem "
              "GROUP BY 1, 2, 3) SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, g.max_q "
              "FROM lineitem l JOIN g ON l.l_orderkey = g.l_orderkey AND l.l_partkey = g.l_partkey "
              "AND l.l_suppkey = g.l_suppkey")
def j02(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    g = t.lineitem.groupBy(*keys).agg(F.max("l_quantity").alias("max_q"))
    return t.lineitem.select(*keys, "l_linenumber").join(g, keys, "inner")


@register("j03_left_join", ids=("J3",),
          sql="SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey + 7 = c_custkey")
def j03(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", (F.col("o_custkey") + 7).alias("c_custkey"))
    return o.join(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", "left").drop("c_custkey")


@register("j04_left_join_renamed_keys", ids=("J4",),
          sql="SELECT l_orderkey, l_linenumber, l_suppkey, s_name, s_acctbal FROM lineitem "
              "LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) s ON l_suppkey = s.s_suppkey")
def j04(t: Tables) -> DataFrame:
    s = t.supplier.filter(F.col("s_suppkey") % 7 != 0).withColumnRenamed("s_suppkey", "l_suppkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey") \
        .join(s.select("l_suppkey", "s_name", "s_acctbal"), "l_suppkey", "left")


_J5_SRC = {
    "a": "SELECT CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE c_custkey END AS siteid, c_name AS nombre_a "
         "FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 50 = 1",
    "b": "SELECT CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE c_custkey END AS siteid, c_mktsegment AS nombre_b "
         "FROM customer WHERE c_custkey % 3 = 0 OR c_custkey = 1",
    "c": "SELECT s_suppkey AS siteid, s_name AS nombre_c FROM supplier",
}


def _j5_sources(t: Tables):
    c = t.customer
    key = F.when(F.col("c_custkey") % 50 == 1, F.lit(None)).otherwise(F.col("c_custkey")).alias("siteid")
    a = c.filter((F.col("c_custkey") % 2 == 0) | (F.col("c_custkey") % 50 == 1)).select(key, F.col("c_name")
                                                                                         .alias("nombre_a"))
    b = c.filter((F.col("c_custkey") % 3 == 0) | (F.col("c_custkey") == 1)).select(key, F.col("c_mktsegment")
                                                                                   .alias("nombre_b"))
    s = t.supplier.select(F.col("s_suppkey").alias("siteid"), F.col("s_name").alias("nombre_c"))
    return [a, b, s]


@register("j05_full_join_chain", ids=("J5", "N3"),
          sql=f"SELECT coalesce(ab.siteid, c.siteid) AS siteid, nombre_a, nombre_b, nombre_c FROM "
              f"(SELECT coalesce(a.siteid, b.siteid) AS siteid, nombre_a, nombre_b FROM ({_J5_SRC['a']}) a "
              f"FULL JOIN ({_J5_SRC['b']}) b ON a.siteid = b.siteid) ab FULL JOIN ({_J5_SRC['c']}) c "
              f"ON ab.siteid = c.siteid")
def j05(t: Tables) -> DataFrame:
    return jn.full_join_coalesce(_j5_sources(t), "siteid")


@register("j05b_full_join_null_safe", ids=("J5",),
          sql=f"SELECT coalesce(ab.siteid, c.siteid) AS siteid, nombre_a, nombre_b, nombre_c FROM "
              f"(SELECT coalesce(a.siteid, b.siteid) AS siteid, nombre_a, nombre_b FROM ({_J5_SRC['a']}) a "
              f"FULL JOIN ({_J5_SRC['b']}) b ON a.siteid IS NOT DISTINCT FROM b.siteid) ab FULL JOIN "
              f"({_J5_SRC['c']}) c ON ab.siteid IS NOT DISTINCT FROM c.siteid")
def j05b(t: Tables) -> DataFrame:
    return jn.full_join_coalesce(_j5_sources(t), "siteid", null_safe=True)


@register("j06_anti_join", ids=("J6",),
          sql="SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j06(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(
        t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@register("j07_semi_join", ids=("J7", "S11"),
          sql="SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN "
              "(SELECT p_partkey FROM part WHERE p_size > 40)")
def j07(t: Tables) -> DataFrame:
    big = t.part.filter(F.col("p_size") > 40).select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(big, "l_partkey", "left_semi")


@register("j07b_semi_join_or", ids=("J7", "F2"),
          sql="SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN "
              "(SELECT p_partkey FROM part WHERE p_size > 40) OR l_returnflag = 'R'")
def j07b(t: Tables) -> DataFrame:
    big = t.part.filter(F.col("p_size") > 40).select(F.col("p_partkey").alias("l_partkey"))
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return jn.semi_or(l, big, "l_partkey", F.col("l_returnflag") == "R").drop("l_returnflag")


# ------------------------------------------------------------ J8: geo ----

GEO_KM = 10.0


@register("j08_geo_left_join", ids=("J8", "M5"),
          sql=f"WITH c AS ({si.ORIGIN_SITES_SQL}), s AS ({si.AFFECTED_SITES_SQL}) "
              f"SELECT c.siteid AS siteid_x, s.siteid AS siteid_y, "
              + sq.rnd(mx.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon"), 6)
              + f" AS dist_km FROM c LEFT JOIN s ON "
              + mx.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon") + f" <= {GEO_KM}")
def j08(t: Tables) -> DataFrame:
    left = si.origin_sites(t).select("siteid", "lat", "lon")
    right = si.affected_sites(t).select("siteid", "lat", "lon")
    out = jn.geo_left_join(left, right, GEO_KM)
    return out.select("siteid_x", "siteid_y", mx.rnd("dist_km", 6).alias("dist_km"))


# ----------------------------------------------------- J9/J10: interval --

_J9_SQL = (f"WITH o AS ({si.OUTAGES_SQL}), r AS ({si.SENSOR_SQL}) "
           "SELECT o.outage_id, o.siteid, o.inicio, o.fin, max(r.valor) AS galonaje FROM o JOIN r "
           "ON o.siteid = r.siteid AND r.fecha_hora BETWEEN o.inicio {lo} AND o.fin {hi} "
           "GROUP BY o.outage_id, o.siteid, o.inicio, o.fin")


@register("j09_interval_max", ids=("J9", "A3", "F9"), sql=_J9_SQL.format(lo="", hi=""))
def j09(t: Tables) -> DataFrame:
    return jn.interval_max(si.outages(t), si.sensor(t), ["outage_id", "siteid", "inicio", "fin"], "siteid",
                           "inicio", "fin", "fecha_hora", "valor", "galonaje")


@register("j10_interval_margin", ids=("J10",),
          sql=_J9_SQL.format(lo="- INTERVAL 30 MINUTE", hi="+ INTERVAL 30 MINUTE"))
def j10(t: Tables) -> DataFrame:
    return jn.interval_max(si.outages(t), si.sensor(t), ["outage_id", "siteid", "inicio", "fin"], "siteid",
                           "inicio", "fin", "fecha_hora", "valor", "galonaje", margin_seconds=30 * 60)


# ------------------------------------------------------- J11: tolerance --


@register("j11_tolerance_match", ids=("J11",),
          sql=f"WITH b AS ({si.BATTERY_SQL}), o AS ({si.OUTAGES_SQL}), "
              "b1 AS (SELECT * FROM b WHERE running_on_battery > 0), "
              "c AS (SELECT b1.battery_id, o.outage_id, o.minutos, "
              "abs(epoch_us(b1.occurred_on) - epoch_us(o.inicio)) AS gap FROM b1 JOIN o ON b1.siteid = o.siteid "
              "AND abs(epoch_us(b1.occurred_on) - epoch_us(o.inicio)) <= 600000000), "
              "best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY battery_id "
              "ORDER BY minutos DESC, gap, outage_id) = 1) "
              "SELECT b1.battery_id, b1.siteid, b1.occurred_on, best.outage_id, best.minutos, "
              "best.gap / 1000000.0 AS gap_seconds FROM b1 LEFT JOIN best ON b1.battery_id = best.battery_id")
def j11(t: Tables) -> DataFrame:
    b = si.battery_log(t).filter(F.col("running_on_battery") > 0).select("battery_id", "siteid", "occurred_on")
    o = si.outages(t).select("outage_id", "siteid", "inicio", "minutos")
    return jn.tolerance_match(b, o, "battery_id", "siteid", "occurred_on", "inicio", 600,
                              prefer=[-F.col("minutos")], right_id="outage_id") \
        .select("battery_id", "siteid", "occurred_on", "outage_id", "minutos", "gap_seconds")


# --------------------------------------------------- J12/J13 lookups ----

# Stand-in values of our own: prefix catalogue (3-char prefix -> department) and manual overrides.
PREFIX_CATALOGUE = [("AUT", "ESCUINTLA"), ("BUI", "GUATEMALA"), ("FUR", "PETEN"), ("HOU", "IZABAL")]
OVERRIDES = [(7, "QUICHE"), (14, "ZACAPA"), (21, "SACATEPEQUEZ")]


def _lookup_df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@register("j12_prefix_join", ids=("J12", "S8"),
          sql="WITH cat(prefijo, departamento) AS (VALUES "
              + ", ".join(f"('{a}', '{b}')" for a, b in PREFIX_CATALOGUE)
              + ") SELECT c_custkey, substr(c_mktsegment, 1, 3) AS prefijo, departamento FROM customer "
              "LEFT JOIN cat ON substr(c_mktsegment, 1, 3) = cat.prefijo")
def j12(t: Tables) -> DataFrame:
    cat = _lookup_df(t.spark, PREFIX_CATALOGUE, "prefijo string, departamento string")
    c = t.customer.select("c_custkey", F.substring("c_mktsegment", 1, 3).alias("prefijo"))
    return c.join(F.broadcast(cat), "prefijo", "left")  # literal catalogue: fixed size


@register("j13_override_coalesce", ids=("J13", "N3"),
          sql="WITH cat(prefijo, departamento) AS (VALUES "
              + ", ".join(f"('{a}', '{b}')" for a, b in PREFIX_CATALOGUE)
              + "), ov(c_custkey, dep_manual) AS (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in OVERRIDES)
              + ") SELECT customer.c_custkey, coalesce(ov.dep_manual, cat.departamento) AS departamento FROM customer "
              "LEFT JOIN cat ON substr(c_mktsegment, 1, 3) = cat.prefijo LEFT JOIN ov ON customer.c_custkey = ov.c_custkey")
def j13(t: Tables) -> DataFrame:
    cat = _lookup_df(t.spark, PREFIX_CATALOGUE, "prefijo string, departamento string")
    ov = _lookup_df(t.spark, OVERRIDES, "c_custkey long, dep_manual string")
    c = t.customer.select("c_custkey", F.substring("c_mktsegment", 1, 3).alias("prefijo"))
    j = c.join(F.broadcast(cat), "prefijo", "left").join(F.broadcast(ov), "c_custkey", "left")
    return j.select("c_custkey", F.coalesce("dep_manual", "departamento").alias("departamento"))


@register("j14_keyed_bind_cols", ids=("J14", "G11"),
          sql="WITH a AS (SELECT o_orderstatus AS grupo, avg(o_totalprice) AS train FROM orders "
              "WHERE o_orderkey % 5 <> 0 GROUP BY 1), b AS (SELECT o_orderstatus AS grupo, avg(o_totalprice) AS test "
              "FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT a.grupo, " + sq.rnd("train") + " AS train, "
              + sq.rnd("test") + " AS test, " + sq.rnd("test - train") + " AS delta, "
              + sq.rnd("100 * (test - train) / train", 4) + " AS delta_pct FROM a JOIN b ON a.grupo = b.grupo")
def j14(t: Tables) -> DataFrame:
    o = t.orders
    a = o.filter(F.col("o_orderkey") % 5 != 0).groupBy(F.col("o_orderstatus").alias("grupo")) \
        .agg(F.avg("o_totalprice").alias("train"))
    b = o.filter(F.col("o_orderkey") % 5 == 0).groupBy(F.col("o_orderstatus").alias("grupo")) \
        .agg(F.avg("o_totalprice").alias("test"))
    j = a.join(b, "grupo")
    return j.select("grupo", mx.rnd("train").alias("train"), mx.rnd("test").alias("test"),
                    mx.rnd(F.col("test") - F.col("train")).alias("delta"),
                    mx.rnd(100 * (F.col("test") - F.col("train")) / F.col("train"), 4).alias("delta_pct"))


# ------------------------------------------------ S5: cached intermediate --


@register("s05_cached_interval_result", ids=("S5", "S6", "S9", "J9"), sql=_J9_SQL.format(lo="", hi=""))
def s05(t: Tables) -> DataFrame:
    """The expensive fuel-at-outage join written once to shared storage
    (the session's checkpoint folder) and read back, as the reference caches
    it in a file instead of recomputing it."""
    from ..session import run_path
    from ..sources import files, sinks
    res = jn.interval_max(si.outages(t), si.sensor(t), ["outage_id", "siteid", "inicio", "fin"], "siteid",
                          "inicio", "fin", "fecha_hora", "valor", "galonaje")
    path = run_path(t.spark, "cache/galonaje")
    sinks.write_table(res, path)
    return files.read_cached(t.spark, path)


# -------------------------------------------- S1-S4: delimited text files --


@register("s01_delimited_revenue_file", ids=("S1", "S2", "S3", "S4", "S12", "P8"),
          sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, "
              "substr(c_mktsegment, 1, 3) || '-' || CAST(c_custkey AS VARCHAR) AS site_id, o_totalprice AS revenue_total "
              "FROM orders JOIN customer ON o_custkey = c_custkey")
def s01(t: Tables) -> DataFrame:
    """The revenue export as a ';'-separated file with its original headers
    (written to shared storage, S12), read back with an explicit schema,
    cleaned names and one column dropped at read time (S1-S4, P8)."""
    from pyspark.sql import types as T
    from ..session import run_path
    from ..sources import files, sinks
    o, c = t.orders, t.customer
    raw = o.join(c, o.o_custkey == c.c_custkey).select(
        F.year("o_orderdate").alias("YEAR"), F.month("o_orderdate").alias("MONTH"),
        F.concat(F.substring("c_mktsegment", 1, 3), F.lit("-"), F.col("c_custkey").cast("string")).alias("SITE_ID"),
        F.col("c_name").alias("Site Name"), F.col("o_totalprice").alias("REVENUE_TOTAL"))
    path = run_path(t.spark, "exports/revenue_rbs")
    sinks.write_csv(raw, path, sep=";")
    schema = T.StructType([T.StructField("YEAR", T.IntegerType()), T.StructField("MONTH", T.IntegerType()),
                           T.StructField("SITE_ID", T.StringType()), T.StructField("Site Name", T.StringType()),
                           T.StructField("REVENUE_TOTAL", T.DoubleType())])
    return files.read_delimited(t.spark, path, schema, sep=";", drop=("site_name",))
