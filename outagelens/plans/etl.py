"""Composite results Q1-Q19 on the stand-in tables.

Each function is one lazy plan; only the caller's action runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.nulls import case_when
from ..operators.columns import everything_after, map_strings
from ..sources.tables import Tables
from .registry import register

# ---------------------------------------------------------------- Q6 ----
def affected_lines(t: Tables) -> DataFrame:
    """afectacion_00: fact lines with a link category (stand-in: lineitem)."""
    l = t.lineitem
    raw_site = F.concat(F.when(F.col("l_linenumber") % 3 == 0, F.lit("HFC@")).otherwise(F.lit("")),
                        F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(" "))
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    tipo = F.concat(rf, ls)
    categoria = case_when(
        (tipo == "AF", "TX"), (tipo == "RF", "RBS"), (tipo == "NO", "TIGOSTAR"), (tipo == "NF", "FO_OSCURA"),
        default="BUC")
    return l.select(
        F.col("l_orderkey").alias("ticketid"), F.col("l_linenumber"),
        tx.trim_ws(tx.strip_prefix(raw_site, "^HFC@")).alias("sitio_afectado"),
        F.concat(F.lit("SRV-"), F.col("l_partkey").cast("string")).alias("servicio"),
        tipo.alias("tipo_servicio"), categoria.alias("categoria_enlace"),
        F.col("l_quantity").alias("cantidad"))


AFFECTED_LINES_SQL = """
SELECT l_orderkey AS ticketid, l_linenumber,
       regexp_replace(regexp_replace(
           (CASE WHEN l_linenumber % 3 = 0 THEN 'HFC@' ELSE '' END) || 'S' || CAST(l_suppkey AS VARCHAR) || ' ',
           '^HFC@', ''), '^[\\t\\n\\x{0B}\\f\\r\\p{Z}]+|[\\t\\n\\x{0B}\\f\\r\\p{Z}]+$', '', 'g') AS sitio_afectado,
       'SRV-' || CAST(l_partkey AS VARCHAR) AS servicio,
       l_returnflag || l_linestatus AS tipo_servicio,
       CASE WHEN l_returnflag || l_linestatus = 'AF' THEN 'TX'
            WHEN l_returnflag || l_linestatus = 'RF' THEN 'RBS'
            WHEN l_returnflag || l_linestatus = 'NO' THEN 'TIGOSTAR'
            WHEN l_returnflag || l_linestatus = 'NF' THEN 'FO_OSCURA'
            ELSE 'BUC' END AS categoria_enlace,
       l_quantity AS cantidad
FROM lineitem"""


@register("q06_affected_lines", sql=AFFECTED_LINES_SQL, ids=("Q6", "P2", "C5", "N1", "C2"))
def q06(t: Tables) -> DataFrame:
    return affected_lines(t)


# ---------------------------------------------------------------- Q7 ----
def node_revenue(t: Tables) -> DataFrame:
    """ts: mean monthly node revenue (NA-strict row mean) per hour."""
    p = t.part
    months = {
        "marzo": F.col("p_retailprice"),
        "abril": F.col("p_retailprice") * 1.1,
        "mayo": F.col("p_size").cast("double") * 10,
        "junio": F.col("p_retailprice") * 0.9,
    }
    row_mean = sum(months.values(), F.lit(0.0)) / len(months)
    return p.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("nodo"),
                    (row_mean / 720).alias("revenuets_hra"))


NODE_REVENUE_SQL = """
SELECT 'S' || CAST(p_partkey AS VARCHAR) AS nodo,
       (0.0 + p_retailprice + p_retailprice * 1.1 + CAST(p_size AS DOUBLE) * 10 + p_retailprice * 0.9) / 4
             / 720 AS revenuets_hra
FROM part"""


@register("q07_node_revenue", sql=NODE_REVENUE_SQL, ids=("Q7", "A10", "D6"))
def q07(t: Tables) -> DataFrame:
    return node_revenue(t)


# ---------------------------------------------------------------- Q8 ----
def site_list(t: Tables) -> DataFrame:
    """Affected-site attributes (stand-in: suppliers, 1 in 7 missing)."""
    s, n = t.supplier, t.nation
    return (s.filter(F.col("s_suppkey") % 7 != 0)
            .join(n, s.s_nationkey == n.n_nationkey, "left")
            .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("siteid"),
                    F.col("s_name").alias("sitename_sitio_afectado"),
                    F.col("n_name").alias("categoria_sitio_afectado"),
                    F.col("s_acctbal").alias("revenue_hora")))


def retina_sites(t: Tables) -> DataFrame:
    """Sites with the retina sensor flag (suppliers of regions 0 and 1)."""
    s, n = t.supplier, t.nation
    return (s.join(n.filter(F.col("n_regionkey").isin(0, 1)), s.s_nationkey == n.n_nationkey, "left_semi")
            .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("siteid"),
                    F.lit("RETINA").alias("isafectado_retina")))


def ticket_origin(t: Tables) -> DataFrame:
    """tickets_2019 stand-in: origin site of each ticket (customers, 1 in 5 unknown)."""
    o, c, n = t.orders, t.customer, t.nation
    c_known = c.filter(F.col("c_custkey") % 5 != 0)
    retina = n.filter(F.col("n_regionkey").isin(0, 1)).select(
        F.col("n_nationkey").alias("c_nationkey"), F.lit("RETINA").alias("isorigin_retina"))
    return (o.select("o_orderkey", "o_custkey")
            .join(c_known, o.o_custkey == c_known.c_custkey, "left")
            .join(retina, "c_nationkey", "left")
            .select(F.col("o_orderkey").alias("ticketid"),
                    F.col("o_custkey").alias("siteid_origen"),
                    F.col("c_name").alias("sitename_origen"),
                    F.col("isorigin_retina"),
                    F.col("c_mktsegment").alias("categoria_sitio_origen"),
                    (F.col("c_acctbal") / 720).alias("revenue_hora_sitio_origen")))


def corrective_tickets(t: Tables) -> DataFrame:
    """w_ttks_all stand-in: orders as tickets; '5-LOW' priority has no category."""
    return t.orders.select(
        F.col("o_orderkey").alias("ticketid"), F.col("o_orderdate").alias("fecha"),
        (F.col("o_totalprice") / 1000).alias("ttr"),
        F.col("o_orderstatus").alias("estado"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("categoria"))


FRONT_COLUMNS = ["ticketid", "fecha", "siteid_origen", "sitename_origen", "isorigin_retina",
                 "categoria_sitio_origen", "revenue_hora_sitio_origen", "siteid_sitio_afectado",
                 "sitename_sitio_afectado", "isafectado_retina", "categoria_sitio_afectado", "ttr",
                 "revenue_hora_sitio_afectado"]


def tickets_with_origin(t: Tables) -> DataFrame:
    """One pass over orders: the ticket columns (w_ttks_all) and its origin
    site (tickets_2019) - both are keyed by the ticket."""
    o, c, n = t.orders, t.customer, t.nation
    c_known = c.filter(F.col("c_custkey") % 5 != 0)
    retina = n.filter(F.col("n_regionkey").isin(0, 1)).select(
        F.col("n_nationkey").alias("c_nationkey"), F.lit("RETINA").alias("isorigin_retina"))
    return (o.join(c_known, o.o_custkey == c_known.c_custkey, "left")
            .join(retina, "c_nationkey", "left")
            .select(F.col("o_orderkey").alias("ticketid"), F.col("o_orderdate").alias("fecha"),
                    (F.col("o_totalprice") / 1000).alias("ttr"), F.col("o_orderstatus").alias("estado"),
                    F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("categoria"),
                    F.col("o_custkey").alias("siteid_origen"), F.col("c_name").alias("sitename_origen"),
                    F.col("isorigin_retina"), F.col("c_mktsegment").alias("categoria_sitio_origen"),
                    (F.col("c_acctbal") / 720).alias("revenue_hora_sitio_origen")))


def affected_fact(t: Tables) -> DataFrame:
    """Q8 w_afectacion: inner join tickets, left joins to site attributes,
    node revenue (fallback), origin site and retina flags with defaults,
    column order, category filter, text folding.  The category filter is
    applied to the tickets before the join (same rows: inner join)."""
    tickets = tickets_with_origin(t).filter(F.col("categoria").isNotNull())
    fact = (affected_lines(t)
            .join(tickets, "ticketid", "inner")
            .join(site_list(t).withColumnRenamed("siteid", "sitio_afectado"), "sitio_afectado", "left")
            .join(node_revenue(t).withColumnRenamed("nodo", "sitio_afectado"), "sitio_afectado", "left")
            .withColumn("revenue_hora", F.when(F.col("revenue_hora").isNull() & F.col("revenuets_hra").isNotNull(),
                                               F.col("revenuets_hra")).otherwise(F.col("revenue_hora")))
            .join(retina_sites(t).withColumnRenamed("siteid", "sitio_afectado"), "sitio_afectado", "left")
            .withColumnsRenamed({"sitio_afectado": "siteid_sitio_afectado",
                                 "revenue_hora": "revenue_hora_sitio_afectado"})
            .drop("revenuets_hra")
            .fillna({"isorigin_retina": "SIN_RETINA", "isafectado_retina": "SIN_RETINA"}))
    fact = everything_after(fact, FRONT_COLUMNS)
    return map_strings(fact, lambda c: tx.trim_ws(tx.ascii_fold(c)))


def _fold_sql(c: str) -> str:
    from ..functions.text import ACCENTED, UNACCENTED
    return (f"regexp_replace(translate({c}, '{ACCENTED}', '{UNACCENTED}'), "
            f"'^[\\t\\n\\x{{0B}}\\f\\r\\p{{Z}}]+|[\\t\\n\\x{{0B}}\\f\\r\\p{{Z}}]+$', '', 'g')")


AFFECTED_FACT_SQL = f"""
WITH af AS ({AFFECTED_LINES_SQL}),
tk AS (SELECT o_orderkey AS ticketid, o_orderdate AS fecha, o_totalprice / 1000 AS ttr,
              o_orderstatus AS estado, nullif(o_orderpriority, '5-LOW') AS categoria FROM orders),
sl AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS siteid, s_name AS sitename_sitio_afectado,
              n_name AS categoria_sitio_afectado, s_acctbal AS revenue_hora
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0),
ts AS ({NODE_REVENUE_SQL}),
org AS (SELECT o_orderkey AS ticketid, o_custkey AS siteid_origen, c_name AS sitename_origen,
               r.isorigin_retina, c_mktsegment AS categoria_sitio_origen,
               c_acctbal / 720 AS revenue_hora_sitio_origen
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o_custkey = c_custkey
        LEFT JOIN (SELECT n_nationkey, 'RETINA' AS isorigin_retina FROM nation WHERE n_regionkey IN (0, 1)) r
          ON c.c_nationkey = r.n_nationkey),
ret AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS siteid, 'RETINA' AS isafectado_retina FROM supplier
        WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1))),
j AS (
  SELECT af.ticketid, tk.fecha, org.siteid_origen, org.sitename_origen,
         coalesce(org.isorigin_retina, 'SIN_RETINA') AS isorigin_retina,
         org.categoria_sitio_origen, org.revenue_hora_sitio_origen,
         af.sitio_afectado AS siteid_sitio_afectado, sl.sitename_sitio_afectado,
         coalesce(ret.isafectado_retina, 'SIN_RETINA') AS isafectado_retina,
         sl.categoria_sitio_afectado, tk.ttr,
         CASE WHEN sl.revenue_hora IS NULL AND ts.revenuets_hra IS NOT NULL THEN ts.revenuets_hra
              ELSE sl.revenue_hora END AS revenue_hora_sitio_afectado,
         af.l_linenumber, af.servicio, af.tipo_servicio, af.categoria_enlace, af.cantidad,
         tk.estado, tk.categoria
  FROM af JOIN tk ON af.ticketid = tk.ticketid
  LEFT JOIN sl ON af.sitio_afectado = sl.siteid
  LEFT JOIN ts ON af.sitio_afectado = ts.nodo
  LEFT JOIN org ON af.ticketid = org.ticketid
  LEFT JOIN ret ON af.sitio_afectado = ret.siteid
  WHERE tk.categoria IS NOT NULL)
SELECT ticketid, fecha, siteid_origen, {_fold_sql('sitename_origen')} AS sitename_origen,
       {_fold_sql('isorigin_retina')} AS isorigin_retina,
       {_fold_sql('categoria_sitio_origen')} AS categoria_sitio_origen, revenue_hora_sitio_origen,
       {_fold_sql('siteid_sitio_afectado')} AS siteid_sitio_afectado,
       {_fold_sql('sitename_sitio_afectado')} AS sitename_sitio_afectado,
       {_fold_sql('isafectado_retina')} AS isafectado_retina,
       {_fold_sql('categoria_sitio_afectado')} AS categoria_sitio_afectado, ttr, revenue_hora_sitio_afectado,
       l_linenumber, {_fold_sql('servicio')} AS servicio, {_fold_sql('tipo_servicio')} AS tipo_servicio,
       {_fold_sql('categoria_enlace')} AS categoria_enlace, cantidad,
       {_fold_sql('estado')} AS estado, {_fold_sql('categoria')} AS categoria
FROM j"""


@register("q08_affected_fact", sql=AFFECTED_FACT_SQL,
          ids=("Q8", "J1", "J4", "J3", "N1", "N4", "P4", "F5", "C4", "C2", "J13"))
def q08(t: Tables) -> DataFrame:
    return affected_fact(t)
