"""Ticket ETL, facts on corrective tickets, items and materials: Q9-Q12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dx
from ..functions import text as tx
from ..functions.nulls import case_when
from ..operators import aggregates as ag
from ..operators import columns as pc
from ..operators import frames as fr
from ..operators import joins as jn
from ..sources.tables import Tables
from . import sqlparts as sq
from .etl import AFFECTED_LINES_SQL, NODE_REVENUE_SQL, affected_lines, node_revenue, site_list
from .etl_sites import TICKETS_CORRECTIVE_SQL, tickets, tickets_corrective
from .registry import register

# ----------------------------------------------------------------- Q9 ----


def affected_fact_corrective(t: Tables) -> DataFrame:
    """w_afectacion_correctivo: Q8's joins restricted to corrective tickets, narrower projection."""
    tk = tickets_corrective(t, with_id=False).select("ticketid", "fecha", "ttr", "categoria", "segmento")
    fact = (affected_lines(t).join(tk, "ticketid", "inner")
            .join(site_list(t).withColumnRenamed("siteid", "sitio_afectado"), "sitio_afectado", "left")
            .join(node_revenue(t).withColumnRenamed("nodo", "sitio_afectado"), "sitio_afectado", "left")
            .withColumn("revenue_hora", F.coalesce("revenue_hora", "revenuets_hra"))
            .filter(F.col("categoria").isNotNull()))
    return fact.select("ticketid", "fecha", F.col("sitio_afectado").alias("siteid_sitio_afectado"),
                       "sitename_sitio_afectado", "categoria_sitio_afectado",
                       F.col("revenue_hora").alias("revenue_hora_sitio_afectado"), "ttr", "categoria_enlace",
                       "cantidad", "segmento")


AFFECTED_FACT_CORRECTIVE_SQL = f"""
WITH af AS ({AFFECTED_LINES_SQL}), tk AS ({TICKETS_CORRECTIVE_SQL}),
sl AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS siteid, s_name AS sitename_sitio_afectado,
              n_name AS categoria_sitio_afectado, s_acctbal AS revenue_hora
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0),
ts AS ({NODE_REVENUE_SQL})
SELECT af.ticketid, tk.fecha, af.sitio_afectado AS siteid_sitio_afectado, sl.sitename_sitio_afectado,
       sl.categoria_sitio_afectado, coalesce(sl.revenue_hora, ts.revenuets_hra) AS revenue_hora_sitio_afectado,
       tk.ttr, af.categoria_enlace, af.cantidad, tk.segmento
FROM af JOIN tk ON af.ticketid = tk.ticketid LEFT JOIN sl ON af.sitio_afectado = sl.siteid
LEFT JOIN ts ON af.sitio_afectado = ts.nodo WHERE tk.categoria IS NOT NULL"""


@register("q09_affected_fact_corrective", ids=("Q9", "J1", "J3", "N3"), sql=AFFECTED_FACT_CORRECTIVE_SQL)
def q09(t: Tables) -> DataFrame:
    return affected_fact_corrective(t)


# ---------------------------------------------------------------- Q10 ----

# Part numbers the item master excludes (same as the reference's filter).
BAD_PART_NUMBERS = ["N/A", "DAR DE BAJA", "NO ES TX"]
# Stand-in values of our own: item categories (accents and a trailing blank on purpose) and
# manual change dates for tickets whose date is missing.
ITEM_CATEGORIES = [(0, "electrónica"), (1, "energía"), (2, "otros"), (3, "ELECTRÓNICA ")]
MANUAL_CHANGE_DATES = [(23, "1996-04-02 08:15:00"), (46, "1997-11-20 13:40:30"), (69, "1999-07-07 22:05:10"),
                       (92, "2000-01-31 06:50:45")]


def items(t: Tables) -> DataFrame:
    l = t.lineitem
    pn = (F.when(F.col("l_partkey") % 50 == 0, F.lit(None))
          .when(F.col("l_partkey") % 50 == 1, F.lit("N/A"))
          .otherwise(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))))
    return l.select(
        F.col("l_orderkey").alias("ticketid"), pn.alias("part_number"),
        F.concat(F.lit("E"), (F.col("l_partkey") % 100).cast("string")).alias("codigo_ebs"),
        F.when(F.col("l_linestatus") == "F", F.lit("INSTALADO")).otherwise(F.lit("RETIRADO")).alias("status"),
        F.when(F.col("l_returnflag") == "R", F.lit("ENERGIA")).otherwise(F.lit("ELECTRONICA")).alias("categoria"),
        F.col("l_quantity").alias("cantidad"),
        F.when(F.col("l_linenumber") == 3, F.lit("N/D")).otherwise(F.col("l_extendedprice").cast("string"))
        .alias("precio_usd"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_shipdate")).alias("fecha_cambio"))


ITEMS_SQL = (
    "SELECT l_orderkey AS ticketid, CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 'N/A' "
    "ELSE 'P' || CAST(l_partkey AS VARCHAR) END AS part_number, 'E' || CAST(l_partkey % 100 AS VARCHAR) AS codigo_ebs, "
    "CASE WHEN l_linestatus = 'F' THEN 'INSTALADO' ELSE 'RETIRADO' END AS status, "
    "CASE WHEN l_returnflag = 'R' THEN 'ENERGIA' ELSE 'ELECTRONICA' END AS categoria, l_quantity AS cantidad, "
    "CASE WHEN l_linenumber = 3 THEN 'N/D' ELSE CAST(l_extendedprice AS VARCHAR) END AS precio_usd, "
    "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END AS fecha_cambio FROM lineitem")


def item_master(t: Tables) -> DataFrame:
    """im: item master with categories, cleaned, one row per part number."""
    cat = t.spark.createDataFrame(ITEM_CATEGORIES, "categoria_id long, categoria string")
    p = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_number"),
                      (F.col("p_size") % 4).cast("long").alias("categoria_id"),
                      F.concat_ws("  ", "p_name", "p_type", "p_brand", "p_name", "p_type").alias("description"))
    im = p.join(F.broadcast(cat), "categoria_id", "left")  # literal catalogue
    im = pc.map_strings(im, lambda c: F.upper(tx.ascii_fold(c)))
    im = im.filter(F.col("categoria").isin("ELECTRONICA", "ENERGIA")
                   & fr.not_in_keep_na("part_number", BAD_PART_NUMBERS)
                   & (F.col("part_number") != "INDETERMINADO") & F.col("part_number").isNotNull())
    im = im.drop("categoria_id", "categoria")
    im = im.withColumn("description", tx.squish(tx.left("description", 60)))
    return fr.first_per_key(im, ["part_number"], ["description"])


ITEM_MASTER_SQL = (
    "SELECT part_number, description FROM (SELECT upper(" + sq.ascii_fold("'P' || CAST(p_partkey AS VARCHAR)")
    + ") AS part_number, " + sq.squish("substr(upper(" + sq.ascii_fold(
        "concat_ws('  ', p_name, p_type, p_brand, p_name, p_type)") + "), 1, 60)") + " AS description, "
    "upper(" + sq.ascii_fold("c.categoria") + ") AS categoria FROM part LEFT JOIN (VALUES "
    + ", ".join(f"({a}, '{b}')" for a, b in ITEM_CATEGORIES) + ") c(categoria_id, categoria) "
    "ON p_size % 4 = c.categoria_id) "
    "WHERE categoria IN ('ELECTRONICA', 'ENERGIA') AND NOT coalesce(part_number IN ("
    + ", ".join(f"'{x}'" for x in BAD_PART_NUMBERS) + "), false) AND part_number <> 'INDETERMINADO' "
    "AND part_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY part_number ORDER BY description) = 1")


def items_enriched(t: Tables) -> DataFrame:
    """w_items: cost, item master, change-date repair."""
    it = items(t).withColumn("precio_usd", F.col("precio_usd").try_cast("double"))
    it = it.withColumn("costo_total", F.col("cantidad") * F.col("precio_usd"))
    dates = tickets(t).select("ticketid", F.when(F.col("ticketid") % 23 == 0, F.lit(None))
                              .otherwise(F.col("fecha")).alias("fecha"))
    cam = t.spark.createDataFrame(MANUAL_CHANGE_DATES, "ticketid long, new_date string") \
        .withColumn("new_date", F.to_timestamp_ntz(dx.parse_ymd_hms("new_date")))
    j = it.join(item_master(t), "part_number", "left").join(dates, "ticketid", "left") \
        .join(F.broadcast(cam), "ticketid", "left")  # literal list of manual fixes
    fc, fe, nd = F.col("fecha_cambio"), F.col("fecha"), F.col("new_date")
    j = j.withColumn("fecha_cambio", case_when(
        (fc.isNull() & fe.isNotNull(), fe),
        (fc.isNull() & fe.isNull() & nd.isNotNull(), nd),
        default=fc))
    return j.drop("new_date", "fecha")


ITEMS_ENRICHED_SQL = (
    f"WITH it AS ({ITEMS_SQL}), im AS ({ITEM_MASTER_SQL}), "
    "d AS (SELECT o_orderkey AS ticketid, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS fecha "
    "FROM orders), cam AS (SELECT ticketid, CAST(strptime(new_date, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS new_date "
    "FROM (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in MANUAL_CHANGE_DATES) + ") v(ticketid, new_date)) "
    "SELECT it.ticketid, it.part_number, it.codigo_ebs, it.status, it.categoria, it.cantidad, "
    "TRY_CAST(it.precio_usd AS DOUBLE) AS precio_usd, it.cantidad * TRY_CAST(it.precio_usd AS DOUBLE) AS costo_total, "
    "im.description, CASE WHEN it.fecha_cambio IS NULL AND d.fecha IS NOT NULL THEN d.fecha "
    "WHEN it.fecha_cambio IS NULL AND d.fecha IS NULL AND cam.new_date IS NOT NULL THEN cam.new_date "
    "ELSE it.fecha_cambio END AS fecha_cambio FROM it LEFT JOIN im ON it.part_number = im.part_number "
    "LEFT JOIN d ON it.ticketid = d.ticketid LEFT JOIN cam ON it.ticketid = cam.ticketid")


@register("q10_items_enriched", ids=("Q10", "J3", "F3", "F4", "C8", "C3", "A8", "N7", "M4", "N1", "D1", "S8"),
          sql=ITEMS_ENRICHED_SQL)
def q10(t: Tables) -> DataFrame:
    return items_enriched(t)


# ---------------------------------------------------------------- Q11 ----


def items_by_ticket(t: Tables) -> DataFrame:
    """itm_01: installed electronics items with the ticket date and the lag repair."""
    itm = items_enriched(t).filter(F.col("status").isin("INSTALADO") & (F.col("categoria") == "ELECTRONICA")) \
        .select("ticketid", "codigo_ebs", "part_number", "description", "cantidad")
    wtk = tickets(t).select("ticketid", "fecha", "categoria", F.col("estado").alias("nivel1"))
    i1 = itm.join(wtk, "ticketid", "left").filter(F.col("fecha").isNotNull()).select(
        "ticketid", "fecha", F.col("description").alias("descripcion"), "categoria", "nivel1", "cantidad",
        "codigo_ebs", "part_number")
    i1 = ag.lag_same_key(i1, "ticketid", ["fecha", "descripcion", "cantidad", "codigo_ebs", "part_number"],
                         "fecha", "nueva_fecha")
    return i1.withColumn("validacion", F.col("fecha") != F.col("nueva_fecha")).drop("codigo_ebs", "part_number")


def items_per_ticket_month(t: Tables) -> DataFrame:
    i1 = items_by_ticket(t)
    return i1.groupBy("ticketid", F.date_trunc("month", "nueva_fecha").alias("fecha")) \
        .agg(F.sum("cantidad").alias("cantidad"))


ITEMS_BY_TICKET_SQL = (
    f"WITH w AS ({ITEMS_ENRICHED_SQL}), itm AS (SELECT ticketid, codigo_ebs, part_number, description, cantidad "
    "FROM w WHERE status IN ('INSTALADO') AND categoria = 'ELECTRONICA'), "
    "i1 AS (SELECT itm.ticketid, o_orderdate AS fecha, description AS descripcion, "
    "nullif(o_orderpriority, '5-LOW') AS categoria, o_orderstatus AS nivel1, cantidad, codigo_ebs, part_number "
    "FROM itm LEFT JOIN orders ON itm.ticketid = o_orderkey WHERE o_orderdate IS NOT NULL) "
    "SELECT ticketid, fecha, descripcion, categoria, nivel1, cantidad, nueva_fecha, fecha <> nueva_fecha AS validacion "
    "FROM (SELECT *, CASE WHEN row_number() OVER w > 1 THEN lag(fecha) OVER w ELSE fecha END AS nueva_fecha "
    "FROM i1 WINDOW w AS (PARTITION BY ticketid ORDER BY fecha, descripcion, cantidad, codigo_ebs, part_number))")


@register("q11_items_per_ticket_month", ids=("Q11", "F1", "J3", "W1", "W2", "A1", "D3"),
          sql=f"SELECT ticketid, date_trunc('month', nueva_fecha) AS fecha, sum(cantidad) AS cantidad "
              f"FROM ({ITEMS_BY_TICKET_SQL}) GROUP BY 1, 2")
def q11(t: Tables) -> DataFrame:
    return items_per_ticket_month(t)


# ---------------------------------------------------------------- Q12 ----


def materials(t: Tables) -> DataFrame:
    """md_00: material use log (upper-cased strings)."""
    l = t.lineitem
    md = l.select(
        F.col("l_orderkey").alias("ticketid"), F.col("l_shipdate").alias("fecha_uso"),
        F.concat(F.lit("u"), (F.col("l_suppkey") % 10).cast("string")).alias("usuario"),
        F.col("l_linestatus").alias("tipo_ticket"),
        F.concat(F.lit("E"), (F.col("l_partkey") % 100).cast("string")).alias("codigo_ebs"),
        F.when(F.col("l_returnflag") == "R", F.lit("electronica")).otherwise(F.lit("otra")).alias("categoria"),
        F.when(F.col("l_tax") < 0.02, F.lit("red")).when(F.col("l_linestatus") == "O", F.lit("core"))
        .otherwise(F.lit("buc")).alias("unidad_negocio"),
        F.when(F.col("l_discount") >= 0.09, F.lit("rechazado")).otherwise(F.lit("aprobado")).alias("estado"),
        F.col("l_quantity").alias("cantidad"),
        F.concat(F.lit("material de red numero "), F.col("l_partkey").cast("string"), F.lit(" para el sitio "),
                 F.col("l_suppkey").cast("string"), F.lit(" con descripcion larga")).alias("material"))
    return pc.map_strings(md, F.upper)


def power_codes(t: Tables) -> DataFrame:
    """codigos_pwr stand-in: EBS codes of small parts."""
    return t.part.filter(F.col("p_size") < 5).select(
        F.concat(F.lit("E"), (F.col("p_partkey") % 100).cast("string")).alias("codigo_ebs"))


def materials_filtered(t: Tables) -> DataFrame:
    md = jn.semi_or(materials(t), power_codes(t), "codigo_ebs", F.col("categoria") == "ELECTRONICA")
    md = md.filter((F.col("estado") != "RECHAZADO") & F.col("unidad_negocio").isin("CORE", "BUC"))
    return md.select("ticketid", "fecha_uso", "categoria", "usuario", "tipo_ticket", "unidad_negocio", "codigo_ebs",
                     tx.left("material", 55).alias("descripcion"), "cantidad")


def materials_month(t: Tables) -> DataFrame:
    """md_02: month totals per ticket and user, date repair by lag, re-aggregated."""
    md = materials_filtered(t)
    m1 = md.groupBy("ticketid", F.date_trunc("month", "fecha_uso").alias("fecha"), "usuario") \
        .agg(F.sum("cantidad").alias("cantidad"))
    m1 = ag.lag_same_key(m1, "ticketid", ["fecha", "usuario"], "fecha", "nueva_fecha")
    return m1.groupBy("ticketid", F.date_trunc("month", "nueva_fecha").alias("fecha"), "usuario") \
        .agg(F.sum("cantidad").alias("cantidad"))


MATERIALS_FILTERED_SQL = (
    "WITH md AS (SELECT l_orderkey AS ticketid, l_shipdate AS fecha_uso, upper('u' || CAST(l_suppkey % 10 AS VARCHAR)) "
    "AS usuario, l_linestatus AS tipo_ticket, 'E' || CAST(l_partkey % 100 AS VARCHAR) AS codigo_ebs, "
    "CASE WHEN l_returnflag = 'R' THEN 'ELECTRONICA' ELSE 'OTRA' END AS categoria, "
    "CASE WHEN l_tax < 0.02 THEN 'RED' WHEN l_linestatus = 'O' THEN 'CORE' ELSE 'BUC' END AS unidad_negocio, "
    "CASE WHEN l_discount >= 0.09 THEN 'RECHAZADO' ELSE 'APROBADO' END AS estado, l_quantity AS cantidad, "
    "upper('material de red numero ' || CAST(l_partkey AS VARCHAR) || ' para el sitio ' || CAST(l_suppkey AS VARCHAR) "
    "|| ' con descripcion larga') AS material FROM lineitem) "
    "SELECT ticketid, fecha_uso, categoria, usuario, tipo_ticket, unidad_negocio, codigo_ebs, "
    "substr(material, 1, 55) AS descripcion, cantidad FROM md WHERE (categoria = 'ELECTRONICA' OR codigo_ebs IN "
    "(SELECT 'E' || CAST(p_partkey % 100 AS VARCHAR) FROM part WHERE p_size < 5)) AND estado <> 'RECHAZADO' "
    "AND unidad_negocio IN ('CORE', 'BUC')")


@register("q12_materials_month", ids=("Q12", "F2", "J7", "A1", "A2", "W1", "S11"),
          sql=f"WITH m1 AS (SELECT ticketid, date_trunc('month', fecha_uso) AS fecha, usuario, sum(cantidad) AS cantidad "
              f"FROM ({MATERIALS_FILTERED_SQL}) GROUP BY 1, 2, 3), "
              "m2 AS (SELECT *, CASE WHEN row_number() OVER w > 1 THEN lag(fecha) OVER w ELSE fecha END AS nueva_fecha "
              "FROM m1 WINDOW w AS (PARTITION BY ticketid ORDER BY fecha, usuario)) "
              "SELECT ticketid, date_trunc('month', nueva_fecha) AS fecha, usuario, sum(cantidad) AS cantidad "
              "FROM m2 GROUP BY 1, 2, 3")
def q12(t: Tables) -> DataFrame:
    return materials_month(t)


_Q12B_ORDER = ["_src", "fecha", "fecha_uso", "descripcion", "cantidad", "categoria", "nivel1", "usuario",
               "tipo_ticket", "unidad_negocio", "codigo_ebs", "nueva_fecha", "validacion"]


@register("q12b_items_and_materials", ids=("Q12", "U1", "A8"),
          sql=f"WITH u AS (SELECT 0 AS _src, ticketid, fecha, descripcion, categoria, nivel1, cantidad, nueva_fecha, "
              f"validacion, NULL::TIMESTAMP AS fecha_uso, NULL::VARCHAR AS usuario, NULL::VARCHAR AS tipo_ticket, "
              f"NULL::VARCHAR AS unidad_negocio, NULL::VARCHAR AS codigo_ebs FROM ({ITEMS_BY_TICKET_SQL}) "
              f"UNION ALL SELECT 1, ticketid, NULL, descripcion, categoria, NULL, cantidad, NULL, NULL, fecha_uso, "
              f"usuario, tipo_ticket, unidad_negocio, codigo_ebs FROM ({MATERIALS_FILTERED_SQL})) "
              "SELECT * EXCLUDE (_src) FROM u QUALIFY row_number() OVER (PARTITION BY ticketid ORDER BY "
              + ", ".join(f"{c} NULLS FIRST" for c in _Q12B_ORDER) + ") = 1")
def q12b(t: Tables) -> DataFrame:
    u = fr.bind_rows(items_by_ticket(t).withColumn("_src", F.lit(0)),
                     materials_filtered(t).withColumn("_src", F.lit(1)))
    return fr.first_per_key(u, ["ticketid"], _Q12B_ORDER).drop("_src")
