"""Outage modelling table: site attributes, outage log, fuel at outage,
repeated outages - Q14-Q17 (SURVEY 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dx
from ..functions.names import clean_columns
from ..functions.nulls import case_when, if_else, level_index, parse_int, recode_keep
from ..operators import columns as pc
from ..operators import frames as fr
from ..operators import joins as jn
from ..operators import reshape as rs
from ..sources.tables import Tables
from . import standins as si
from .registry import register

# Battery type codes (plomo = 1, litio = 0).
BATTERY_CODES = {"PLOMO": "1", "LITIO": "0"}
# Stand-in values of our own: per-site tank fixes (site -> tank when missing / when "OTRO").
TANK_FIXES_NULL = {33: "150", 77: "160"}
TANK_FIXES_OTRO = {26: "165"}
STATUS_LEVELS = ["down", "up"]
ATTRIBUTE_NAMES = ["periodicidad_mg", "capacidad_tanque_motor", "motor_generador", "tipo_motor", "tipo_bateria"]


# ---------------------------------------------------------------- Q14 ----


def site_attributes_eav(t: Tables) -> DataFrame:
    """atributos.csv stand-in in entity-attribute-value form (siteid, name, value)."""
    p = t.part
    wide = p.select(
        F.col("p_partkey").alias("cilocation"),
        ((F.col("p_size") % 12) + 1).cast("string").alias("periodicidad_mg"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 13 == 0, F.lit("OTRO"))
        .otherwise((F.col("p_size") * 5).cast("string")).alias("capacidad_tanque_motor"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("NO")).otherwise(F.lit("SI")).alias("motor_generador"),
        F.col("p_brand").alias("tipo_motor"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("PLOMO")).when(F.col("p_type") == "SMALL", F.lit("LITIO"))
        .otherwise(F.col("p_type")).alias("tipo_bateria"))
    return wide.unpivot(["cilocation"], ATTRIBUTE_NAMES, "name", "value").filter(F.col("value").isNotNull())


EAV_SQL = (
    "SELECT cilocation, name, value FROM (SELECT p_partkey AS cilocation, "
    "CAST(p_size % 12 + 1 AS VARCHAR) AS periodicidad_mg, "
    "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'OTRO' ELSE CAST(p_size * 5 AS VARCHAR) END "
    "AS capacidad_tanque_motor, CASE WHEN p_partkey % 4 = 0 THEN 'NO' ELSE 'SI' END AS motor_generador, "
    "p_brand AS tipo_motor, CASE WHEN p_type = 'ECONOMY' THEN 'PLOMO' WHEN p_type = 'SMALL' THEN 'LITIO' "
    "ELSE p_type END AS tipo_bateria FROM part) UNPIVOT (value FOR name IN ("
    + ", ".join(ATTRIBUTE_NAMES) + "))")


def tank_batteries(t: Tables) -> DataFrame:
    """tanque_baterias: pivot, clean names, generator sites only, recode, fixes, parse."""
    w = rs.pivot_wider(site_attributes_eav(t), ["cilocation"], "name", "value", ATTRIBUTE_NAMES)
    w = clean_columns(w).withColumnsRenamed({"cilocation": "siteid", "periodicidad_mg": "mtto",
                                             "capacidad_tanque_motor": "tanque"})
    w = w.filter(F.col("motor_generador") == "SI").drop("motor_generador", "tipo_motor")
    tq, sid = F.col("tanque"), F.col("siteid")
    fixes = [((sid == k) & tq.isNull(), v) for k, v in TANK_FIXES_NULL.items()] + \
            [((sid == k) & (tq == "OTRO"), v) for k, v in TANK_FIXES_OTRO.items()]
    w = w.withColumns({"tipo_bateria": recode_keep("tipo_bateria", BATTERY_CODES),
                       "tanque": case_when(*fixes, default=tq)})
    return w.withColumn("tanque", parse_int("tanque"))


TANK_SQL = (
    f"WITH eav AS ({EAV_SQL}), w AS (SELECT cilocation AS siteid, "
    + ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {n}" for n in ATTRIBUTE_NAMES)
    + " FROM eav GROUP BY cilocation) SELECT siteid, periodicidad_mg AS mtto, "
    "TRY_CAST(CASE " + " ".join(f"WHEN siteid = {k} AND capacidad_tanque_motor IS NULL THEN '{v}'"
                                for k, v in TANK_FIXES_NULL.items())
    + " " + " ".join(f"WHEN siteid = {k} AND capacidad_tanque_motor = 'OTRO' THEN '{v}'"
                     for k, v in TANK_FIXES_OTRO.items())
    + " ELSE capacidad_tanque_motor END AS INTEGER) AS tanque, "
    "CASE tipo_bateria " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BATTERY_CODES.items())
    + " ELSE tipo_bateria END AS tipo_bateria FROM w WHERE motor_generador = 'SI'")


@register("q14_tank_batteries", ids=("Q14", "U3", "P8", "F1", "N6", "N1", "N7"), sql=TANK_SQL)
def q14(t: Tables) -> DataFrame:
    return tank_batteries(t)


# ---------------------------------------------------------------- Q15 ----


def outage_log(t: Tables) -> DataFrame:
    """mg.csv stand-in from the outage stand-in (hours, flags).  Whether a site
    goes down follows the outage's length with a spread of half an hour either
    way, and the generator runs for a share of it, so no feature decides the
    label and none follows from another."""
    o = si.outages(t)
    spread = F.col("minutos") + (F.col("outage_id") * 7919) % 61 - 30
    affected = (F.when(F.col("outage_id") % 17 == 0, F.lit(None)).when(spread > 100, F.lit(2))
                .when(spread > 30, F.lit(1)).otherwise(F.lit(0)))
    return o.select(
        "outage_id", "siteid", F.col("inicio").alias("inicio_powercut"), F.col("fin").alias("fin_powercut"),
        (F.col("minutos") / 60).alias("duracion_powercut"), affected.cast("string").alias("status"),
        (F.col("outage_id") % 2).cast("string").alias("arranco_mg"),
        (F.col("minutos") / 60 * (((F.col("outage_id") * 31) % 13 + 2) / F.lit(17.0))).alias("duracion_con_mg"))


def outage_features(t: Tables) -> DataFrame:
    """mg_clean: label, minutes, day/month/year, factor code of the label."""
    m = outage_log(t)
    m = pc.map_columns(m, pc.col_range(m, "status", "arranco_mg"), parse_int)
    parts = dx.parts("inicio_powercut")
    m = pc.mutate_unused(m, {
        "status": if_else(F.col("status") >= 1, "down", "up"),
        "sin_energia": dx.hours_to_minutes("duracion_powercut"),
        "mg_trabajando": dx.hours_to_minutes("duracion_con_mg"),
        "dia": parts["dia"].cast("long"), "mes": parts["mes"].cast("long"), "ano": parts["ano"].cast("long"),
    }, used=["duracion_powercut", "duracion_con_mg"])
    m = m.withColumn("status_level", level_index("status", STATUS_LEVELS).cast("long"))
    return pc.relocate(m, ["status", "arranco_mg", "inicio_powercut", "fin_powercut", "dia", "mes", "ano",
                           "sin_energia", "mg_trabajando", "siteid"])


OUTAGE_FEATURES_SQL = (
    f"WITH o AS ({si.OUTAGES_SQL}), m AS (SELECT outage_id, siteid, inicio AS inicio_powercut, fin AS fin_powercut, "
    "minutos / 60 AS duracion_powercut, CASE WHEN outage_id % 17 = 0 THEN NULL "
    "WHEN minutos + (outage_id * 7919) % 61 - 30 > 100 THEN 2 WHEN minutos + (outage_id * 7919) % 61 - 30 > 30 THEN 1 "
    "ELSE 0 END AS status, CAST(outage_id % 2 AS INTEGER) AS arranco_mg, "
    "minutos / 60 * (((outage_id * 31) % 13 + 2) / 17.0) AS duracion_con_mg FROM o) "
    "SELECT CASE WHEN status >= 1 THEN 'down' WHEN NOT (status >= 1) THEN 'up' END AS status, arranco_mg, "
    "inicio_powercut, fin_powercut, CAST(day(inicio_powercut) AS BIGINT) AS dia, "
    "CAST(month(inicio_powercut) AS BIGINT) AS mes, CAST(year(inicio_powercut) AS BIGINT) AS ano, "
    "duracion_powercut * 60 AS sin_energia, duracion_con_mg * 60 AS mg_trabajando, siteid, outage_id, "
    "CAST(CASE WHEN status >= 1 THEN 0 WHEN NOT (status >= 1) THEN 1 END AS BIGINT) AS status_level FROM m")


@register("q15_outage_features", ids=("Q15", "N2", "D6", "D1", "D4", "N8", "P3", "P7", "P9", "P10", "N7"),
          sql=OUTAGE_FEATURES_SQL)
def q15(t: Tables) -> DataFrame:
    return outage_features(t)


# ---------------------------------------------------------------- Q16 ----


def fuel_at_outage(t: Tables) -> DataFrame:
    """galonaje: max fuel reading inside each outage."""
    m = si.outages(t).select("siteid", F.col("inicio").alias("inicio_powercut"), F.col("fin").alias("fin_powercut"))
    return jn.interval_max(m, si.sensor(t), ["siteid", "inicio_powercut", "fin_powercut"], "siteid",
                           "inicio_powercut", "fin_powercut", "fecha_hora", "valor", "galonaje")


def outage_model_table(t: Tables) -> DataFrame:
    """mg: features with fuel and site attributes, numeric columns plus label."""
    m = outage_features(t).join(fuel_at_outage(t), ["siteid", "inicio_powercut", "fin_powercut"], "inner")
    m = m.filter(F.col("galonaje") > 0)
    m = m.join(tank_batteries(t).select("siteid", "tanque"), "siteid", "left")
    return pc.select_type(m, "numeric", keep=["status"])


@register("q16_outage_model_table", ids=("Q16", "J9", "J2", "J3", "F1", "P5"),
          sql=f"WITH f AS ({OUTAGE_FEATURES_SQL}), s AS ({si.SENSOR_SQL}), "
              "g AS (SELECT f.siteid, f.inicio_powercut, f.fin_powercut, max(s.valor) AS galonaje FROM f JOIN s "
              "ON f.siteid = s.siteid AND s.fecha_hora BETWEEN f.inicio_powercut AND f.fin_powercut "
              "GROUP BY 1, 2, 3), "
              f"tk AS ({TANK_SQL}) "
              "SELECT f.status, f.siteid, f.arranco_mg, f.dia, f.mes, f.ano, f.sin_energia, f.mg_trabajando, "
              "f.outage_id, f.status_level, g.galonaje, tk.tanque FROM f JOIN g ON f.siteid = g.siteid "
              "AND f.inicio_powercut = g.inicio_powercut AND f.fin_powercut = g.fin_powercut "
              "LEFT JOIN tk ON f.siteid = tk.siteid WHERE g.galonaje > 0")
def q16(t: Tables) -> DataFrame:
    return outage_model_table(t)


# ---------------------------------------------------------------- Q17 ----


@register("q17_repeated_outages", ids=("Q17", "A9", "D4", "F1"),
          sql=f"WITH o AS ({si.OUTAGES_SQL}) SELECT outage_id, siteid, inicio, CAST(inicio AS DATE) AS dia, "
              "count(*) OVER (PARTITION BY siteid, CAST(inicio AS DATE)) AS dupe_count FROM o QUALIFY dupe_count > 1")
def q17(t: Tables) -> DataFrame:
    o = si.outages(t).select("outage_id", "siteid", "inicio", F.to_date("inicio").alias("dia"))
    return fr.dupes(o, ["siteid", "dia"])
