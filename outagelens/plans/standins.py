"""Domain tables derived from the shared test tables.

Each stand-in exists twice: as a Spark builder and as the equivalent SQL text
for the DuckDB oracle.  They are plain projections/filters of the input
tables, so their size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Tables


def _coord(key, base, mul, mod):
    return (F.lit(base) + ((F.col(key) * mul) % mod).cast("double") / 1000.0).cast("double")


def origin_sites(t: Tables) -> DataFrame:
    """Customers as origin sites with synthetic coordinates."""
    return t.customer.select(
        F.col("c_custkey").alias("siteid"), F.col("c_name").alias("sitename"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("segment"),
        _coord("c_custkey", 13.7, 7919, 4000).alias("lat"),
        _coord("c_custkey", -92.2, 104729, 3900).alias("lon"))


ORIGIN_SITES_SQL = """
SELECT c_custkey AS siteid, c_name AS sitename, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS segment,
       CAST(13.7 + ((c_custkey * 7919) % 4000) / 1000.0 AS DOUBLE) AS lat,
       CAST(-92.2 + ((c_custkey * 104729) % 3900) / 1000.0 AS DOUBLE) AS lon
FROM customer"""


def affected_sites(t: Tables) -> DataFrame:
    """Suppliers as affected sites with synthetic coordinates."""
    return t.supplier.select(
        F.col("s_suppkey").alias("siteid"), F.col("s_name").alias("sitename"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"),
        _coord("s_suppkey", 13.7, 6151, 4000).alias("lat"),
        _coord("s_suppkey", -92.2, 3571, 3900).alias("lon"))


AFFECTED_SITES_SQL = """
SELECT s_suppkey AS siteid, s_name AS sitename, s_nationkey AS nationkey, s_acctbal AS acctbal,
       CAST(13.7 + ((s_suppkey * 6151) % 4000) / 1000.0 AS DOUBLE) AS lat,
       CAST(-92.2 + ((s_suppkey * 3571) % 3900) / 1000.0 AS DOUBLE) AS lon
FROM supplier"""


def outages(t: Tables) -> DataFrame:
    """Outage log: events of type 'error'; start = ts, end = ts + value minutes."""
    e = t.events.filter(F.col("event_type") == "error")
    secs = F.round(F.col("value") * 60).cast("long")
    return e.select(
        F.col("event_id").alias("outage_id"), F.col("user_id").alias("siteid"),
        F.col("ts").alias("inicio"), F.timestamp_add("SECOND", secs, F.col("ts")).alias("fin"),
        F.col("value").alias("minutos"))


OUTAGES_SQL = """
SELECT event_id AS outage_id, user_id AS siteid, ts AS inicio,
       ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS fin, value AS minutos
FROM events WHERE event_type = 'error'"""


def sensor(t: Tables, sensor_type: str = "view") -> DataFrame:
    """Fuel-sensor log: events of one type are the readings of a site."""
    return t.events.filter(F.col("event_type") == sensor_type).select(
        F.col("event_id").alias("reading_id"), F.col("user_id").alias("siteid"),
        F.col("ts").alias("fecha_hora"), F.col("value").alias("valor"))


SENSOR_SQL = """
SELECT event_id AS reading_id, user_id AS siteid, ts AS fecha_hora, value AS valor
FROM events WHERE event_type = 'view'"""


def battery_log(t: Tables) -> DataFrame:
    """Battery/root-cause log: 'purchase' events; on-battery hours from value."""
    e = t.events.filter(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("battery_id"), F.col("user_id").alias("siteid"),
        F.col("ts").alias("occurred_on"), (F.col("value") / 100.0).alias("running_on_battery"),
        (F.col("value") / 60.0).alias("power_cut"))


BATTERY_SQL = """
SELECT event_id AS battery_id, user_id AS siteid, ts AS occurred_on,
       value / 100.0 AS running_on_battery, value / 60.0 AS power_cut
FROM events WHERE event_type = 'purchase'"""


def cte(**parts: str) -> str:
    """WITH clause from named SQL snippets."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"


# ----------------------------------------------------- site codes (Q2-Q5) --
# Sites of the ticket ETL are customers, coded "<first 3 letters of segment>-<key>"
# so a 3-character prefix lookup (J12) has something to find.


def site_code(segment, key):
    return F.concat(F.substring(segment, 1, 3), F.lit("-"), key.cast("string"))


def site_code_sql(segment: str, key: str) -> str:
    return f"(substr({segment}, 1, 3) || '-' || CAST({key} AS VARCHAR))"


def coord_sql(key: str, base: float, mul: int, mod: int) -> str:
    return f"CAST({base} + (({key} * {mul}) % {mod}) / 1000.0 AS DOUBLE)"


def coord(key: str, base: float, mul: int, mod: int):
    return _coord(key, base, mul, mod)
