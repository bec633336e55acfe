"""Queries for scalar functions and projection helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dx
from ..functions import mathx as mx
from ..functions import nulls as nx
from ..functions import text as tx
from ..operators import columns as pc
from ..operators.frames import row_ids
from ..sources.tables import Tables
from . import sqlparts as sq
from .registry import register

# ------------------------------------------------------------ strings C --


@register("c01_upper", ids=("C1",), sql="SELECT doc_id, upper(lang) AS lang_u, upper(source) AS source_u, "
          "replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß') AS text_u FROM documents")
def c01(t: Tables) -> DataFrame:
    d = t.documents
    return d.select("doc_id", tx.upper("lang").alias("lang_u"), tx.upper("source").alias("source_u"),
                    tx.upper_keep_sharp_s("text").alias("text_u"))


@register("c02_trim_ws", ids=("C2",),
          sql=f"SELECT doc_id, {sq.trim_ws('text')} AS text_trim FROM documents")
def c02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.trim_ws("text").alias("text_trim"))


@register("c03_squish", ids=("C3",), sql=f"SELECT doc_id, {sq.squish('text')} AS text_squish FROM documents")
def c03(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.squish("text").alias("text_squish"))


@register("c04_ascii_fold", ids=("C4",),
          sql=f"SELECT doc_id, lang, {sq.ascii_fold('text')} AS text_ascii FROM documents")
def c04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", tx.ascii_fold("text").alias("text_ascii"))


@register("c05_strip_prefix", ids=("C5",),
          sql="SELECT doc_id, regexp_replace(text, '^[A-Z][a-z]+ ', '', 'g') AS text_rest FROM documents")
def c05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_prefix("text", "^[A-Z][a-z]+ ").alias("text_rest"))


@register("c06_remove_punct", ids=("C6",),
          sql="SELECT doc_id, regexp_replace(text, '\\p{P}', '', 'g') AS text_nopunct FROM documents")
def c06(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.remove_punct("text").alias("text_nopunct"))


@register("c07_snake_words", ids=("C7",),
          sql=f"SELECT p_partkey, regexp_replace({sq.squish('p_name || chr(9) || p_type')}, '{sq.WS}+', '_', 'g') "
              "AS name_key FROM part")
def c07(t: Tables) -> DataFrame:
    p = t.part
    return p.select("p_partkey", tx.snake_words(F.concat("p_name", F.lit("\t"), "p_type")).alias("name_key"))


@register("c08_left", ids=("C8",),
          sql="SELECT c_custkey, substr(c_name, 1, 3) AS prefix3, substr(c_mktsegment, 1, 1) AS seg1 FROM customer")
def c08(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.left("c_name", 3).alias("prefix3"),
                             tx.left("c_mktsegment", 1).alias("seg1"))


@register("c09_extract_first", ids=("C9",),
          sql="SELECT doc_id, nullif(regexp_extract(text, '(?i)(license|password|secret|key)', 0), '') AS hit "
              "FROM documents")
def c09(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.extract_first("text", "(?i)(license|password|secret|key)").alias("hit"))


@register("c11_count_with_pct", ids=("C11", "A5"),
          sql="SELECT lang, count(*) AS n, "
              "CAST(count(*) AS VARCHAR) || ' (' || printf('%.1f', "
              + sq.rnd("100.0 * count(*) / sum(count(*)) OVER ()", 1) + ") || '%)' AS label "
              "FROM documents GROUP BY lang")
def c11(t: Tables) -> DataFrame:
    d = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = t.documents.agg(F.count(F.lit(1))).scalar()  # scalar subquery, one value
    pct = mx.rnd(F.col("n") * 100.0 / total, 1)
    return (d
            .select("lang", "n", tx.count_with_pct("n", F.concat(F.format_string("%.1f", pct), F.lit("%")))
                    .alias("label")))


@register("c13_percent_format", ids=("C13",),
          sql="SELECT toxic, printf('%.2f%%', " + sq.rnd("avg(quality) * 100", 2) + ") AS quality_rate, "
              "count(*) AS n FROM labels GROUP BY toxic")
def c13(t: Tables) -> DataFrame:
    return (t.labels.groupBy("toxic")
            .agg(F.format_string("%.2f%%", mx.rnd(F.avg("quality") * 100, 2)).alias("quality_rate"),
                 F.count(F.lit(1)).alias("n")))


# -------------------------------------------------------------- dates D --

_TS_TEXT_SQL = ("CASE WHEN o_orderkey % 11 = 0 THEN 'OTRO' "
                "ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END")


@register("d01_parse_timestamp", ids=("D1",),
          sql=f"SELECT o_orderkey, try_strptime({_TS_TEXT_SQL}, '%Y-%m-%d %H:%M:%S') AS fecha FROM orders")
def d01(t: Tables) -> DataFrame:
    o = t.orders
    txt = F.when(F.col("o_orderkey") % 11 == 0, F.lit("OTRO")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", F.to_timestamp_ntz(dx.parse_ymd_hms(txt)).alias("fecha"))


@register("d02_first_of_month", ids=("D2",),
          sql="SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), 1, 0, 0, 0) AS periodo "
              "FROM orders")
def d02(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", dx.first_of_month(F.year("o_orderdate"), F.month("o_orderdate")).alias("periodo"))


@register("d03_floor_month", ids=("D3",),
          sql="SELECT event_id, date_trunc('month', ts) AS mes_inicio FROM events")
def d03(t: Tables) -> DataFrame:
    return t.events.select("event_id", dx.floor_month("ts").alias("mes_inicio"))


@register("d04_date_parts", ids=("D4",),
          sql="SELECT event_id, CAST(day(ts) AS BIGINT) AS dia, CAST(month(ts) AS BIGINT) AS mes, "
              "CAST(year(ts) AS BIGINT) AS ano, CAST(hour(ts) AS BIGINT) AS hora FROM events")
def d04(t: Tables) -> DataFrame:
    parts = dx.parts("ts")
    return t.events.select("event_id", *[c.cast("long").alias(n) for n, c in parts.items()])


_MESES_SQL = "[" + ", ".join(f"'{m}'" for m in dx.MESES) + "]"


@register("d05_month_name", ids=("D5",),
          sql=f"SELECT o_orderkey, monthname(o_orderdate) AS month_en, "
              f"{_MESES_SQL}[month(o_orderdate)] AS mes_es FROM orders")
def d05(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", dx.month_name("o_orderdate").alias("month_en"),
                    dx.month_name("o_orderdate", spanish=True).alias("mes_es"))


@register("d06_unit_conversion", ids=("D6",),
          sql="SELECT event_id, value * 60 AS minutos, value / 720 AS por_hora FROM events")
def d06(t: Tables) -> DataFrame:
    return t.events.select("event_id", dx.hours_to_minutes("value").alias("minutos"),
                           dx.monthly_to_hourly("value").alias("por_hora"))


@register("d07_duration_identity", ids=("D7",),
          sql="WITH o AS (SELECT event_id, ts AS inicio, ts + to_seconds(CAST(round(value * 60) AS BIGINT)) AS fin, "
              "value FROM events) "
              "SELECT event_id, date_diff('second', inicio, fin) AS secs, "
              "date_diff('second', inicio, fin) = CAST(round(value * 60) AS BIGINT) AS consistent FROM o")
def d07(t: Tables) -> DataFrame:
    e = t.events
    length = F.round(F.col("value") * 60).cast("long")
    o = e.select("event_id", "value", F.col("ts").alias("inicio"), F.timestamp_add("SECOND", length, F.col("ts")).alias("fin"))
    secs = dx.seconds_between("inicio", "fin")
    return o.select("event_id", secs.alias("secs"), (secs == length).alias("consistent"))


# --------------------------------------------------------------- math M --


@register("m01_log_shift", ids=("M1",),
          sql="SELECT event_id, " + sq.rnd("ln(value + 1)", 9) + " AS log1, " + sq.rnd("ln(value + 2)", 9)
              + " AS log2 FROM events")
def m01(t: Tables) -> DataFrame:
    e = t.events
    return e.select("event_id", mx.rnd(mx.log_shift("value"), 9).alias("log1"),
                    mx.rnd(mx.log_shift("value", 2.0), 9).alias("log2"))


@register("m02_log10_positive", ids=("M2",),
          sql="SELECT o_orderkey, CASE WHEN o_totalprice - 100000 > 0 THEN "
              + sq.rnd("log10(o_totalprice - 100000)", 9) + " END AS lg FROM orders")
def m02(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", mx.rnd(mx.log10_pos(F.col("o_totalprice") - 100000), 9).alias("lg"))


@register("m03_round_modes", ids=("M3",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 1) AS half_even, "
              "round(l_quantity / 4, 1) AS half_up FROM lineitem")
def m03(t: Tables) -> DataFrame:
    l = t.lineitem
    q = F.col("l_quantity") / 4
    return l.select("l_orderkey", "l_linenumber", "l_partkey", mx.round_half_even(q, 1).alias("half_even"),
                    F.round(q, 1).alias("half_up"))


@register("m04_product_na", ids=("M4",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, "
              "l_quantity * (CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END) AS costo "
              "FROM lineitem")
def m04(t: Tables) -> DataFrame:
    l = t.lineitem
    price = F.when(F.col("l_linenumber") % 5 == 0, F.lit(None)).otherwise(F.col("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * price).alias("costo"))


@register("m05_haversine", ids=("M5",),
          sql="WITH c AS (SELECT c_custkey, CAST(13.7 + ((c_custkey * 7919) % 4000) / 1000.0 AS DOUBLE) AS lat, "
              "CAST(-92.2 + ((c_custkey * 104729) % 3900) / 1000.0 AS DOUBLE) AS lon FROM customer), "
              "s AS (SELECT s_suppkey, CAST(13.7 + ((s_suppkey * 6151) % 4000) / 1000.0 AS DOUBLE) AS lat, "
              "CAST(-92.2 + ((s_suppkey * 3571) % 3900) / 1000.0 AS DOUBLE) AS lon FROM supplier) "
              "SELECT l_orderkey, l_linenumber, c_custkey, s_suppkey, "
              + sq.rnd(mx.haversine_sql("c.lat", "c.lon", "s.lat", "s.lon"), 6)
              + " AS km FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey "
              "JOIN s ON l_suppkey = s_suppkey")
def m05(t: Tables) -> DataFrame:
    """Distance from a ticket's origin site to each site it affects."""
    from .standins import affected_sites, origin_sites
    c = origin_sites(t).select(F.col("siteid").alias("c_custkey"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    s = affected_sites(t).select(F.col("siteid").alias("s_suppkey"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    origin = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "clat", "clon")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return (lines.join(origin, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey",
                    mx.rnd(mx.haversine_km("clat", "clon", "slat", "slon"), 6).alias("km")))


@register("m06_location_spread", ids=("M6",),
          sql="SELECT l_returnflag, " + sq.rnd("avg(l_extendedprice)") + " AS mean, "
              + sq.rnd("median(l_extendedprice)") + " AS median, "
              + sq.rnd("quantile_cont(l_extendedprice, 0.25)") + " AS q1, "
              + sq.rnd("quantile_cont(l_extendedprice, 0.75)") + " AS q3, "
              + sq.rnd("quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)")
              + " AS iqr FROM lineitem GROUP BY l_returnflag")
def m06(t: Tables) -> DataFrame:
    from ..operators.quantiles import quantile_columns
    l = t.lineitem
    qs = quantile_columns(l, "l_extendedprice", {"median": 0.5, "q1": 0.25, "q3": 0.75}, by=["l_returnflag"])
    mean = l.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"))
    return mean.join(qs, "l_returnflag").select(
        "l_returnflag", mx.rnd("mean").alias("mean"), mx.rnd("median").alias("median"), mx.rnd("q1").alias("q1"),
        mx.rnd("q3").alias("q3"), mx.rnd(F.col("q3") - F.col("q1")).alias("iqr"))


# ---------------------------------------------------- conditional / N ----

_FLAG_NULL = "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag END"


def _flag_null(l):
    return F.when(F.col("l_linenumber") % 5 == 0, F.lit(None)).otherwise(F.col("l_returnflag"))


@register("n01_case_when", ids=("N1",),
          sql=f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ({_FLAG_NULL}) = 'A' THEN 'aceptado' "
              f"WHEN ({_FLAG_NULL}) = 'R' THEN 'retorno' ELSE 'otro' END AS clase FROM lineitem")
def n01(t: Tables) -> DataFrame:
    l = t.lineitem
    f = _flag_null(l)
    return l.select("l_orderkey", "l_linenumber", "l_partkey",
                    nx.case_when((f == "A", "aceptado"), (f == "R", "retorno"), default="otro").alias("clase"))


@register("n02_if_else", ids=("N2",),
          sql=f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ({_FLAG_NULL}) = 'A' THEN 'down' "
              f"WHEN NOT (({_FLAG_NULL}) = 'A') THEN 'up' END AS status FROM lineitem")
def n02(t: Tables) -> DataFrame:
    l = t.lineitem
    return l.select("l_orderkey", "l_linenumber", "l_partkey",
                    nx.if_else(_flag_null(l) == "A", "down", "up").alias("status"))


@register("n03_coalesce", ids=("N3",),
          sql="SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, "
              "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END, 'SIN_NOMBRE') AS nombre FROM customer")
def n03(t: Tables) -> DataFrame:
    c = t.customer
    a = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_name"))
    b = F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", F.coalesce(a, b, F.lit("SIN_NOMBRE")).alias("nombre"))


@register("n04_replace_na", ids=("N4",),
          sql="SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END, 0.0) AS saldo, "
              "coalesce(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END, 'F') AS categoria FROM customer")
def n04(t: Tables) -> DataFrame:
    c = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("saldo"),
        F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("categoria"))
    return c.fillna({"saldo": 0.0, "categoria": "F"})


@register("n05_na_if", ids=("N5",),
          sql="SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS prioridad FROM orders")
def n05(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("prioridad"))


_RECODE = {"F": "cerrado", "O": "abierto"}


@register("n06_recode", ids=("N6",),
          sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cerrado' WHEN 'O' THEN 'abierto' END AS estado, "
              "CASE o_orderstatus WHEN 'F' THEN 'cerrado' WHEN 'O' THEN 'abierto' ELSE o_orderstatus END "
              "AS estado_keep FROM orders")
def n06(t: Tables) -> DataFrame:
    o = t.orders
    return o.select("o_orderkey", nx.recode("o_orderstatus", _RECODE).alias("estado"),
                    nx.recode_keep("o_orderstatus", _RECODE).alias("estado_keep"))


@register("n07_try_cast", ids=("N7",),
          sql="SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 9 = 0 THEN 'OTRO' ELSE CAST(p_size AS VARCHAR) END "
              "AS INTEGER) AS tanque FROM part")
def n07(t: Tables) -> DataFrame:
    p = t.part
    txt = F.when(F.col("p_partkey") % 9 == 0, F.lit("OTRO")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", nx.parse_int(txt).alias("tanque"))


@register("n08_factor_levels", ids=("N8", "E15"),
          sql="SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS nivel "
              "FROM orders")
def n08(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", nx.level_index("o_orderstatus", ["P", "O", "F"]).alias("nivel"))


# ---------------------------------------------------------- projections P --


@register("p01_select_rename", ids=("P1",),
          sql="SELECT o_orderkey AS ticketid, o_orderdate AS fecha, o_orderpriority AS prioridad FROM orders")
def p01(t: Tables) -> DataFrame:
    return pc.select_renamed(t.orders, {"ticketid": "o_orderkey", "fecha": "o_orderdate",
                                        "prioridad": "o_orderpriority"})


@register("p02_drop", ids=("P2",),
          sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, "
              "l_linestatus, l_shipdate FROM lineitem")
def p02(t: Tables) -> DataFrame:
    return pc.drop_cols(t.lineitem, "l_discount", "l_tax")


@register("p03_column_range", ids=("P3",),
          sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate "
              "FROM lineitem")
def p03(t: Tables) -> DataFrame:
    return pc.drop_range(t.lineitem, "l_quantity", "l_tax")


@register("p04_everything", ids=("P4",),
          sql="SELECT o_orderpriority, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def p04(t: Tables) -> DataFrame:
    return pc.everything_after(t.orders, ["o_orderpriority"])


@register("p05_select_numeric", ids=("P5",),
          sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p05(t: Tables) -> DataFrame:
    return pc.select_type(t.orders, "numeric")


@register("p06_rename_with", ids=("P6",),
          sql="SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, "
              "c_mktsegment AS mktsegment FROM customer")
def p06(t: Tables) -> DataFrame:
    return pc.rename_with(t.customer, lambda c: c[2:])


@register("p07_relocate", ids=("P7",), sql="SELECT * FROM supplier")
def p07(t: Tables) -> DataFrame:
    return pc.relocate(t.supplier, ["s_acctbal"], after="s_suppkey")


@register("p08_clean_names", ids=("P8", "S7"),
          sql="SELECT r_regionkey AS r_region_key, r_name AS region_name_x FROM region")
def p08(t: Tables) -> DataFrame:
    from ..functions.names import clean_columns
    return clean_columns(t.region.toDF("R RegionKey", "Region Name (x)"))


@register("p09_mutate_unused", ids=("P9",),
          sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS neto, "
              "l_quantity, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def p09(t: Tables) -> DataFrame:
    return pc.mutate_unused(t.lineitem, {"neto": F.col("l_extendedprice") * (1 - F.col("l_discount"))},
                            used=["l_extendedprice", "l_discount"])


@register("p10_across_strings", ids=("P10", "Q1", "C1", "C2", "C4"),
          sql=f"SELECT c_custkey, {sq.clean_text('lower(c_name)')} AS c_name, c_nationkey, c_acctbal, "
              f"{sq.clean_text('lower(c_mktsegment)')} AS c_mktsegment FROM customer")
def p10(t: Tables) -> DataFrame:
    c = t.customer.withColumns({"c_name": F.lower("c_name"), "c_mktsegment": F.lower("c_mktsegment")})
    return pc.map_strings(c, tx.clean_text)


@register("p11_row_id", ids=("P11",),
          sql="SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders")
def p11(t: Tables) -> DataFrame:
    return row_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "id") \
        .select("id", "o_orderkey")


@register("p12_unite", ids=("P12",),
          sql="SELECT o_orderkey, coalesce(o_orderstatus, 'NA') || ': ' || "
              "coalesce(nullif(o_orderpriority, '5-LOW'), 'NA') AS nombre FROM orders")
def p12(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus",
                        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return pc.unite(o, "nombre", ["o_orderstatus", "o_orderpriority"], sep=": ")


@register("p13_unnest_list", ids=("P13",),
          sql="SELECT vec_id, pos, " + sq.rnd("CAST(v AS DOUBLE)", 4) + " AS v FROM (SELECT vec_id, "
              "unnest(generate_series(1, 4)) AS pos, unnest(embedding[1:4]) AS v FROM embeddings)")
def p13(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("p", "v"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"),
                    mx.rnd(F.col("v").cast("double"), 4).alias("v"))


@register("p14_name_helpers", ids=("P14",),
          sql="SELECT l_orderkey, l_linenumber, l_linestatus, l_extendedprice FROM lineitem")
def p14(t: Tables) -> DataFrame:
    l = t.lineitem
    keep = pc.matching(l, starts_with="l_l") + pc.matching(l, contains="extended") + ["l_orderkey"]
    return l.select(*keep)
