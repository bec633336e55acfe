"""Splits, balancing and recipe-step queries on the
outage modelling frame: outage features + site tank attributes, label
``status`` (down/up), key ``outage_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_sql
from ..functions.mathx import rnd
from ..operators import recipes as rc
from ..operators import resample as rsm
from ..sources.tables import Tables
from . import sqlparts as sq
from .etl_outages import OUTAGE_FEATURES_SQL, TANK_SQL, outage_features, tank_batteries
from .registry import register

LABEL, KEY = "status", "outage_id"
LEVELS = ["down", "up"]
NUMERIC = ["sin_energia", "mg_trabajando"]


def model_frame(t: Tables) -> DataFrame:
    f = outage_features(t).filter(F.col("status").isNotNull())
    tk = tank_batteries(t).select("siteid", F.col("tanque").cast("string").alias("tanque"), "mtto", "tipo_bateria")
    return f.join(tk, "siteid", "left").select(KEY, LABEL, "siteid", "arranco_mg", "dia", "mes", *NUMERIC,
                                               "tanque", "mtto", "tipo_bateria")


MODEL_SQL = (f"WITH f AS ({OUTAGE_FEATURES_SQL}), tk AS ({TANK_SQL}), "
             "mf AS (SELECT f.outage_id, f.status, f.siteid, f.arranco_mg, f.dia, f.mes, f.sin_energia, "
             "f.mg_trabajando, CAST(tk.tanque AS VARCHAR) AS tanque, tk.mtto, tk.tipo_bateria FROM f LEFT JOIN tk "
             "ON f.siteid = tk.siteid WHERE f.status IS NOT NULL) ")


def _split_sql(src: str, seed, prop: float, col: str, names=("training", "testing")) -> str:
    u = uniform_sql(seed, "outage_id")
    return (f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY status ORDER BY {u}, outage_id) <= "
            f"floor(count(*) OVER (PARTITION BY status) * {prop}) THEN '{names[0]}' ELSE '{names[1]}' END AS {col} "
            f"FROM {src}")


SPLIT_SQL = MODEL_SQL + f", sp AS ({_split_sql('mf', 2021, 0.8, 'split')}) "
TRAIN_SQL = SPLIT_SQL + ", tr AS (SELECT * FROM sp WHERE split = 'training') "


def split_frame(t: Tables) -> DataFrame:
    return rsm.initial_split(model_frame(t), LABEL, KEY, 0.8, 2021)


def training(t: Tables) -> DataFrame:
    return split_frame(t).filter(F.col("split") == "training")


@register("b01_initial_split", ids=("B1",), sql=SPLIT_SQL + "SELECT outage_id, status, split FROM sp")
def b01(t: Tables) -> DataFrame:
    return split_frame(t).select(KEY, LABEL, "split")


@register("b02_validation_split", ids=("B2",),
          sql=TRAIN_SQL + f", vs AS ({_split_sql('tr', 2022, 0.7, 'subset', ('analysis', 'assessment'))}) "
              "SELECT outage_id, status, subset FROM vs")
def b02(t: Tables) -> DataFrame:
    return rsm.validation_split(training(t), LABEL, KEY, 0.7, 2022).select(KEY, LABEL, "subset")


@register("b03_vfold", ids=("B3",),
          sql=TRAIN_SQL + "SELECT outage_id, status, CAST((row_number() OVER (PARTITION BY status ORDER BY "
              + uniform_sql(2023, "outage_id") + ", outage_id) - 1) % 10 + 1 AS INTEGER) AS fold FROM tr")
def b03(t: Tables) -> DataFrame:
    return rsm.vfold(training(t), LABEL, KEY, 10, 2023).select(KEY, LABEL, "fold")


@register("b04_split_sizes", ids=("B4", "A4"), sql=SPLIT_SQL + "SELECT split, count(*) AS n FROM sp GROUP BY split")
def b04(t: Tables) -> DataFrame:
    return rsm.split_sizes(split_frame(t), "split")


@register("b05_downsample", ids=("B5",),
          sql=TRAIN_SQL + ", r AS (SELECT outage_id, status, row_number() OVER (PARTITION BY status ORDER BY "
              + uniform_sql(2024, "outage_id") + ", outage_id) AS rk, count(*) OVER (PARTITION BY status) AS n FROM tr) "
              "SELECT outage_id, status FROM r WHERE rk <= (SELECT min(n) FROM r)")
def b05(t: Tables) -> DataFrame:
    return rsm.downsample(training(t).select(KEY, LABEL), LABEL, KEY, 2024)


_RANKED = (", r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY {u}, outage_id) AS rk, "
           "count(*) OVER (PARTITION BY status) AS n FROM tr), "
           "big AS (SELECT min(status) AS status FROM r WHERE n = (SELECT max(n) FROM r)), "
           "gen AS (SELECT rk AS k FROM r WHERE status = (SELECT status FROM big)), "
           "sizes AS (SELECT status AS target, max(n) AS nc FROM r GROUP BY status), "
           "slots AS (SELECT target, k, nc FROM gen, (VALUES ('down'), ('up')) v(t) JOIN sizes ON sizes.target = v.t "
           "WHERE k <= {need}), "
           "picks AS (SELECT target AS status, CAST(floor({pick} * nc) + 1 AS BIGINT) AS rk, k AS slot, nc FROM slots) ")


@register("b06_upsample", ids=("B6",),
          sql=TRAIN_SQL + _RANKED.format(u=uniform_sql(2025, "outage_id"), need="(SELECT max(n) FROM r) - nc",
                                         pick=uniform_sql(2025, "target", "k"))
              + "SELECT outage_id, status FROM r UNION ALL SELECT r.outage_id, r.status FROM r JOIN picks "
              "ON r.status = picks.status AND r.rk = picks.rk")
def b06(t: Tables) -> DataFrame:
    return rsm.upsample(training(t).select(KEY, LABEL), LABEL, KEY, LEVELS, 2025)


def _rose_noise_sql(j: int, col: str, d: int) -> str:
    u1 = "1 - " + uniform_sql(2026, "'n1'", "r.status", "slot", str(j))
    u2 = uniform_sql(2026, "'n2'", "r.status", "slot", str(j))
    cf = (4.0 / (d + 2)) ** (1.0 / (d + 4))
    return (f"r.{col} + {cf!r} * power(CAST(picks.nc AS DOUBLE), {-1.0 / (d + 4)!r}) * sd.sd_{col} * "
            f"sqrt(-2 * ln({u1})) * cos({2 * 3.141592653589793!r} * {u2})")


@register("b08_rose", ids=("B8",),
          sql=TRAIN_SQL + _RANKED.format(u=uniform_sql(2026, "outage_id"), need="(SELECT max(n) FROM r)",
                                         pick=uniform_sql(2026, "target", "k"))
              + ", sd AS (SELECT status, stddev_samp(sin_energia) AS sd_sin_energia, stddev_samp(mg_trabajando) "
              "AS sd_mg_trabajando FROM tr GROUP BY status) "
              "SELECT r.outage_id, r.status, picks.slot AS synthetic_id, "
              + sq.rnd(_rose_noise_sql(0, "sin_energia", 2), 6) + " AS sin_energia, "
              + sq.rnd(_rose_noise_sql(1, "mg_trabajando", 2), 6) + " AS mg_trabajando "
              "FROM r JOIN picks ON r.status = picks.status AND r.rk = picks.rk JOIN sd ON r.status = sd.status")
def b08(t: Tables) -> DataFrame:
    tr = training(t).select(KEY, LABEL, *NUMERIC)
    r = rsm.rose(tr, LABEL, KEY, NUMERIC, LEVELS, 2026)
    return r.select(KEY, LABEL, "synthetic_id", *[rnd(c, 6).alias(c) for c in NUMERIC])


@register("b09_class_balance", ids=("B9", "A5", "U2"),
          sql=TRAIN_SQL + ", r AS (SELECT outage_id, status, row_number() OVER (PARTITION BY status ORDER BY "
              + uniform_sql(2024, "outage_id") + ", outage_id) AS rk, count(*) OVER (PARTITION BY status) AS n FROM tr), "
              "u AS (SELECT 'none' AS recipe, status, count(*) AS n FROM tr GROUP BY status UNION ALL "
              "SELECT 'downsample', status, count(*) FROM r WHERE rk <= (SELECT min(n) FROM r) GROUP BY status) "
              "SELECT recipe, status, n, " + sq.rnd("n / sum(n) OVER (PARTITION BY recipe)", 9) + " AS share FROM u")
def b09(t: Tables) -> DataFrame:
    tr = training(t).select(KEY, LABEL)
    b = rsm.class_balance({"none": tr, "downsample": rsm.downsample(tr, LABEL, KEY, 2024)}, LABEL)
    return b.select("recipe", LABEL, "n", rnd("share", 9).alias("share"))


# ------------------------------------------------------------- recipes ----


@register("r02_step_novel", ids=("R2", "R1"),
          sql=SPLIT_SQL + "SELECT outage_id, split, CASE WHEN tanque IS NULL OR tanque IN (SELECT tanque FROM sp "
              "WHERE split = 'training' AND tanque IS NOT NULL) THEN tanque ELSE 'new' END AS tanque FROM sp")
def r02(t: Tables) -> DataFrame:
    sp = split_frame(t)
    rec = rc.Recipe([rc.Novel(["tanque"])]).fit(sp.filter(F.col("split") == "training"))
    return rec.transform(sp).select(KEY, "split", "tanque")


@register("r03_step_other", ids=("R3",),
          sql=SPLIT_SQL + ", sh AS (SELECT tanque, count(*) / sum(count(*)) OVER () AS share FROM sp "
              "WHERE split = 'training' AND tanque IS NOT NULL GROUP BY tanque) "
              "SELECT outage_id, split, CASE WHEN tanque IS NULL OR tanque IN (SELECT tanque FROM sh WHERE share >= 0.01) "
              "THEN tanque ELSE 'other' END AS tanque FROM sp")
def r03(t: Tables) -> DataFrame:
    sp = split_frame(t)
    rec = rc.Recipe([rc.Other(["tanque"], 0.01)]).fit(sp.filter(F.col("split") == "training"))
    return rec.transform(sp).select(KEY, "split", "tanque")


@register("r05_step_normalize", ids=("R5",),
          sql=SPLIT_SQL + ", st AS (SELECT avg(sin_energia) AS m1, stddev_samp(sin_energia) AS s1, "
              "avg(mg_trabajando) AS m2, stddev_samp(mg_trabajando) AS s2 FROM sp WHERE split = 'training') "
              "SELECT outage_id, split, " + sq.rnd("(sin_energia - m1) / s1", 9) + " AS sin_energia, "
              + sq.rnd("(mg_trabajando - m2) / s2", 9) + " AS mg_trabajando FROM sp, st")
def r05(t: Tables) -> DataFrame:
    sp = split_frame(t)
    rec = rc.Recipe([rc.Normalize(NUMERIC)]).fit(sp.filter(F.col("split") == "training"))
    return rec.transform(sp).select(KEY, "split", *[rnd(c, 9).alias(c) for c in NUMERIC])


@register("r07_step_spatialsign", ids=("R7",),
          sql=SPLIT_SQL + ", st AS (SELECT avg(sin_energia) AS m1, stddev_samp(sin_energia) AS s1, "
              "avg(mg_trabajando) AS m2, stddev_samp(mg_trabajando) AS s2 FROM sp WHERE split = 'training'), "
              "z AS (SELECT outage_id, split, (sin_energia - m1) / s1 AS a, (mg_trabajando - m2) / s2 AS b FROM sp, st) "
              "SELECT outage_id, split, " + sq.rnd("CASE WHEN sqrt(a * a + b * b) > 0 THEN a / sqrt(a * a + b * b) "
                                                   "ELSE 0.0 END", 9) + " AS sin_energia, "
              + sq.rnd("CASE WHEN sqrt(a * a + b * b) > 0 THEN b / sqrt(a * a + b * b) ELSE 0.0 END", 9)
              + " AS mg_trabajando FROM z")
def r07(t: Tables) -> DataFrame:
    sp = split_frame(t)
    rec = rc.Recipe([rc.Normalize(NUMERIC), rc.SpatialSign(NUMERIC)]).fit(sp.filter(F.col("split") == "training"))
    return rec.transform(sp).select(KEY, "split", *[rnd(c, 9).alias(c) for c in NUMERIC])


_MTTO_LEVELS = [str(i) for i in range(1, 13)]


@register("r08_step_dummy", ids=("R8",),
          sql=SPLIT_SQL + "SELECT outage_id, split, "
              + ", ".join(f"CASE WHEN mtto IS NULL THEN NULL WHEN mtto = '{v}' THEN 1.0 ELSE 0.0 END AS mtto_{v}"
                          for v in sorted(_MTTO_LEVELS)[1:]) + " FROM sp")
def r08(t: Tables) -> DataFrame:
    sp = split_frame(t)
    rec = rc.Recipe([rc.Dummy(["mtto"], levels={"mtto": _MTTO_LEVELS})]).fit(sp.filter(F.col("split") == "training"))
    return rec.transform(sp).select(KEY, "split", *[f"mtto_{v}" for v in sorted(_MTTO_LEVELS)[1:]])


@register("r08b_step_dummy_sparse", ids=("R8",),
          sql=SPLIT_SQL + ", lv AS (SELECT siteid, row_number() OVER (ORDER BY siteid) - 2 AS place, count(*) OVER () - 1 AS places "
              "FROM (SELECT DISTINCT siteid FROM sp WHERE split = 'training' AND siteid IS NOT NULL)) "
              "SELECT outage_id, split, place AS siteid_at, CAST(CASE WHEN place IS NOT NULL THEN places END AS BIGINT) AS places, "
              "CAST(CASE WHEN place >= 0 THEN 1 WHEN place < 0 THEN 0 END AS BIGINT) AS ones, CASE WHEN place >= 0 THEN place END AS one_at "
              "FROM sp LEFT JOIN lv ON sp.siteid = lv.siteid")
def r08b(t: Tables) -> DataFrame:
    """Size, number of ones and place of the one as read from the sparse vector itself."""
    sp = split_frame(t)
    rec = rc.Recipe([rc.SparseDummy(["siteid"])]).fit(sp.filter(F.col("split") == "training"))
    vec = F.unwrap_udt(F.col("siteid_dummy"))
    return rec.transform(sp).select(
        KEY, "split", "siteid_at", vec["size"].cast("long").alias("places"), F.size(vec["indices"]).cast("long").alias("ones"),
        F.get(vec["indices"], F.lit(0)).cast("long").alias("one_at"))
