"""Forests with out-of-bag votes (L2, L3) on the outage modelling frame, grown again in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import rnd
from ..models import forest as fo
from ..sources.tables import Tables
from . import sqlparts as sq
from .q_learning import KEY, LABEL, LEVELS, SPLIT_SQL, split_frame, training
from .registry import register

FEATURES = ["sin_energia", "mg_trabajando", "arranco_mg", "dia", "mes", "tanque_num"]
DEPTH, BINS = 12, 32


def _rows(frame: DataFrame) -> DataFrame:
    return frame.withColumn("tanque_num", F.col("tanque").cast("double"))


def _sql(trees: int, mtry: int, min_n: int, seed: int) -> str:
    rows = SPLIT_SQL + (", fr AS MATERIALIZED (SELECT outage_id, status, split, split = 'training' AS learns, CASE WHEN status = 'down' THEN 1 "
                        "ELSE 0 END AS y, sin_energia, mg_trabajando, arranco_mg, dia, mes, TRY_CAST(tanque AS DOUBLE) AS tanque_num FROM sp), ")
    return rows + fo.forest_sql("fr", KEY, FEATURES, trees, mtry, min_n, DEPTH, BINS, seed)


def _oob_sql(*params) -> str:
    return (_sql(*params) + ", v AS (SELECT outage_id, any_value(fv.y) AS y, count(*) FILTER (WHERE w = 0) AS n_trees, "
            "avg(share) FILTER (WHERE w = 0) AS prob FROM fv JOIN fr USING (outage_id) WHERE learns GROUP BY outage_id), "
            "e AS (SELECT avg(CASE WHEN (prob > 0.5) <> (y = 1) THEN 1.0 ELSE 0.0 END) AS oob_error, "
            "avg((prob - y) * (prob - y)) AS oob_brier FROM v WHERE prob IS NOT NULL) SELECT outage_id, n_trees, " + sq.rnd("prob", 8) + " AS prob, "
            + sq.rnd("oob_error", 8) + " AS oob_error, " + sq.rnd("oob_brier", 8) + " AS oob_brier FROM v, e")


def _test_sql(model: str, *params) -> str:
    return (_sql(*params) + ", v AS (SELECT outage_id, avg(share) AS prob FROM fv GROUP BY outage_id) SELECT outage_id, status AS truth, "
            + sq.rnd("prob", 8) + f" AS prob, CASE WHEN prob > 0.5 THEN 'down' ELSE 'up' END AS pred, '{model}' AS model "
            "FROM v JOIN fr USING (outage_id) WHERE split = 'testing'")


def _fit(t: Tables, trees: int, mtry: int, min_n: int, seed: int) -> fo.Forest:
    return fo.fit_forest(_rows(training(t)), FEATURES, LABEL, LEVELS, KEY, trees, mtry, min_n, DEPTH, BINS, seed)


def _out_of_bag(t: Tables, *params) -> DataFrame:
    votes = _fit(t, *params).out_of_bag(KEY).checkpoint(eager=True)
    error = fo.oob_error(votes).first()  # one row
    return votes.select(KEY, "n_trees", rnd("prob", 8).alias("prob"), rnd(F.lit(error["oob_error"]), 8).alias("oob_error"),
                        rnd(F.lit(error["oob_brier"]), 8).alias("oob_brier"))


def _predicted(t: Tables, model: str, *params) -> DataFrame:
    """Testing rows scored by the forest of the training rows."""
    test = _rows(split_frame(t).filter(F.col("split") == "testing"))
    prob = _fit(t, *params).votes(test, KEY).join(test.select(KEY, F.col(LABEL).alias("truth")), KEY)
    return prob.select(KEY, "truth", rnd("prob", 8).alias("prob"), F.when(F.col("prob") > 0.5, "down").otherwise("up").alias("pred"),
                       F.lit(model).alias("model"))


# (trees, features a node may split on, smallest node to split, seed)
FOREST = (40, 2, 2, 2021)
BAGGING = (25, len(FEATURES), 10, 2022)


@register("l02_random_forest", ids=("L2", "L8", "L9", "G9", "G10"), sql=_test_sql("rf", *FOREST))
def l02(t: Tables) -> DataFrame:
    return _predicted(t, "rf", *FOREST)


@register("l02b_forest_out_of_bag", ids=("L2",), sql=_oob_sql(*FOREST))
def l02b(t: Tables) -> DataFrame:
    return _out_of_bag(t, *FOREST)


@register("l03_bagged_trees", ids=("L3", "L8", "L9", "G9", "G10"), sql=_test_sql("bag", *BAGGING))
def l03(t: Tables) -> DataFrame:
    return _predicted(t, "bag", *BAGGING)


@register("l03b_bagging_out_of_bag", ids=("L3",), sql=_oob_sql(*BAGGING))
def l03b(t: Tables) -> DataFrame:
    return _out_of_bag(t, *BAGGING)


@register("l10_variable_importance", ids=("L10", "T1"),
          sql=_sql(*FOREST) + f", g AS (SELECT f, sum(gain) / {FOREST[0]} AS g FROM fg GROUP BY f), "
              "z AS (SELECT count(*) AS z FROM fv) SELECT name AS term, "  # the leaves read too: without them the plan is far slower
              + sq.rnd("coalesce(g, 0)", 6) + " AS importance FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))
              + ") AS names(f, name) LEFT JOIN g USING (f), z WHERE z.z >= 0")
def l10(t: Tables) -> DataFrame:
    rows = _fit(t, *FOREST).importance()  # a line a feature
    return t.spark.createDataFrame(rows, "term string, importance double").select("term", rnd("importance", 6).alias("importance"))
