"""Evaluation-metric queries on a stand-in prediction table.

Predictions: every labelled document scored by two fixed score rules
("glm", "knn"); truth = "down" when the document is toxic (the rare class,
about 13 %), predicted class by the strict 0.5 threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import rnd
from ..operators import frames as fr
from ..operators import metrics as mt
from ..sources.tables import Tables
from . import sqlparts as sq
from .registry import register

EVENT, OTHER = "down", "up"
LEVELS = [EVENT, OTHER]


def predictions(t: Tables) -> DataFrame:
    lab = t.labels
    truth = F.when(F.col("toxic") == 1, F.lit(EVENT)).otherwise(F.lit(OTHER))
    models = {"glm": (F.col("doc_id") * 37 % 101) / 101.0, "knn": (F.col("doc_id") * 53 % 97) / 97.0}
    frames = {m: lab.select(F.col("doc_id").alias("row_id"), truth.alias("truth"), p.cast("double").alias("prob"))
              for m, p in models.items()}
    out = fr.bind_rows_id(frames, "model")
    return out.withColumn("pred", mt.classify(F.col("prob"), EVENT, OTHER))


PRED_SQL = (
    "WITH p AS (SELECT 'glm' AS model, doc_id AS row_id, CASE WHEN toxic = 1 THEN 'down' ELSE 'up' END AS truth, "
    "CAST((doc_id * 37 % 101) / 101.0 AS DOUBLE) AS prob FROM labels UNION ALL "
    "SELECT 'knn', doc_id, CASE WHEN toxic = 1 THEN 'down' ELSE 'up' END, CAST((doc_id * 53 % 97) / 97.0 AS DOUBLE) "
    "FROM labels), preds AS (SELECT *, CASE WHEN prob > 0.5 THEN 'down' ELSE 'up' END AS pred FROM p) ")

_CC_SQL = (PRED_SQL + ", cc AS (SELECT model, CAST(sum(CASE WHEN truth = 'down' AND pred = 'down' THEN 1 ELSE 0 END) "
           "AS DOUBLE) AS tp, CAST(sum(CASE WHEN truth <> 'down' AND pred = 'down' THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
           "CAST(sum(CASE WHEN truth <> 'down' AND pred <> 'down' THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
           "CAST(sum(CASE WHEN truth = 'down' AND pred <> 'down' THEN 1 ELSE 0 END) AS DOUBLE) AS fn, "
           "CAST(count(*) AS DOUBLE) AS n FROM preds GROUP BY model) ")

_KAPPA = ("CASE WHEN ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) < 1 THEN "
          "((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / "
          "(1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) END")


def _cm(t):
    return mt.class_metrics(mt.confusion_counts(predictions(t), ["model"], EVENT))


@register("v01_accuracy", ids=("V1",), sql=_CC_SQL + "SELECT model, " + sq.rnd("(tp + tn) / n", 9) + " AS accuracy FROM cc")
def v01(t: Tables) -> DataFrame:
    return _cm(t).select("model", rnd("accuracy", 9).alias("accuracy"))


@register("v02_kappa", ids=("V2",), sql=_CC_SQL + "SELECT model, " + sq.rnd(_KAPPA, 9) + " AS kap FROM cc")
def v02(t: Tables) -> DataFrame:
    return _cm(t).select("model", rnd("kap", 9).alias("kap"))


@register("v03_sensitivity", ids=("V3",),
          sql=_CC_SQL + "SELECT model, " + sq.rnd("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", 9)
              + " AS sensitivity FROM cc")
def v03(t: Tables) -> DataFrame:
    return _cm(t).select("model", rnd("sensitivity", 9).alias("sensitivity"))


@register("v04_specificity", ids=("V4",),
          sql=_CC_SQL + "SELECT model, " + sq.rnd("CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END", 9)
              + " AS specificity FROM cc")
def v04(t: Tables) -> DataFrame:
    return _cm(t).select("model", rnd("specificity", 9).alias("specificity"))


@register("v05_precision", ids=("V5",),
          sql=_CC_SQL + "SELECT model, " + sq.rnd("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", 9)
              + " AS precision FROM cc")
def v05(t: Tables) -> DataFrame:
    return _cm(t).select("model", rnd("precision", 9).alias("precision"))


@register("v06_log_loss", ids=("V6",),
          sql=PRED_SQL + "SELECT model, " + sq.rnd("avg(-ln(CASE WHEN truth = 'down' THEN least(greatest(prob, 1e-15), "
              "1 - 1e-15) ELSE 1 - least(greatest(prob, 1e-15), 1 - 1e-15) END))", 9) + " AS mn_log_loss "
              "FROM preds GROUP BY model")
def v06(t: Tables) -> DataFrame:
    return mt.mean_log_loss(predictions(t), ["model"], EVENT).select("model", rnd("mn_log_loss", 9)
                                                                      .alias("mn_log_loss"))


_SCORES_SQL = (", s AS (SELECT model, prob AS threshold, sum(CASE WHEN truth = 'down' THEN 1 ELSE 0 END) AS pos, "
               "sum(CASE WHEN truth = 'down' THEN 0 ELSE 1 END) AS neg FROM preds GROUP BY model, prob), "
               "c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER (PARTITION BY "
               "model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM s WINDOW w AS (PARTITION BY model ORDER BY "
               "threshold DESC ROWS UNBOUNDED PRECEDING)) ")


@register("v07_roc_curve", ids=("V7", "W6"),
          sql=PRED_SQL + _SCORES_SQL + "SELECT model, threshold, " + sq.rnd("1 - cum_neg / N", 9) + " AS specificity, "
              + sq.rnd("cum_pos / P", 9) + " AS sensitivity FROM c UNION ALL SELECT DISTINCT model, '-inf'::DOUBLE, "
              "0.0, 1.0 FROM preds UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 1.0, 0.0 FROM preds")
def v07(t: Tables) -> DataFrame:
    r = mt.roc_curve(predictions(t), ["model"], EVENT)
    return r.select("model", "threshold", rnd("specificity", 9).alias("specificity"),
                    rnd("sensitivity", 9).alias("sensitivity"))


@register("v08_roc_auc", ids=("V8",),
          sql=PRED_SQL + _SCORES_SQL + "SELECT model, " + sq.rnd("sum(neg * ((cum_pos - pos) + pos / 2.0)) / "
              "(sum(pos) * sum(neg))", 9) + " AS roc_auc FROM c GROUP BY model")
def v08(t: Tables) -> DataFrame:
    return mt.roc_auc(predictions(t), ["model"], EVENT).select("model", rnd("roc_auc", 9).alias("roc_auc"))


@register("v09_pr_curve", ids=("V9",),
          sql=PRED_SQL + _SCORES_SQL + "SELECT model, threshold, " + sq.rnd("cum_pos / P", 9) + " AS recall, "
              + sq.rnd("cum_pos / (cum_pos + cum_neg)", 9) + " AS precision FROM c "
              "UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0, 1.0 FROM preds")
def v09(t: Tables) -> DataFrame:
    r = mt.pr_curve(predictions(t), ["model"], EVENT)
    return r.select("model", "threshold", rnd("recall", 9).alias("recall"), rnd("precision", 9).alias("precision"))


@register("v10_confusion_matrix", ids=("V10",),
          sql=PRED_SQL + "SELECT m.model, g.prediction, g.truth, count(p.row_id) AS n FROM (SELECT DISTINCT model FROM "
              "preds) m CROSS JOIN (VALUES ('down', 'down'), ('down', 'up'), ('up', 'down'), ('up', 'up')) "
              "g(prediction, truth) LEFT JOIN preds p ON p.model = m.model AND p.pred = g.prediction "
              "AND p.truth = g.truth GROUP BY 1, 2, 3")
def v10(t: Tables) -> DataFrame:
    return mt.confusion_matrix(predictions(t), ["model"], LEVELS)


_SET_NAMES = ["accuracy", "kap", "sensitivity", "specificity", "precision", "roc_auc", "mn_log_loss"]


@register("v11_metric_set", ids=("V11", "U4", "G5"),
          sql=_CC_SQL + _SCORES_SQL.replace(", s AS", ", s AS", 1)
              + ", auc AS (SELECT model, sum(neg * ((cum_pos - pos) + pos / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc "
              "FROM c GROUP BY model), ll AS (SELECT model, avg(-ln(CASE WHEN truth = 'down' THEN "
              "least(greatest(prob, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(prob, 1e-15), 1 - 1e-15) END)) "
              "AS mn_log_loss FROM preds GROUP BY model), w AS (SELECT cc.model, (tp + tn) / n AS accuracy, "
              + _KAPPA + " AS kap, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS sensitivity, CASE WHEN tn + fp > 0 "
              "THEN tn / (tn + fp) END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, "
              "roc_auc, mn_log_loss FROM cc JOIN auc ON cc.model = auc.model JOIN ll ON cc.model = ll.model) "
              "SELECT model, metric, " + sq.rnd("estimate", 9) + " AS estimate FROM w UNPIVOT "
              "(estimate FOR metric IN (" + ", ".join(_SET_NAMES) + "))")
def v11(t: Tables) -> DataFrame:
    m = mt.metric_set(predictions(t), ["model"], EVENT)
    return m.select("model", "metric", rnd("estimate", 9).alias("estimate"))


@register("v12_threshold_class", ids=("V12",),
          sql=PRED_SQL + "SELECT model, row_id, truth, prob, pred FROM preds")
def v12(t: Tables) -> DataFrame:
    return predictions(t).select("model", "row_id", "truth", "prob", "pred")


@register("v13_hit_rate_by_id", ids=("V13",),
          sql=PRED_SQL + "SELECT p.model, " + sq.rnd("avg(CASE WHEN p.pred = (CASE WHEN l.toxic = 1 THEN 'down' "
              "ELSE 'up' END) THEN 1.0 ELSE 0.0 END)", 9) + " AS hit_rate FROM preds p JOIN labels l "
              "ON p.row_id = l.doc_id GROUP BY p.model")
def v13(t: Tables) -> DataFrame:
    p = predictions(t).select("model", "row_id", "pred")
    truth = t.labels.select(F.col("doc_id").alias("row_id"),
                            F.when(F.col("toxic") == 1, F.lit(EVENT)).otherwise(F.lit(OTHER)).alias("truth"))
    j = p.join(truth, "row_id")
    return j.groupBy("model").agg(rnd(F.avg(F.when(F.col("pred") == F.col("truth"), 1.0).otherwise(0.0)), 9)
                                  .alias("hit_rate"))


@register("v14_error_examples", ids=("V14",),
          sql=PRED_SQL + "SELECT p.model, p.row_id, p.truth, p.pred, CASE WHEN p.pred = 'down' THEN 'FP' ELSE 'FN' END "
              "AS kind, l.quality FROM preds p JOIN labels l ON p.row_id = l.doc_id WHERE p.pred <> p.truth")
def v14(t: Tables) -> DataFrame:
    p = predictions(t).filter(F.col("pred") != F.col("truth"))
    j = p.join(t.labels.select(F.col("doc_id").alias("row_id"), "quality"), "row_id")
    return j.select("model", "row_id", "truth", "pred",
                    F.when(F.col("pred") == EVENT, F.lit("FP")).otherwise(F.lit("FN")).alias("kind"), "quality")


@register("v15_auc_labels", ids=("V15", "C9", "C13", "P12"),
          sql=PRED_SQL + _SCORES_SQL + ", a AS (SELECT model, sum(neg * ((cum_pos - pos) + pos / 2.0)) / "
              "(sum(pos) * sum(neg)) AS auc FROM c GROUP BY model) SELECT model, model || ': ' || "
              "printf('%.2f', " + sq.rnd("auc * 100", 2) + ") || '%' AS etiqueta FROM a")
def v15(t: Tables) -> DataFrame:
    from ..functions.text import extract_first
    a = mt.roc_auc(predictions(t), ["model"], EVENT)
    kind = extract_first("model", "glm|svm|knn")
    return a.select("model", F.concat_ws(": ", kind, F.concat(F.format_string("%.2f", rnd(F.col("roc_auc") * 100, 2)),
                                                                F.lit("%"))).alias("etiqueta"))


@register("v11b_metric_set_wide", ids=("V11", "U4"),
          sql=_CC_SQL + _SCORES_SQL
              + ", auc AS (SELECT model, sum(neg * ((cum_pos - pos) + pos / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc "
              "FROM c GROUP BY model), ll AS (SELECT model, avg(-ln(CASE WHEN truth = 'down' THEN "
              "least(greatest(prob, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(prob, 1e-15), 1 - 1e-15) END)) "
              "AS mn_log_loss FROM preds GROUP BY model) SELECT cc.model, " + sq.rnd("(tp + tn) / n", 9)
              + " AS accuracy, " + sq.rnd(_KAPPA, 9) + " AS kap, "
              + sq.rnd("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", 9) + " AS sensitivity, "
              + sq.rnd("CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END", 9) + " AS specificity, "
              + sq.rnd("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", 9) + " AS precision, "
              + sq.rnd("roc_auc", 9) + " AS roc_auc, " + sq.rnd("mn_log_loss", 9) + " AS mn_log_loss "
              "FROM cc JOIN auc ON cc.model = auc.model JOIN ll ON cc.model = ll.model")
def v11b(t: Tables) -> DataFrame:
    """The metric set wide: one row per model, one column per metric (pivot
    with the explicit metric list)."""
    long = mt.metric_set(predictions(t), ["model"], EVENT)
    wide = long.groupBy("model").pivot("metric", _SET_NAMES).agg(F.first("estimate"))
    return wide.select("model", *[rnd(m, 9).alias(m) for m in _SET_NAMES])
