"""Classification metrics on a long prediction table.

Input columns: a model/group column, ``truth`` (class label), ``prob``
(probability of the event class) and ``pred`` (predicted class).  The event
class is always explicit (note X1).  ``group`` must name at least one
column (use a constant column for a single model).  Everything is grouped aggregation;
curves use the distributed running totals, never a per-model window over
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import running_totals


def classify(prob: Column, event: str, other: str, threshold: float = 0.5) -> Column:
    """Event when prob > threshold (strict)."""
    return F.when(prob > threshold, F.lit(event)).otherwise(F.lit(other))


def confusion_counts(df: DataFrame, group: list[str], event: str, truth="truth", pred="pred") -> DataFrame:
    """tp, fp, tn, fn, n per group (one aggregate pass)."""
    t, p = F.col(truth) == event, F.col(pred) == event
    return df.groupBy(*group).agg(
        F.sum(F.when(t & p, 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~t & p, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~t & ~p, 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(t & ~p, 1).otherwise(0)).cast("long").alias("fn"),
        F.count(F.lit(1)).alias("n"))


def class_metrics(cc: DataFrame) -> DataFrame:
    """V1-V5 from the confusion counts (NULL where undefined)."""
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    acc = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    kappa = F.when(pe < 1, (acc - pe) / (1 - pe))
    return cc.withColumns({
        "accuracy": acc,
        "kap": kappa,
        "sensitivity": F.when(tp + fn > 0, tp / (tp + fn)),
        "specificity": F.when(tn + fp > 0, tn / (tn + fp)),
        "precision": F.when(tp + fp > 0, tp / (tp + fp)),
    })


def mean_log_loss(df: DataFrame, group: list[str], event: str, truth="truth", prob="prob",
                  eps: float = 1e-15) -> DataFrame:
    """V6: mean of -ln p(true class), p clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    p_true = F.when(F.col(truth) == event, p).otherwise(1 - p)
    return df.groupBy(*group).agg(F.avg(-F.log(p_true)).alias("mn_log_loss"))


def _score_table(df: DataFrame, group: list[str], event: str, truth: str, prob: str) -> DataFrame:
    """Distinct scores per group with positive/negative counts, then running
    totals in descending score order (positives/negatives at score >= s)."""
    agg = df.groupBy(*group, F.col(prob).alias("threshold")).agg(
        F.sum(F.when(F.col(truth) == event, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(truth) == event, 0).otherwise(1)).cast("long").alias("neg"))
    agg = agg.withColumn("_neg_t", -F.col("threshold"))
    out = running_totals(agg, ["_neg_t"], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, group=group)
    return out.drop("_neg_t")


def roc_curve(df: DataFrame, group: list[str], event: str, truth="truth", prob="prob") -> DataFrame:
    """V7: (threshold, specificity, sensitivity) at every distinct score, plus
    the two end points (threshold -inf and +inf) as yardstick returns them."""
    s = _score_table(df, group, event, truth, prob)
    tot = df.groupBy(*group).agg(F.sum(F.when(F.col(truth) == event, 1).otherwise(0)).alias("P"),
                                 F.sum(F.when(F.col(truth) == event, 0).otherwise(1)).alias("N"))
    s = s.join(tot, group)
    pts = s.select(*group, F.col("threshold").cast("double").alias("threshold"),
                   (1 - F.try_divide(F.col("cum_neg"), F.col("N"))).alias("specificity"),
                   F.try_divide(F.col("cum_pos"), F.col("P")).alias("sensitivity"))
    ends = tot.select(*group, F.lit(float("-inf")).alias("threshold"), F.lit(0.0).alias("specificity"),
                      F.lit(1.0).alias("sensitivity")).unionByName(
        tot.select(*group, F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("specificity"),
                   F.lit(0.0).alias("sensitivity")))
    return pts.unionByName(ends)


def roc_auc(df: DataFrame, group: list[str], event: str, truth="truth", prob="prob") -> DataFrame:
    """V8: area under the ROC curve, ties counted half (= trapezoid rule):
    sum over distinct scores of neg_s * (pos above s + pos_s / 2) / (P * N)."""
    s = _score_table(df, group, event, truth, prob)
    contrib = F.col("neg") * ((F.col("cum_pos") - F.col("pos")) + F.col("pos") / 2.0)
    g = s.groupBy(*group).agg(F.sum(contrib).alias("_a"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*group, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                   F.col("_a") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def pr_curve(df: DataFrame, group: list[str], event: str, truth="truth", prob="prob") -> DataFrame:
    """V9: (threshold, recall, precision) at every distinct score plus the
    start point (inf, 0, 1)."""
    s = _score_table(df, group, event, truth, prob)
    tot = df.groupBy(*group).agg(F.sum(F.when(F.col(truth) == event, 1).otherwise(0)).alias("P"))
    s = s.join(tot, group)
    pts = s.select(*group, F.col("threshold").cast("double").alias("threshold"),
                   F.try_divide(F.col("cum_pos"), F.col("P")).alias("recall"),
                   (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))
    start = tot.select(*group, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("recall"),
                       F.lit(1.0).alias("precision"))
    return pts.unionByName(start)


def confusion_matrix(df: DataFrame, group: list[str], levels: list[str], truth="truth", pred="pred") -> DataFrame:
    """(group, prediction, truth, n) zero-filled over the level grid."""
    counts = df.groupBy(*group, F.col(pred).alias("prediction"), F.col(truth).alias("truth")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(p).alias("prediction"), F.lit(t).alias("truth")) for p in levels for t in levels])
    cells = df.select(*group).distinct().withColumn("_c", F.explode(grid)).select(*group, "_c.prediction", "_c.truth")
    return cells.join(counts, [*group, "prediction", "truth"], "left").fillna({"n": 0})


def metric_set(df: DataFrame, group: list[str], event: str, truth="truth", prob="prob",
               pred="pred") -> DataFrame:
    """Long table (group, metric, estimate) for the report's metric set.

    Each piece is unpivoted on its own and the pieces are stacked (union), so
    no join is needed - group columns may even be constants."""
    names = ["accuracy", "kap", "sensitivity", "specificity", "precision"]
    cm = class_metrics(confusion_counts(df, group, event, truth, pred)).select(*group, *names)
    auc = roc_auc(df, group, event, truth, prob)
    ll = mean_log_loss(df, group, event, truth, prob)
    parts = [cm.unpivot(group, names, "metric", "estimate"),
             auc.unpivot(group, ["roc_auc"], "metric", "estimate"),
             ll.unpivot(group, ["mn_log_loss"], "metric", "estimate")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
