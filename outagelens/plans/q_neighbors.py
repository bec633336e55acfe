"""Nearest-neighbour queries: kNN neighbours and vote (L4), SMOTE.

Spark side: exact search on a metric index (``operators.metric_index``).  Oracle
side: brute force over all pairs in DuckDB, which is only the check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_sql
from ..functions.mathx import rnd
from ..operators import neighbors as nb
from ..sources.tables import Tables
from . import sqlparts as sq
from .q_learning import KEY, LABEL, LEVELS, SPLIT_SQL, TRAIN_SQL, split_frame, training
from .registry import register

K_NEIGHBORS = 5
K_VOTE = 9

_EMB_PAIRS_SQL = (
    "WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i "
    "FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS r, " + sq.rnd("sum((a.v - b.v) * (a.v - b.v))", 9)
    + " AS dist2 FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2), "
    "nn AS (SELECT q, r, dist2, row_number() OVER (PARTITION BY q ORDER BY dist2, r) AS nn_rank FROM p) ")


def _emb(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


@register("l04_knn_neighbors", ids=("L4",),
          sql=_EMB_PAIRS_SQL + f"SELECT q AS vec_id, nn_rank, r AS nn_id, dist2 FROM nn WHERE nn_rank <= {K_NEIGHBORS}")
def l04(t: Tables) -> DataFrame:
    e = _emb(t)
    out = nb.knn(e, e.withColumnRenamed("vec_id", "nn_id"), "vec_id", "nn_id", "vec", K_NEIGHBORS, exclude_self=True)
    return out.select("vec_id", F.col("nn_rank").cast("long").alias("nn_rank"), "nn_id", "dist2")


@register("l04b_knn_vote", ids=("L4", "L9"),
          sql=_EMB_PAIRS_SQL + ", v AS (SELECT nn.q, e.label, 1.0 / greatest(sqrt(nn.dist2), 1e-12) AS w FROM nn "
              f"JOIN embeddings e ON e.vec_id = nn.r WHERE nn_rank <= {K_VOTE}) SELECT q AS vec_id, "
              + sq.rnd("sum(CASE WHEN label = 1 THEN w ELSE 0.0 END) / sum(w)", 9) + " AS prob FROM v GROUP BY q")
def l04b(t: Tables) -> DataFrame:
    """Leave-one-out weighted kNN (inverse-distance kernel, k = 9): P(label = 1)."""
    e = _emb(t)
    n = nb.knn(e, e.withColumnRenamed("vec_id", "nn_id"), "vec_id", "nn_id", "vec", K_VOTE, exclude_self=True)
    lab = e.select(F.col("vec_id").alias("nn_id"), "label")
    w = 1.0 / F.greatest(F.sqrt("dist2"), F.lit(1e-12))
    j = n.join(lab, "nn_id").withColumn("_w", w)
    return j.groupBy("vec_id").agg(rnd(F.sum(F.when(F.col("label") == 1, F.col("_w")).otherwise(0.0)) / F.sum("_w"),
                                       9).alias("prob"))


_KERNEL_SQL = {
    "triangular": "1 - z", "epanechnikov": "0.75 * (1 - z * z)", "biweight": "15.0 / 16 * pow(1 - z * z, 2)",
    "triweight": "35.0 / 32 * pow(1 - z * z, 3)", "cos": "pi() / 4 * cos(pi() / 2 * z)",
    "gaussian": "exp(-z * z / 2) / sqrt(2 * pi())", "inv": "1 / greatest(sqrt(dist2), 1e-12)", "rectangular": "1.0"}
_VOTE_COLS = ["sin_energia", "mg_trabajando", "mes"]


@register("l04c_knn_kernels", ids=("L4", "L9", "R10"),
          sql=SPLIT_SQL + ", v AS (SELECT outage_id, status, split, "
              + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS x{i}" for i, c in enumerate(_VOTE_COLS)) + " FROM sp), "
              "p AS (SELECT a.outage_id, b.status, row_number() OVER (PARTITION BY a.outage_id ORDER BY d, b.outage_id) AS rk, d AS dist2 "
              "FROM v a JOIN v b ON a.split = 'testing' AND b.split = 'training', LATERAL (SELECT "
              + sq.rnd(" + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(_VOTE_COLS))), 9) + " AS d)), "
              f"n AS (SELECT *, max(sqrt(dist2)) OVER (PARTITION BY outage_id) AS width FROM p WHERE rk <= {K_VOTE + 1}), "
              "z AS (SELECT *, least(greatest(coalesce(sqrt(dist2) / nullif(width, 0), 1e-6), 1e-6), 1 - 1e-6) AS z FROM n "
              f"WHERE rk <= {K_VOTE}), "
              "w AS (" + " UNION ALL ".join(f"SELECT outage_id, status, '{k}' AS kernel, {e} AS w FROM z" for k, e in _KERNEL_SQL.items()) + ") "
              "SELECT outage_id, kernel, " + sq.rnd("sum(CASE WHEN status = 'down' THEN w ELSE 0.0 END) / sum(w)", 7)
              + " AS prob FROM w GROUP BY outage_id, kernel")
def l04c(t: Tables) -> DataFrame:
    """P(down) of the testing rows by each kernel (k = 9) from the training rows."""
    sp = split_frame(t).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _VOTE_COLS})
    sp = sp.select(KEY, LABEL, "split", *_VOTE_COLS).checkpoint(eager=True)
    train, test = (sp.filter(F.col("split") == s) for s in ("training", "testing"))
    votes = nb.knn_votes(train, test, KEY, LABEL, _VOTE_COLS, K_VOTE, "down", list(_KERNEL_SQL))
    return votes.unpivot([KEY], list(_KERNEL_SQL), "kernel", "prob").withColumn("prob", rnd("prob", 7))


_SMOTE_COLS = ["sin_energia", "dia"]


@register("b07_smote", ids=("B7",),
          sql=TRAIN_SQL
              + ", r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY " + uniform_sql(2028, "outage_id")
              + ", outage_id) AS rk, count(*) OVER (PARTITION BY status) AS n FROM tr), "
              "big AS (SELECT min(status) AS status FROM r WHERE n = (SELECT max(n) FROM r)), "
              "gen AS (SELECT rk AS k FROM r WHERE status = (SELECT status FROM big)), "
              "sizes AS (SELECT status AS target, max(n) AS nc FROM r GROUP BY status), "
              "slots AS (SELECT target, k, nc FROM gen, (VALUES ('down'), ('up')) v(t) JOIN sizes ON sizes.target = v.t "
              "WHERE k <= (SELECT max(n) FROM r) - nc), "
              "nn AS (SELECT a.outage_id AS q, b.outage_id AS rr, row_number() OVER (PARTITION BY a.outage_id ORDER BY "
              + sq.rnd("0.0 + (CAST(a.sin_energia AS DOUBLE) - CAST(b.sin_energia AS DOUBLE)) * "
                       "(CAST(a.sin_energia AS DOUBLE) - CAST(b.sin_energia AS DOUBLE)) + (CAST(a.dia AS DOUBLE) - "
                       "CAST(b.dia AS DOUBLE)) * (CAST(a.dia AS DOUBLE) - CAST(b.dia AS DOUBLE))", 6)
              + ", b.outage_id) AS nn_rank FROM r a JOIN r b ON a.status = b.status AND a.outage_id <> b.outage_id), "
              "base AS (SELECT s.target AS status, s.k AS synthetic_id, least(s.nc - 1, 5) AS kk, r.outage_id AS base_id, "
              "CAST(r.sin_energia AS DOUBLE) AS x0, CAST(r.dia AS DOUBLE) AS x1 FROM slots s JOIN r "
              "ON r.status = s.target AND r.rk = (s.k - 1) % s.nc + 1), "
              "b2 AS (SELECT *, CAST(floor(" + uniform_sql(2028, "'nn'", "status", "synthetic_id")
              + " * kk) + 1 AS INTEGER) AS nn_rank, " + uniform_sql(2028, "'gap'", "status", "synthetic_id")
              + " AS g FROM base) "
              "SELECT b2.status, b2.synthetic_id, b2.base_id, nn.rr AS neighbor_id, "
              + sq.rnd("x0 + g * (CAST(y.sin_energia AS DOUBLE) - x0)", 6) + " AS sin_energia, "
              + sq.rnd("x1 + g * (CAST(y.dia AS DOUBLE) - x1)", 6) + " AS dia "
              "FROM b2 JOIN nn ON nn.q = b2.base_id AND nn.nn_rank = b2.nn_rank JOIN r y ON y.outage_id = nn.rr")
def b07(t: Tables) -> DataFrame:
    tr = training(t).select(KEY, LABEL, *_SMOTE_COLS)
    s = nb.smote(tr, LABEL, KEY, _SMOTE_COLS, LEVELS, k=5, seed=2028)
    return s.select(LABEL, "synthetic_id", "base_id", "neighbor_id", *[rnd(c, 6).alias(c) for c in _SMOTE_COLS])
