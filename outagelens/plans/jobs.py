"""End-to-end jobs of the reference's two entry points.

``write_warehouse``: sources -> cleaned views -> site master -> tickets ->
facts -> six warehouse tables replaced in one go (tickets.R load stage).
``run_report``: features -> split -> folds -> racing tune -> best config ->
last fit -> test metrics, results stored as named artefacts (pins).
Only the sinks are actions; every table is one lazy plan.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..models import tuning as tn
from ..operators import recipes as rc
from ..operators import resample as rsm
from ..session import configure
from ..sources import sinks
from ..sources.tables import Tables
from . import etl, etl_items, etl_sites
from .q_learning import KEY, LABEL, LEVELS, NUMERIC, model_frame

WAREHOUSE = {
    "w_afectacion": etl.affected_fact,
    "w_afectacion_correctivo": etl_items.affected_fact_corrective,
    "w_ttks": etl_sites.tickets_corrective,
    "w_items": etl_items.items_enriched,
    "w_sitelist": etl_sites.site_master,
    "w_mttr": etl_sites.q13,
}


def write_warehouse(spark: SparkSession, sf_dir: str, out_root: str, tables: list[str] | None = None) -> dict:
    """Replace the warehouse tables under ``out_root`` (shared storage)."""
    configure(spark)
    t = Tables(spark, sf_dir)
    written = {}
    for name in tables or list(WAREHOUSE):
        path = os.path.join(out_root, name)
        sinks.write_table(WAREHOUSE[name](t), path)
        written[name] = path
    return written


def run_report(spark: SparkSession, sf_dir: str, board: str, model: str = "bag", grid_size: int = 3,
               folds: int = 5, burn_in: int = 3, metric: str = "roc_auc") -> dict:
    """Report workflow for one recipe x model; returns a summary dict."""
    configure(spark)
    t = Tables(spark, sf_dir)
    frame = model_frame(t)
    sp = rsm.initial_split(frame, LABEL, KEY, 0.8, 2021)
    train, test = sp.filter(F.col("split") == "training"), sp.filter(F.col("split") == "testing")
    train = rsm.vfold(train, LABEL, KEY, folds, 2023).checkpoint(eager=True)
    nominal = ["mtto", "tipo_bateria"]

    def recipe():
        return rc.Recipe([rc.Normalize(NUMERIC), rc.Dummy(nominal), rc.Balance("down", LABEL, KEY, LEVELS)])

    def features_of(df):
        skip = {KEY, LABEL, "split", "fold", "siteid", "tanque", *nominal}
        return [f.name for f in df.schema.fields if f.name not in skip
                and f.dataType.simpleString() in ("double", "int", "bigint")]

    cands = tn.grid(model, grid_size, seed=11)
    fm, alive = tn.tune_race(train, "fold", recipe, model, cands, features_of, LABEL, KEY, LEVELS,
                             f"downsample_{model}", metric=metric, burn_in=burn_in)
    summary = tn.collect_metrics(fm)
    best = tn.select_best(summary.filter(F.col("config").isin(alive)), metric).first()
    params = cands[int(best["config"][-2:]) - 1]
    preds, test_metrics = tn.last_fit(train.drop("fold"), test, recipe, model, params, features_of, LABEL, KEY,
                                      LEVELS)
    sinks.pin_write(spark, board, "fold_metrics", fm, title="Fold metrics", description="racing tune")
    sinks.pin_write(spark, board, "test_metrics", test_metrics, title="Test metrics", description="last fit")
    return {"best_config": best["config"], "params": params, "survivors": alive,
            "test": {r["metric"]: r["estimate"] for r in test_metrics.collect()}}
