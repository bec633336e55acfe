"""End-to-end jobs: warehouse load and the report workflow with racing."""

import os

from outagelens.plans import jobs


def test_write_warehouse(spark, tmp_path):
    from conftest import SF_SMALL
    out = jobs.write_warehouse(spark, SF_SMALL, str(tmp_path / "dw"))
    assert set(out) == set(jobs.WAREHOUSE)
    for name, path in out.items():
        assert os.path.isdir(path)
        assert spark.read.parquet(path).count() > 0, name


def test_run_report_with_racing(spark, tmp_path):
    from conftest import SF_MID
    res = jobs.run_report(spark, SF_MID, str(tmp_path / "board"), model="bag", grid_size=3, folds=4, burn_in=3)
    assert res["best_config"] in res["survivors"]
    assert 0.0 <= res["test"]["accuracy"] <= 1.0
    from outagelens.sources import sinks
    fm = sinks.pin_read(spark, str(tmp_path / "board"), "fold_metrics")
    assert fm.select("config").distinct().count() >= len(res["survivors"])
