"""Sources and sinks: delimited text with explicit schema and clean names,
table overwrite round trip, CSV sink, model store; streaming projection."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.sources import files, sinks


def test_delimited_read_clean_names(spark, tmp_path):
    p = tmp_path / "revenue.csv"
    p.write_text("YEAR;MONTH;SITE_ID;Site Name;REVENUE_TOTAL\n2021;7;GUA001;Sitio Uno;720.5\n"
                 "2021;8;GUA002;Sitio Dos;n/a\n", encoding="utf-8")
    schema = T.StructType([T.StructField("YEAR", T.IntegerType()), T.StructField("MONTH", T.IntegerType()),
                           T.StructField("SITE_ID", T.StringType()), T.StructField("Site Name", T.StringType()),
                           T.StructField("REVENUE_TOTAL", T.DoubleType())])
    df = files.read_delimited(spark, str(p), schema, sep=";", drop=("site_name",))
    assert df.columns == ["year", "month", "site_id", "revenue_total"]
    rows = df.orderBy("month").collect()
    assert rows[0].revenue_total == 720.5 and rows[1].revenue_total is None


def test_table_round_trip_and_csv(spark, tmp_path, tables):
    out = str(tmp_path / "w_afectacion")
    src = tables.region
    sinks.write_table(src, out)
    sinks.write_table(src, out)  # overwrite replaces
    back = files.read_cached(spark, out)
    assert back.count() == src.count()
    sinks.write_csv(src, str(tmp_path / "csv"))
    assert any(n.endswith(".csv") for n in os.listdir(tmp_path / "csv"))


def test_model_store(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(40)], "x double, label double")
    pm = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()]).fit(df)
    sinks.pin_write(spark, str(tmp_path / "board"), "modelo", pm, title="t", description="d")
    m = sinks.pin_read(spark, str(tmp_path / "board"), "modelo")
    assert m.transform(df).count() == 40
    assert sinks.pin_meta(spark, str(tmp_path / "board"), "modelo")["title"] == "t"


def test_stream_projection(spark, tmp_path, tables):
    from outagelens.sources.schemas import TABLE_SCHEMAS
    from outagelens.streaming import stateless
    src = str(tmp_path / "in")
    tables.events.limit(500).write.parquet(src)
    s = stateless.outage_events_stream(spark, src, TABLE_SCHEMAS["events"])
    stateless.run_to_files(s, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out"))
    expect = spark.read.parquet(src).filter(F.col("event_type") == "error").count()
    assert got.count() == expect


def test_views_registered_and_cleaned(spark, tables):
    """S7 + Q1: load views under their names, clean all of them, query by SQL."""
    from outagelens.plans.etl_sites import clean_views
    views = tables.register_views(["nation", "supplier", "documents"])
    assert spark.sql("SELECT count(*) AS n FROM nation").first().n == 25
    cleaned = clean_views({"Nation": views["nation"], "Supplier List": views["supplier"]})
    assert set(cleaned) == {"nation", "supplier_list"}
    assert cleaned["nation"].filter(F.col("n_name") != F.upper("n_name")).count() == 0


def test_score_stream(spark, tmp_path):
    """A model fitted on batch rows scores a file stream (exactly-once file sink)."""
    from outagelens.models import classifiers as clf
    from outagelens.streaming import stateless
    rows = [(i, "down" if i % 3 == 0 else "up", float(i % 3 == 0) + (i % 7) / 10.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, status string, x double")
    pm = clf.fit("glm", df, ["x"], "status", ["down", "up"])
    src = str(tmp_path / "new_rows")
    df.drop("status").write.parquet(src)
    stream = spark.readStream.schema("id long, x double").parquet(src)
    scored = stateless.score_stream(pm, stream, ["x"], "id", ["down", "up"])
    stateless.run_to_files(scored, str(tmp_path / "scored"), str(tmp_path / "ckpt2"))
    got = spark.read.parquet(str(tmp_path / "scored"))
    assert got.count() == 120
    assert got.filter((F.col("prob") < 0) | (F.col("prob") > 1)).count() == 0
