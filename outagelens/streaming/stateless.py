"""Streaming use of the stateless parts.

The reference has no streams.  Row-wise steps - text cleaning (Q1), link
category of affected lines (Q6), outage features without aggregates (Q15)
and scoring with a fitted model (L9) - are plain projections, so the same
column functions run unchanged on a streaming DataFrame from
``readStream``.  Output goes to a file sink with a checkpoint location so a
restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators.columns import map_strings


def clean_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Q1 on a stream of files: every string column upper-cased, trimmed, folded."""
    s = spark.readStream.schema(schema).format(fmt).load(source_dir)
    return map_strings(s, tx.clean_text)


def outage_events_stream(spark: SparkSession, source_dir: str, schema: T.StructType) -> DataFrame:
    """Q15-style row features on a stream of outage events (type 'error')."""
    s = spark.readStream.schema(schema).parquet(source_dir).filter(F.col("event_type") == "error")
    secs = F.round(F.col("value") * 60).cast("long")
    return s.select(F.col("event_id").alias("outage_id"), F.col("user_id").alias("siteid"),
                    F.col("ts").alias("inicio"), F.timestamp_add("SECOND", secs, F.col("ts")).alias("fin"),
                    (F.col("value") * 60).alias("sin_energia"), F.dayofmonth("ts").cast("long").alias("dia"),
                    F.month("ts").cast("long").alias("mes"))


def run_to_files(df: DataFrame, out_dir: str, checkpoint: str, fmt: str = "parquet"):
    """Process everything available now, then stop (``availableNow``)."""
    q = (df.writeStream.format(fmt).option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def score_stream(model, stream: DataFrame, features: list[str], key: str, levels: list[str]) -> DataFrame:
    """L9 on a stream: a fitted pipeline (MLlib transformers work on streaming
    DataFrames) gives P(event) and the 0.5-threshold class for every new row."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(stream.fillna(0.0, subset=features))
    prob = vector_to_array("probability")[0]
    res = out.select(key, prob.alias("prob"))
    return res.withColumn("pred", F.when(F.col("prob") > 0.5, F.lit(levels[0])).otherwise(F.lit(levels[1])))
