"""Sinks.

Targets are paths or table names given by the caller (shared storage on a
cluster).  Writes replace the target as a whole (``overwrite``), as
``dbWriteTable(overwrite = TRUE)`` does.
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, target: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                as_table: bool = False) -> None:
    """Replace a warehouse table (parquet path or catalog table)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if as_table:
        w.saveAsTable(target)
    else:
        w.save(target)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """S12 ``write_csv``: header + delimiter, one directory of part files."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def pin_write(spark: SparkSession, board: str, name: str, obj, title: str = "", description: str = "") -> str:
    """S10 ``pin_write``: a named, titled artefact in a board folder - an MLlib
    model (saved with its own writer) or a DataFrame (parquet) - plus a
    small metadata file."""
    path = os.path.join(board, name)
    if isinstance(obj, DataFrame):
        obj.write.mode("overwrite").parquet(os.path.join(path, "data"))
        kind = "dataframe"
    elif isinstance(obj, PipelineModel):
        obj.write().overwrite().save(os.path.join(path, "model"))
        kind = "model"
    else:
        raise TypeError(type(obj))
    meta = spark.createDataFrame([(name, title, description, kind)], "name string, title string, "
                                                                    "description string, kind string")
    meta.coalesce(1).write.mode("overwrite").json(os.path.join(path, "meta"))
    return path


def pin_read(spark: SparkSession, board: str, name: str):
    """S10 ``pin_read``: the artefact written by ``pin_write``."""
    path = os.path.join(board, name)
    meta = spark.read.json(os.path.join(path, "meta")).first()
    if meta["kind"] == "model":
        return PipelineModel.load(os.path.join(path, "model"))
    return spark.read.parquet(os.path.join(path, "data"))


def pin_meta(spark: SparkSession, board: str, name: str) -> dict:
    return json.loads(spark.read.json(os.path.join(board, name, "meta")).toJSON().first())
