"""File sources: delimited text with an explicit schema
and cleaned column names, parquet for cached intermediate results.

Schemas are always declared (never inferred); the header is matched by
position, then names are cleaned (P8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.names import clean_columns


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                   clean: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """S1 ``read_delim(delim = ";")`` / S2 ``read_csv`` / S4 ``fread``: header
    row, explicit schema, bad values -> NULL (PERMISSIVE), names cleaned;
    S3 ``col_select = -x``: dropped columns are pruned by Catalyst."""
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
          .option("encoding", "UTF-8").csv(path))
    if clean:
        df = clean_columns(df)
    return df.drop(*drop) if drop else df


def read_cached(spark: SparkSession, path: str) -> DataFrame:
    """S5 ``read_fst``: a cached intermediate result stored as parquet."""
    return spark.read.parquet(path)
