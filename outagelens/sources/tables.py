"""Named parquet tables read lazily with explicit schemas.

``Tables`` plays the role of the reference's named list of views: attribute
access returns a lazy DataFrame; nothing is collected.  Filters and column
selections applied later are pushed into the parquet scan by Catalyst.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .schemas import TABLE_SCHEMAS


class Tables:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.fmt = fmt
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.{self.fmt}")

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            reader = self.spark.read.format(self.fmt)
            if name in TABLE_SCHEMAS:
                reader = reader.schema(TABLE_SCHEMAS[name])
            self._cache[name] = reader.load(self.path(name))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_SCHEMAS:
            raise AttributeError(name)
        return self.table(name)

    def register_views(self, names=None) -> dict[str, DataFrame]:
        """Load N views under their names (temp views for spark.sql)."""
        names = list(names or TABLE_SCHEMAS)
        out = {n: self.table(n) for n in names}
        for n, df in out.items():
            df.createOrReplaceTempView(n)
        return out
