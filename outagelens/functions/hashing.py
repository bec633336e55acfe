"""Deterministic per-row randomness: md5(seed|key) -> uniform in [0, 1).

Independent of partitioning, task retries and engine (the same text runs in
DuckDB), unlike ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def uniform(seed, *keys) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[col_(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0)"
