"""Header -> unique snake_case ASCII names (applied to column names only)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame


def clean_name(name: str) -> str:
    s = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    s = s.replace("%", "percent").replace("#", "number")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(names: list[str]) -> list[str]:
    out, seen = [], {}
    for n in names:
        base = clean_name(n)
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return out


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))
