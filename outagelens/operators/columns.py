"""Projection and schema helpers.

All helpers work on column *names* on the driver and emit one ``select`` so
the plan stays a single Project node.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:  # P1: new = old
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def drop_cols(df: DataFrame, *cols: str) -> DataFrame:  # P2
    return df.drop(*cols)


def col_range(df: DataFrame, first: str, last: str) -> list[str]:  # P3: first:last by position
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i:j + 1]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:  # P3: select(-(a:b))
    return df.drop(*col_range(df, first, last))


def everything_after(df: DataFrame, front: Iterable[str]) -> DataFrame:  # P4: listed first, rest after
    front = list(front)
    return df.select(*front, *[c for c in df.columns if c not in front])


def cols_of_type(df: DataFrame, kind: str) -> list[str]:  # P5: where(is.numeric / is.character)
    def ok(dt):
        if kind == "numeric":
            return isinstance(dt, NUMERIC)
        if kind == "string":
            return isinstance(dt, T.StringType)
        if kind == "boolean":
            return isinstance(dt, T.BooleanType)
        if kind == "timestamp":
            return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))
        raise ValueError(kind)
    return [f.name for f in df.schema.fields if ok(f.dataType)]


def select_type(df: DataFrame, kind: str, keep: Iterable[str] = ()) -> DataFrame:  # P5
    keep = list(keep)
    return df.select(*keep, *[c for c in cols_of_type(df, kind) if c not in keep])


def rename_with(df: DataFrame, fn: Callable[[str], str], cols: Iterable[str] | None = None) -> DataFrame:  # P6
    cols = list(cols) if cols is not None else df.columns
    return df.withColumnsRenamed({c: fn(c) for c in cols})


def relocate(df: DataFrame, cols: Iterable[str], before: str | None = None,
             after: str | None = None) -> DataFrame:  # P7
    cols = list(cols)
    rest = [c for c in df.columns if c not in cols]
    if before is None and after is None:
        order = cols + rest
    else:
        anchor = before or after
        i = rest.index(anchor) + (0 if before else 1)
        order = rest[:i] + cols + rest[i:]
    return df.select(*order)


def mutate_unused(df: DataFrame, new: dict[str, Column], used: Iterable[str],
                  before: str | None = None) -> DataFrame:  # P9: .keep = "unused"
    used = set(used)
    out = df.withColumns(new).drop(*[u for u in used if u not in new])
    if before:
        out = relocate(out, list(new), before=before)
    return out


def map_columns(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:  # P10
    cols = set(cols)
    return df.select(*[fn(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def map_strings(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:  # P10: mutate_if(is.character)
    return map_columns(df, cols_of_type(df, "string"), fn)


def unite(df: DataFrame, name: str, cols: list[str], sep: str = "_") -> DataFrame:  # P12 (NA -> "NA")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols]
    first = df.columns.index(cols[0])
    out = df.withColumn(name, F.concat_ws(sep, *parts))
    order = [c for c in df.columns[:first] if c not in cols] + [name] + \
            [c for c in df.columns[first:] if c not in cols]
    return out.select(*order)


def matching(df: DataFrame, starts_with: str | None = None, contains: str | None = None,
             regex: str | None = None) -> list[str]:  # P14
    out = []
    for c in df.columns:
        if starts_with is not None and not c.startswith(starts_with):
            continue
        if contains is not None and contains not in c:
            continue
        if regex is not None and not re.search(regex, c):
            continue
        out.append(c)
    return out
