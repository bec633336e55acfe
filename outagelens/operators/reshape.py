"""Reshaping: pivot with an explicit level list, unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_wider(df: DataFrame, ids: list[str], names_from: str, values_from: str, levels: list[str],
                agg=F.max) -> DataFrame:
    """EAV -> columns.  The level list is explicit so the output schema does
    not depend on the data and no extra job collects the distinct names."""
    return df.groupBy(*ids).pivot(names_from, levels).agg(agg(values_from))


def pivot_longer(df: DataFrame, ids: list[str], cols: list[str], names_to: str, values_to: str) -> DataFrame:
    return df.unpivot(ids, cols, names_to, values_to)


def part_as_eav(part: DataFrame) -> DataFrame:
    """Stand-in EAV table of site attributes: (siteid, name, value) from part."""
    wide = part.select(F.col("p_partkey").alias("siteid"), "p_brand", "p_type",
                       F.col("p_size").cast("string").alias("p_size"))
    return wide.unpivot(["siteid"], ["p_brand", "p_type", "p_size"], "name", "value")
