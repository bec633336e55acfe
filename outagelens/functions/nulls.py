"""Conditional, null and type functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def case_when(*branches, default=None) -> Column:  # N1: first match wins, NULL cond = no match
    out = None
    for cond, val in branches:
        val = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def if_else(cond: Column, yes, no) -> Column:  # N2: NULL condition -> NULL
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond, yes).when(~cond, no)


def recode(c, mapping: dict) -> Column:  # N6: unmatched -> NULL
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), col_(c))


def recode_keep(c, mapping: dict) -> Column:  # N6, same type: unmatched keeps its value
    return F.coalesce(recode(c, mapping), col_(c))


def parse_int(c) -> Column:  # N7: bad text -> NULL instead of an error under ANSI
    return F.expr(f"try_cast({c} as int)") if isinstance(c, str) else c.try_cast("int")


def level_index(c, levels: list) -> Column:  # N8: factor code (0-based), unknown -> NULL
    return recode(c, {lvl: i for i, lvl in enumerate(levels)})
