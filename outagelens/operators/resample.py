"""Reproducible splits and class balancing.

Randomness is md5(seed|key) (``functions.hashing.uniform``): the same rows
come out under any partitioning, after task retries and in DuckDB.  Ranks
inside a stratum come from the distributed running totals, so a stratum
holding most of the rows is never numbered inside one window task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .frames import join_null_safe, running_totals


def stratified_rank(df: DataFrame, strata: str, key: str, seed) -> DataFrame:
    """Adds ``_rank`` (1.. within stratum, by md5 uniform then key) and ``_n``
    (stratum size)."""
    d = df.withColumn("_u", uniform(seed, key))
    r = running_totals(d, ["_u", key], {"_rank": F.lit(1).cast("long")}, group=[strata])
    counts = df.groupBy(strata).agg(F.count(F.lit(1)).alias("_n"))
    return join_null_safe(r, counts, [strata]).drop("_u")


def initial_split(df: DataFrame, strata: str, key: str, prop: float = 0.8, seed=2021,
                  col: str = "split", names=("training", "testing")) -> DataFrame:
    """B1: first floor(n_s * prop) rows of each stratum (hash order) -> training."""
    r = stratified_rank(df, strata, key, seed)
    cut = F.floor(F.col("_n") * prop)
    return r.withColumn(col, F.when(F.col("_rank") <= cut, F.lit(names[0])).otherwise(F.lit(names[1]))) \
        .drop("_rank", "_n")


def validation_split(train: DataFrame, strata: str, key: str, prop: float = 0.7, seed=2022) -> DataFrame:
    """B2: analysis / assessment inside the training rows (another salt)."""
    return initial_split(train, strata, key, prop, seed, col="subset", names=("analysis", "assessment"))


def vfold(df: DataFrame, strata: str, key: str, v: int = 10, seed=2023) -> DataFrame:
    """fold = (rank - 1) mod v + 1 within each stratum."""
    r = stratified_rank(df, strata, key, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % v + 1).cast("int")).drop("_rank", "_n")


def split_sizes(df: DataFrame, col: str) -> DataFrame:
    """B4 data-spending table."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def ranked_classes(df: DataFrame, label: str, key: str, seed) -> tuple[DataFrame, dict]:
    """Rows with ``_rank`` (1.. within the class, by md5 uniform then key), stored
    once, and the size of each class (a number a class, on the driver)."""
    d = df.withColumn("_u", uniform(seed, key))
    r = running_totals(d, ["_u", key], {"_rank": F.lit(1).cast("long")}, group=[label]).drop("_u").checkpoint(eager=True)
    return r, {x[0]: x[1] for x in r.groupBy(label).agg(F.max("_rank")).collect()}


def _by_class(label: str, values: dict) -> Column:
    """The value of a row's class; NULL is a class too."""
    of = F.lit(None)
    for c, v in values.items():
        of = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(v)).otherwise(of)
    return of


def downsample(df: DataFrame, label: str, key: str, seed=2024) -> DataFrame:
    """Every class cut to the minority size (hash order inside each class)."""
    r, sizes = ranked_classes(df, label, key, seed)
    return r.filter(F.col("_rank") <= min(sizes.values(), default=0)).drop("_rank")


def class_slots(r: DataFrame, label: str, levels: list[str], sizes: dict, need: dict) -> DataFrame:
    """Synthetic-row slots: (target class, slot k, class size) for k = 1..need(class).

    Slots are taken from the ranks of the largest class's own rows, so they
    are produced in parallel wherever those rows live."""
    wanted = [c for c in levels if need.get(c, 0) > 0]
    if not wanted:
        return r.limit(0).select(F.col(label).alias("_target"), F.col("_rank").alias("k"), F.col("_rank").alias("_nc"))
    biggest = min((c for c, n in sizes.items() if n == max(sizes.values())), key=str)
    gen = r.filter(F.col(label).eqNullSafe(F.lit(biggest))).select(F.col("_rank").alias("k"))
    targets = F.array(*[F.struct(F.lit(c).alias("t"), F.lit(need[c]).alias("need"), F.lit(sizes[c]).cast("long").alias("nc"))
                        for c in wanted])
    s = gen.withColumn("_s", F.explode(targets)).filter(F.col("k") <= F.col("_s.need"))
    return s.select(F.col("_s.t").alias("_target"), "k", F.col("_s.nc").alias("_nc"))


def upsample(df: DataFrame, label: str, key: str, levels: list[str], seed=2025) -> DataFrame:
    """Keep all rows and add, for each smaller class, (n_max - n_c) rows
    drawn with replacement (source rank from md5(seed|class|slot))."""
    r, sizes = ranked_classes(df, label, key, seed)
    most = max(sizes.values(), default=0)
    slots = class_slots(r, label, levels, sizes, {c: most - n for c, n in sizes.items()})
    pick = (F.floor(uniform(seed, F.col("_target"), F.col("k")) * F.col("_nc")) + 1).cast("long")
    slots = slots.select(F.col("_target").alias(label), pick.alias("_rank"))
    return r.unionByName(r.join(slots, [label, "_rank"])).drop("_rank")


def rose(df: DataFrame, label: str, key: str, numeric: list[str], levels: list[str], seed=2026,
         shrink: float = 1.0) -> DataFrame:
    """B8 ROSE smoothed bootstrap (Menardi & Torelli 2014): for every class,
    n_max rows drawn with replacement, numeric columns perturbed with
    Gaussian noise of bandwidth h_j = shrink * (4 / ((d + 2) n_c))^(1/(d+4)) * sd_j
    (per class); other columns copied.  Normals by Box-Muller from md5 uniforms."""
    d = len(numeric)
    r, sizes = ranked_classes(df, label, key, seed)
    most = max(sizes.values(), default=0)
    found = r.groupBy(label).agg(*[F.stddev_samp(c).alias(f"_sd_{i}") for i, c in enumerate(numeric)]).collect()  # a line a class
    slots = class_slots(r, label, levels, sizes, dict.fromkeys(sizes, most))
    pick = (F.floor(uniform(seed, F.col("_target"), F.col("k")) * F.col("_nc")) + 1).cast("long")
    slots = slots.select(F.col("_target").alias(label), pick.alias("_rank"), F.col("k").alias("_slot"), "_nc")
    base = r.join(slots, [label, "_rank"])
    cf = shrink * (4.0 / (d + 2)) ** (1.0 / (d + 4))
    h = F.lit(cf) * F.pow(F.col("_nc").cast("double"), -1.0 / (d + 4))
    out = {}
    for j, c in enumerate(numeric):
        u1 = 1 - uniform(seed, F.lit("n1"), F.col(label), F.col("_slot"), F.lit(j))
        u2 = uniform(seed, F.lit("n2"), F.col(label), F.col("_slot"), F.lit(j))
        z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
        out[c] = F.col(c) + h * _by_class(label, {x[0]: x[j + 1] for x in found}).cast("double") * z
    return base.withColumns(out).drop("_rank", "_nc").withColumnRenamed("_slot", "synthetic_id")


def class_balance(frames: dict[str, DataFrame], label: str) -> DataFrame:
    """Class counts and share per balancing result."""
    from .frames import bind_rows_id
    counts = {k: v.groupBy(label).agg(F.count(F.lit(1)).alias("n")) for k, v in frames.items()}
    u = bind_rows_id(counts, "recipe")
    tot = u.groupBy("recipe").agg(F.sum("n").alias("_t"))
    return u.join(tot, "recipe").withColumn("share", F.col("n") / F.col("_t")).drop("_t")
