"""Row-level helpers: filters, first-per-key, duplicates, ranking, sampling,
row numbering, unions (SURVEY 2.3, 2.5 A8/A9, 2.7, 2.8, P11).

Scale notes
-----------
* ``first_per_key`` is a grouped ``min(struct(order..., rest...))``: partial
  aggregation runs map-side, so a key holding a third of all rows is reduced
  before the shuffle instead of landing in one window task.
* ``row_ids`` numbers rows 1..n in a global order without a single-partition
  window: range-partition by the full order, number inside each partition, and
  add per-partition offsets (a table with one row per partition).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import uniform


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


# ------------------------------------------------------------------ F ----


def not_in_keep_na(c, values: Iterable) -> Column:
    """F4, R form: ``!x %in% list`` keeps NA rows."""
    col = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(col.isin(list(values)), F.lit(False))


def any_true(cols: Iterable[Column]) -> Column:
    """F8: ``if_any`` across columns (NULL counts as not true)."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cols])


def at_latest(df: DataFrame, col: str) -> DataFrame:
    """keep rows at the global latest value of ``col``.

    The maximum is a scalar subquery (one value), evaluated once; Spark's
    ``max`` skips NULLs where R would return NA."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


# ------------------------------------------------------------- A8 / A9 ----


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A8 ``distinct(k, .keep_all=TRUE)`` with an explicit order: the row with
    the smallest ``order`` tuple per key (ascending, NULLs first)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_r"))
    out = best.select(*keys, *[F.col(f"_r._o{i}").alias(c) for i, c in enumerate(order)],
                      *[F.col(f"_r.{c}").alias(c) for c in rest])
    return out.select(*df.columns)


def dupes(df: DataFrame, keys: list[str]) -> DataFrame:
    """A9 ``get_dupes``: rows whose key occurs more than once, with dupe_count.

    Counting is a partial aggregate; the join back is an equi join that AQE's
    skew handling can split."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dupe_count")).filter(F.col("dupe_count") > 1)
    return df.join(counts, keys, "inner")


# ------------------------------------------------------------------ T ----


def top_n_with_ties(df: DataFrame, group: list[str], value: str, n: int, desc: bool = True) -> DataFrame:
    """T2 ``slice_max(value, n, with_ties=TRUE)`` (``desc=False``: slice_min):
    rows with rank() <= n per group.

    rank = 1 + rows strictly before the value: distinct values per group are
    counted (partial aggregation), numbered with the distributed running
    totals, and joined back - no window holds a whole group.  NULL values
    rank last and tie with each other: a group with fewer than ``n`` values
    keeps its NULL rows."""
    g = list(group or [])
    vals = df.groupBy(*g, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
    vals = vals.withColumns({"_nl": F.col("_v").isNull(), "_ov": -F.col("_v") if desc else F.col("_v")})
    rt = running_totals(vals, ["_nl", "_ov"], {"_cum": F.col("_cnt")}, group=g)
    keep = rt.filter(F.col("_cum") - F.col("_cnt") + 1 <= n).select(*g, "_v")
    return join_null_safe(df.withColumn("_v", F.col(value)), keep, [*g, "_v"]).drop("_v")


def top_one(df: DataFrame, group: list[str], value: str, desc: bool = True, tiebreak: list[str] | None = None
            ) -> DataFrame:
    """T3 ``slice_max(value, n = 1)`` with a unique tie-break: one row per
    group, chosen by a grouped ``min(struct(...))`` (map-side partial
    aggregation; a group with a third of all rows is reduced before the
    shuffle).  ``desc`` needs a numeric ``value``."""
    key = (-F.col(value)) if desc else F.col(value)
    d = df.withColumn("_sk", F.when(F.col(value).isNull(), F.lit(None)).otherwise(key))
    d = d.withColumn("_nl", F.col(value).isNull())  # NULL values last
    return first_per_key(d, list(group), ["_nl", "_sk", *(tiebreak or [])]).drop("_nl", "_sk")


def slice_rows(df: DataFrame, group: list[str], order: list[str], lo: int, hi: int) -> DataFrame:
    """F10 ``slice(lo:hi)`` inside each group by an explicit total order
    (position from the distributed running count)."""
    r = running_totals(df, order, {"_rn": F.lit(1).cast("long")}, group=group)
    return r.filter(F.col("_rn").between(lo, hi)).drop("_rn")


def sample_n(df: DataFrame, n: int, seed, key: list[str]) -> DataFrame:
    """T4 ``slice_sample(n)``: the n rows with the smallest md5(seed|key)
    uniform; a top-k (TakeOrderedAndProject), deterministic across runs."""
    u = uniform(seed, *key)
    return df.withColumn("_u", u).orderBy("_u", *key).limit(n).drop("_u")


# ------------------------------------------------------------------ P11 ---


def row_ids(df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """P11 ``rowid_to_column``: consecutive 1-based ids in ``order`` (must be
    a total order).  No single-partition window over the data: rows are
    range-partitioned by ``order``, sorted inside each partition, checkpointed,
    and numbered as partition offset + position in the partition."""
    spark = df.sparkSession
    # without an explicit count AQE may merge adjacent (still ordered) range partitions
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order)
    # Sizes and ids below read the data twice; a reliable checkpoint (shared
    # checkpoint dir) pins partition contents and order so both reads agree,
    # also when the input is not deterministic or an executor is lost.
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    ordered = ordered.checkpoint(eager=True)
    tagged = ordered.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    # one row per partition: a bounded table
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local + 1)
            .drop("_pid", "_mid", "_off"))


# ------------------------------------------------------------------ U ----


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """Union all by name, missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def bind_rows_id(frames: dict[str, DataFrame], id_col: str) -> DataFrame:
    """U2 ``map_dfr(.id=)``: union of named results with the name as a column."""
    return bind_rows(*[df.select(F.lit(k).alias(id_col), *df.columns) for k, df in frames.items()])


def sorted_slices(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``, pinned by a reliable
    checkpoint, with the partition number as ``_pid``.  Without an explicit
    count AQE may merge adjacent (still ordered) partitions."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).checkpoint(eager=True).withColumn("_pid", F.spark_partition_id())


def run_starts(batch: pa.RecordBatch, names: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """True where a row's keys differ from the row before it (``before``: the
    row ahead of the batch; without one, the first row starts a run).  NULL
    equals NULL and NaN equals NaN, as in a Spark grouping."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        col = batch.column(name)
        if before is not None:
            col = pa.concat_arrays([before.column(name), col])
        left, right = col.slice(0, len(col) - 1), col.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(left, right), False), pc.xor(left.is_null(), right.is_null()))
        if pa.types.is_floating(col.type):
            nans = pc.and_(pc.fill_null(pc.is_nan(left), False), pc.fill_null(pc.is_nan(right), False))
            differ = pc.and_(differ, pc.invert(nans))
        starts[len(starts) - len(differ):] |= differ.to_numpy(zero_copy_only=False)
    if before is None:
        starts[0] = True
    return starts


def partition_edges(slices: DataFrame, group: list[str], tails, types: list[T.DataType]) -> DataFrame:
    """One row per non-empty partition: ``_pid``, the group of its first row
    (``_h0``...) and of its last row (``_t0``...), and what ``tails(batches)``
    finds for the last run (``_s0``... of ``types``)."""
    kinds = [slices.schema[g].dataType for g in group]
    fields = ([T.StructField("_pid", T.IntegerType())]
              + [T.StructField(f"_{side}{i}", k) for side in "ht" for i, k in enumerate(kinds)]
              + [T.StructField(f"_s{i}", k) for i, k in enumerate(types)])

    def run(batches):
        ends = []

        def watched():
            for batch in batches:
                if batch.num_rows:
                    ends[:] = [ends[0] if ends else batch.slice(0, 1), batch.slice(batch.num_rows - 1, 1)]
                    yield batch

        found = tails(watched())
        if ends:
            cols = [ends[0].column("_pid")] + [e.column(g) for e in ends for g in group]
            yield pa.RecordBatch.from_arrays([*cols, *found], names=[f.name for f in fields])

    return slices.mapInArrow(run, T.StructType(fields))


def follows_previous(group: list[str]) -> Column:
    """On ``partition_edges`` rows: the first group of a partition is the last
    group of the partition before.  The window is over one row per partition."""
    w = Window.orderBy("_pid")
    same = [F.lag(f"_t{i}").over(w).eqNullSafe(F.col(f"_h{i}")) for i in range(len(group))]
    return reduce(lambda a, b: a & b, same, F.lag("_pid").over(w).isNotNull())


def _run_sums(batches, names: list[str], values: list[str]):
    """(batch, run number, running sums) per batch, the sums restarting with each run of equal keys."""
    before, runs, acc = None, 0, [0] * len(values)
    for batch in batches:
        if not batch.num_rows:
            continue
        local = np.cumsum(run_starts(batch, names, before))
        sums = []
        for i, v in enumerate(values):
            x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False)
            c = pd.Series(x).groupby(local).cumsum().to_numpy()
            c = c + np.where(local == 0, acc[i], np.zeros(1, x.dtype))
            acc[i] = c[-1]
            sums.append(c)
        yield batch, runs + local, sums
        runs, before = runs + int(local[-1]), batch.slice(batch.num_rows - 1, 1)


def running_totals(df: DataFrame, order: list[str], sums: dict[str, Column], group: list[str] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` within ``group``.

    One shuffle of the data: rows are range-partitioned by (group, order) and
    checkpointed, so groups are contiguous and only the group at the head of
    a partition can continue from earlier ones.  Each partition sums its own
    runs in place (Arrow batches, no exchange); one carry row per partition
    is broadcast and added to the head run.  No group is held by one task.

    Integral sums are longs, others doubles; NULL counts as 0; a NULL group
    is a group too."""
    group = list(group or [])
    base = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    values = [f"_v_{k}" for k in sums]
    whole = {v: isinstance(base.schema[v].dataType, T.IntegralType) for v in values}
    base = base.withColumns({v: F.col(v).cast("long" if whole[v] else "double") for v in values})
    slices = sorted_slices(base, group + order, partitions)
    kinds = [slices.schema[v].dataType for v in values]
    names = ["_pid", *group]

    def tails(batches):
        out = [np.zeros(1)] * len(values)
        for _, _, found in _run_sums(batches, names, values):
            out = [c[-1:] for c in found]
        return [pa.array(c) for c in out]

    def run(batches):
        for batch, runs, found in _run_sums(batches, names, values):
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found), pa.array(runs == 1)], names=schema.names)

    schema = T.StructType([*slices.schema.fields, *[T.StructField(f"_c{i}", k) for i, k in enumerate(kinds)],
                           T.StructField("_head", T.BooleanType())])
    edges = partition_edges(slices.select(*names, *values), group, tails, kinds)
    upto = Window.partitionBy(*[f"_t{i}" for i in range(len(group))]).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, 0)
    edges = edges.withColumns({f"_u{i}": F.sum(f"_s{i}").over(upto) for i in range(len(values))})
    w = Window.orderBy("_pid")
    carry = edges.select("_pid", *[F.when(follows_previous(group), F.lag(f"_u{i}").over(w)).otherwise(0).alias(f"_o{i}")
                                   for i in range(len(values))])
    out = slices.mapInArrow(run, schema).join(F.broadcast(carry), "_pid")
    out = out.withColumns({k: F.col(f"_c{i}") + F.when(F.col("_head"), F.col(f"_o{i}")).otherwise(0)
                           for i, k in enumerate(sums)})
    return out.drop("_pid", "_head", *values, *[f"_{p}{i}" for i in range(len(values)) for p in "co"])


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where NULL matches NULL (R joins NA to NA; a
    NULL group key must find its own statistics).  Keeps ``a``'s key columns."""
    b2 = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b2[f"_r_{k}"]) for k in keys])
    return a.join(b2, cond, how).drop(*[f"_r_{k}" for k in keys])
