"""Helpers shared by the operators: shared-folder tables, Arrow word splitting,
hash mixing and connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_sources

U64 = np.uint64


# ---------------------------------------------------------------- tables

def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; removed when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation.
    Nothing reads the shuffles of the write again, so Spark removes them when it
    has ended instead of when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads again."""
    for table in tables:
        jvm, files = table.sparkSession.sparkContext._jvm, table.inputFiles()
        if files:
            where = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if not where.getName().startswith("llm-"):
                raise ValueError(f"not a table written by stored(): {where}")
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once a session, so that tasks can import it."""
    return ship_sources(spark)


def quoted(names: list[str]) -> list[str]:
    """Column names that are safe in ``select`` whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def ddl(frame: DataFrame, names: list[str]) -> str:
    """Schema text of some columns, each followed by a comma."""
    kinds = dict(frame.dtypes)
    return "".join(f"{q} {kinds[n]}, " for n, q in zip(names, quoted(names)))


# ---------------------------------------------------------------- words

def texts_of(column) -> pa.Array:
    """A string column of a record batch without nulls (null: empty) as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(batches, limit: int = 6 << 20):
    """Record batches cut so that the texts of their first column have about ``limit`` bytes, which bounds what a task holds."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            done = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def word_codes(texts: pa.Array):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns (starts, codes, words): text ``i`` has the words
    ``words[codes[starts[i]:starts[i + 1]]]``; ``words`` holds distinct strings.
    """
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:  # white space at either end of a text leaves empty strings
        keep = codes != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], before[offsets]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return offsets, codes, words


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the segments given by ``starts``."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (xor-shift and multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(29))) * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; equal strings hash alike in every task."""
    from pandas.util import hash_array

    if not len(words):
        return np.zeros(0, U64)
    return hash_array(np.array(words.to_pylist(), dtype=object), categorize=False).astype(U64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive values (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for k in range(width):
            out = out * U64(0x100000001B3) + hashes[k:k + n]
            out ^= out >> U64(29)
    return mix(out)


# ---------------------------------------------------------------- components

FINISH = 200_000  # edges that one task may finish


def _finish(batches):
    """Components of a small graph in one task: (v, r) with the smallest vertex as r."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        root.setdefault(v, v)
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    own = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(v) for v in own], pa.int64())], names=["v", "r"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph: rows (v, component), component = smallest vertex.

    ``edges`` has two long columns; loops, repeated and null edges are allowed
    (null ends are ignored, a loop only makes its vertex known). Each round every
    vertex joins the neighbour with the smallest (hash, id) pair of the round
    unless its own is smaller, and the graph is contracted; the expected number
    of rounds is logarithmic. Grouped minima combine on the map side and the
    joins are plain equi-joins that adaptive execution can split, so a vertex
    with very many edges is no hot spot. Every round is a stored table. Once at
    most ``FINISH`` edges are left, one task finishes.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    raw = stored(raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    vertices = raw.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    current = raw.where("a <> b")
    labels = None
    step = 0
    while (left := current.count()) > 0:
        if left <= FINISH:
            target = current.select("a", "b").coalesce(1).mapInArrow(_finish, "v long, r long")
        else:
            pick = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("id"))
            sides = current.select(F.col("a").alias("v"), pick("b").alias("n")).unionByName(
                current.select(F.col("b").alias("v"), pick("a").alias("n")))
            target = sides.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least(F.col("n"), pick("v")).getField("id").alias("r"))
        target = stored(target, f"{name}-map{step}")
        labels = target if labels is None else stored(
            labels.join(target.select(F.col("v").alias("r"), F.col("r").alias("r2")), "r", "left")
            .select("v", F.coalesce("r2", "r").alias("r")), f"{name}-labels{step}")
        if left <= FINISH:
            break
        ends = target.select(F.col("v").alias("a"), F.col("r").alias("ra"))
        other = target.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        current = stored(
            current.join(ends, "a").join(other, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            f"{name}-edges{step + 1}")
        step += 1
    if labels is None:
        return vertices.select("v", F.col("v").alias("component"))
    least = labels.groupBy("r").agg(F.least(F.min("v"), F.col("r")).alias("component"))
    linked = labels.join(least, "r").select("v", "component")
    return vertices.join(linked, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
