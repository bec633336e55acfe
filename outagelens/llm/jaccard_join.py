"""Exact n-gram Jaccard self-join of documents by multiple-global-order prefix filtering.

Documents with equal shingle sets are one class. Two sets whose Jaccard
similarity reaches the threshold share a token in their prefixes under *every*
global order of the tokens; a candidate must pass that filter under three
orders before its sets are compared. The first order puts rare shingles first
and generates the candidates; the other two are random orders.

Only connectivity is reported, so similar classes need not be paired with each
other: every posting list first tests its members against a few leaders, and
only members that are then still in different components are tested pair by
pair: a join within size classes whose condition is on sizes, positions and
fixed-width sketches alone, then the filters of the other orders and the whole
sets for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U64, connected_components, discard, mix, stored, text_slices, texts_of, window_hashes, word_codes, word_hashes

WIDTH = 5
PERCENT = 80
HEAVY = 1 << 22    # shingles known as frequent at most (they only sort last in the first order)
BUCKETS = 1 << 20  # ids are hashed to so many buckets for the broadcast filters
KEY_BITS = 48      # of a shingle hash; with the text's number above it sorts as one integer
SLICE = 1 << 16    # texts handled together
SLICE_BYTES = 8 << 20
SKETCH = 8         # 64-bit words of a set's parity sketch
LEADERS = 4        # of a posting list, in each round
ROUNDS = 3


# ---------------------------------------------------------------- shingle sets of a batch

def shingles(texts: pa.Array, width: int = WIDTH):
    """Distinct shingles of each of at most ``SLICE`` texts: (text numbers, hashes of ``KEY_BITS``), sorted by both.

    Letters A-Z count as a-z. A text with fewer words than ``width`` has its
    whole sequence as one shingle, a text without words none.
    """
    starts, codes, words = word_codes(pc.ascii_lower(texts))
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)), n)
    hashes = word_hashes(words)[codes] if len(words) else np.zeros(0, U64)
    keys = window_hashes(hashes, width)
    inside = text[:len(keys)] == text[width - 1:] if len(keys) else np.zeros(0, bool)
    owner, keys = text[:len(keys)][inside], keys[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = [mix(window_hashes(hashes[starts[i]:starts[i + 1]], int(n[i])) ^ U64(int(n[i])))[0] for i in short]
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, np.array(whole, U64)])
    keys = keys >> U64(64 - KEY_BITS)
    both = np.sort((owner.astype(U64) << U64(KEY_BITS)) | keys)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both >> U64(KEY_BITS)).astype(np.int64), both & U64((1 << KEY_BITS) - 1)


def ranked(owner: np.ndarray, ranks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ``size[i]`` smallest ranks of each text ``i``, in order; owners are sorted."""
    both = np.sort((owner.astype(U64) << U64(KEY_BITS)) | ranks)
    first = np.searchsorted(owner, np.arange(len(size)))
    return both[np.arange(len(both)) - first[owner] < size[owner]]


def class_ids(owner: np.ndarray, keys: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, ids): equal sets have equal 64-bit ids."""
    edge = np.searchsorted(owner, np.arange(n_texts + 1))
    with np.errstate(over="ignore"):
        one = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys), dtype=U64)])
        two = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
        n = np.diff(edge)
        return n, mix((one[edge[1:]] - one[edge[:-1]]) ^ mix((two[edge[1:]] - two[edge[:-1]]) + n.astype(U64))).view(np.int64)


def prefix_length(n, percent: int):
    """Tokens of a set of size n that must hold one common with any similar set, under any order."""
    return n - (percent * n + 99) // 100 + 1


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = texts_of(pa.concat_arrays([batch.column(0)]))
            owner, keys = shingles(texts, width)
            n, cid = class_ids(owner, keys, len(texts))
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(cid, mask=n == 0),
                 pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())],
                names=["id", "n", "cid", "shingle", "times"])
            _, first = np.unique(cid, return_index=True)  # a set counts once in a batch
            own = np.isin(owner, first)
            heavy, times = np.unique(keys[own], return_counts=True)
            heavy, times = heavy[times > 1], times[times > 1]
            none = pa.nulls(len(heavy), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(heavy.view(np.int64)), pa.array(times)],
                                             names=["id", "n", "cid", "shingle", "times"])
    return run


def frequent_shingles(signatures: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles and their rank by powers of two, at most ``HEAVY`` of them.

    Counts are of shingles that a batch has in two sets or more, so a shingle
    of many sets is found whatever the number of batches. They only shape an
    order; any order gives the same result.
    """
    counts = stored(signatures.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")), "heavy")
    rank = F.floor(F.log2("times")).cast("int")
    sizes = {r["rank"]: r["count"] for r in counts.groupBy(rank.alias("rank")).count().collect()}  # at most 63 rows
    least, room = 64, HEAVY
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            break
        least, room = k, room - sizes[k]
    table = counts.where(rank >= least).select("shingle", rank.alias("rank")).toArrow()
    keys = table.column("shingle").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], table.column("rank").to_numpy()[order].astype(np.uint8)


def _first_order(keys: np.ndarray, heavy) -> np.ndarray:
    """Rank under the first order, which is also the token's name: six bits of its frequency, then a hash."""
    have, rank = heavy
    out = mix(keys) >> U64(64 - KEY_BITS + 6)
    if len(have):
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        out |= np.where(have[at] == keys, rank[at], 0).astype(U64) << U64(KEY_BITS - 6)
    return out


def _random_order(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix(keys ^ U64(salt)) >> U64(64 - KEY_BITS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SLICE`` texts of some ``SLICE_BYTES`` together, which bounds what a task holds."""
    for batch in text_slices(batches, SLICE_BYTES):
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def _postings(width: int, percent: int, shared):
    """(token, cid, n, pos): prefix tokens of each set under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = texts_of(pa.concat_arrays([batch.column(0)]))
            owner, keys = shingles(texts, width)
            n, cid = class_ids(owner, keys, len(texts))
            _, first = np.unique(cid, return_index=True)
            size = np.zeros(len(n), np.int64)
            size[first] = np.where(n[first] > 0, prefix_length(n[first], percent), 0)
            both = ranked(owner, _first_order(keys, shared.value), size)
            owner = (both >> U64(KEY_BITS)).astype(np.int64)
            pos = np.arange(len(both)) - np.searchsorted(owner, np.arange(len(n)))[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array((both & U64((1 << KEY_BITS) - 1)).view(np.int64)), pa.array(cid[owner]), pa.array(n[owner].astype(np.int32)),
                 pa.array(pos.astype(np.int32))], names=["token", "cid", "n", "pos"])
    return run


def parity_sketch(owner: np.ndarray, keys: np.ndarray, n_texts: int) -> np.ndarray:
    """``SKETCH`` 64-bit words for each text: every token flips one bit.

    Two sketches differ in at most as many bits as the symmetric difference of
    their sets has tokens, so a pair whose sketches differ more is no link.
    """
    bits = 64 * SKETCH
    out = np.zeros((n_texts, SKETCH), np.int64)
    step = max(1, (8 << 20) // bits)
    for low in range(0, n_texts, step):
        high = min(n_texts, low + step)
        a, b = np.searchsorted(owner, [low, high])
        at = (owner[a:b] - low) * bits + (mix(keys[a:b] ^ U64(0x2545F4914F6CDD1D)) >> U64(32)).astype(np.int64) % bits
        odd = (np.bincount(at, minlength=(high - low) * bits) & 1).astype(np.uint8)
        out[low:high] = np.packbits(odd.reshape(high - low, bits), axis=1).view(np.int64)
    return out


def _sets(width: int, percent: int, whole: bool):
    """(cid, n, tokens) with the whole sets, or (cid, n, the sketch, p2, p3) with the prefixes under the two random orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = texts_of(pa.concat_arrays([batch.column(0)]))
            owner, keys = shingles(texts, width)
            n, cid = class_ids(owner, keys, len(texts))
            if whole:
                names, starts = ["tokens"], np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                parts = [pa.ListArray.from_arrays(pa.array(starts), pa.array(keys.view(np.int64)))]
            else:
                names, parts = [*SKETCHED, "p2", "p3"], [pa.array(np.ascontiguousarray(x)) for x in parity_sketch(owner, keys, len(texts)).T]
                size = np.where(n > 0, prefix_length(n, percent), 0)
                starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                low = U64((1 << KEY_BITS) - 1)
                for salt in (0xA0761D64, 0xE7037ED1):
                    # 31 bits are enough for the random orders: a collision only lets a candidate through
                    own = ((ranked(owner, _random_order(keys, salt), size) & low) >> U64(KEY_BITS - 31)).astype(np.int32)
                    parts.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(own)))
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n.astype(np.int32)), *parts],
                                             names=["cid", "n", *names]).filter(pa.array(n > 0))
    return run


SKETCHED = [f"s{k}" for k in range(SKETCH)]


def sketches_pass(percent: int) -> str:
    """Sides x and y differ in no more bits than a similar pair differs in tokens."""
    return f"{100 + percent} * ({' + '.join(f'bit_count(x.{s} ^ y.{s})' for s in SKETCHED)}) <= {100 - percent} * (x.n + y.n)"


def _within(frame: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows whose hashed id may be in ``ids``: a semi-join with at most ``BUCKETS`` broadcast rows; false hits remain."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    wanted = ids.select(bucket(F.col(col)).alias("_bucket")).distinct()
    return frame.withColumn("_bucket", bucket(F.col(col))).join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))


def orders_pass(percent: int) -> str:
    """The filters of the second and third order, on sides x and y.

    Both prefixes must share a token. Beyond that, below the smaller of the two
    last ranks both prefixes are complete, so the tokens there that only one
    side has are part of the difference of the sets, which is bounded.
    """
    def part(p: str) -> str:
        own = [f"filter({s}.{p}, t -> t < least(element_at(x.{p}, -1), element_at(y.{p}, -1)))" for s in "xy"]
        return (f"arrays_overlap(x.{p}, y.{p}) and {100 + percent} * (size(array_union({own[0]}, {own[1]})) - size(array_intersect({own[0]}, {own[1]})))"
                f" <= {100 - percent} * (x.n + y.n)")
    return f"{part('p2')} and {part('p3')}"


def _joined(pairs: DataFrame, table: DataFrame, condition: str) -> DataFrame:
    """Pairs (a, b) whose rows of a table of classes meet a condition on x and y.

    Both sides are the same frame, so that Spark shuffles the rows once for the two joins.
    """
    own = _within(table, "cid", _ends(pairs))
    x = pairs.join(own.alias("x"), F.col("a") == F.col("x.cid"))
    return x.join(own.alias("y"), F.col("b") == F.col("y.cid")).where(condition).select("a", "b").distinct()


def _relabel(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after the components that the links join have become one."""
    ends = (links.join(labels.select(F.col("cid").alias("a"), F.col("label").alias("la")), "a")
            .join(labels.select(F.col("cid").alias("b"), F.col("label").alias("lb")), "b"))
    merged = connected_components(ends, "la", "lb", name)
    return stored(labels.join(merged.select(F.col("v").alias("label"), "component"), "label", "left")
                  .select("cid", F.coalesce("component", "label").alias("label")), f"{name}-labels")


def similar_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, n, cid) of all rows, and (cid, label) of the classes in a posting list with others.

    Classes with one label are connected by links of ``percent`` or more.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text_col), F.col(id_col).cast("long").alias("id"))
    found = stored(source.mapInArrow(_signatures(width), "id long, n long, cid long, shingle long, times long"), "jaccard-sig")
    rows = found.where("shingle is null").select("id", "n", "cid")
    heavy = spark.sparkContext.broadcast(frequent_shingles(found))
    named = source.where("id is not null")

    postings = named.mapInArrow(_postings(width, percent, heavy), "token long, cid long, n int, pos int").repartition("token")
    own = Window.partitionBy("token")  # one shuffle of the postings; the lists of one class go
    lists = stored(postings.select("*", F.min("cid").over(own).alias("low"), F.max("cid").over(own).alias("high"))
                   .where("low <> high").drop("low", "high").distinct(), "jaccard-lists")
    labels = stored(lists.select("cid", F.col("cid").alias("label")).distinct(), "jaccard-labels")
    first = rows.where("id is not null and n > 0").groupBy("cid").agg(F.min("id").alias("id"))
    first = stored(first.join(labels.select("cid"), "cid", "left_semi"), "jaccard-first")
    prefixes = stored(_within(named, "id", first).mapInArrow(
        _sets(width, percent, False), f"cid long, n int, {', '.join(f'{s} long' for s in SKETCHED)}, p2 array<int>, p3 array<int>"),
        "jaccard-prefixes")
    orders = f"{sketches_pass(percent)} and {orders_pass(percent)}"

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """The similar ones of some pairs: sketches, second and third order first, then whole sets, read for what is left."""
        left = stored(_joined(pairs, prefixes, orders), f"{name}-left")
        ids = _ends(left).distinct()
        texts = _within(named, "id", first.join(ids, "cid", "left_semi"))
        sets = stored(texts.mapInArrow(_sets(width, percent, True), "cid long, n int, tokens array<long>"), f"{name}-sets")
        same = f"{100 + percent} * size(array_intersect(x.tokens, y.tokens)) >= {percent} * (x.n + y.n)"
        found = stored(_joined(left, sets, same), f"{name}-links")
        discard(left, sets)
        return found

    tested, last = None, lists
    for k in range(ROUNDS):
        now = lists.join(labels, "cid") if k else lists.withColumn("label", F.col("cid"))  # at first each class is its own label
        # 24 bits choose well enough, and these structs are most of what the round shuffles
        chance = lambda i: F.shiftrightunsigned(F.xxhash64("cid", F.lit(LEADERS * k + i)), 40)  # noqa: B023, E731
        leader = [F.min(F.struct(chance(i).alias("h"), "cid", "label", "n")) for i in range(LEADERS)]
        groups = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.array_distinct(F.transform(
            F.array(*leader), lambda s: s.dropFields("h"))).alias("leaders")).where("low <> high").drop("low", "high")
        now = stored(now.join(groups, "token"), f"jaccard-round{k}")
        discard(last)
        last = now
        pairs = (now.select("cid", "label", "n", F.explode("leaders").alias("lead")).where("label <> lead.label")
                 .where(f"{percent} * greatest(n, lead.n) <= 100 * least(n, lead.n)")
                 .select(F.least("cid", "lead.cid").alias("a"), F.greatest("cid", "lead.cid").alias("b")).distinct())
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"jaccard-pairs{k}")
        labels = _relabel(labels, links(pairs, f"jaccard{k}"), f"jaccard{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        # a leader has now met all of its list: it leaves
        lists = now.where(~F.exists("leaders", lambda s: s["cid"] == F.col("cid"))).select("token", "cid", "n", "pos")

    # what is left: pairs of different labels, each at its first common token only
    now = lists.join(labels, "cid")
    groups = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
    now = now.join(groups.where("low <> high").select("token", "least"), "token")
    now = stored(now.where(f"{100 + percent} * (n - pos) >= {percent} * (n + least)").select("token", "cid", "label", "n", "pos"), "jaccard-rest")
    sketches = _within(prefixes.select("cid", *SKETCHED), "cid", now.select("cid")).dropDuplicates(["cid"])
    # sizes of a similar pair lie in one class or in adjacent ones
    side = now.join(sketches, "cid").withColumn("class", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9))
    x = side.withColumn("class", F.explode(F.array("class", F.col("class") + 1))).alias("x")
    pairs = x.join(side.alias("y"), ["token", "class"]).where(
        f"x.label <> y.label and (x.n < y.n or x.n = y.n and x.cid < y.cid) and 100 * x.n >= {percent} * y.n"
        f" and {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n) and {sketches_pass(percent)}")
    pairs = pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-last")
    return rows, _relabel(labels, links(pairs, "jaccard-end"), "jaccard-end")


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    ``component_id`` is the smallest id reachable over links of
    ``percent`` / 100 or more Jaccard similarity between the sets of distinct
    ``width``-word shingles. The result is exact up to collisions of 48-bit
    hashes: no candidate is dropped, whatever the size of a list or a group.

    Null, empty and wordless texts have the empty set and are linked with
    nothing; rows with a null id keep their count, link with nothing and have a
    null component; repeated ids stay repeated rows (one vertex for each
    distinct set); ties and other columns do not matter; an empty table gives an
    empty result.
    """
    rows, labels = similar_classes(docs, width, percent, id_col, text_col)
    least = rows.where("id is not null and n > 0").groupBy("cid").agg(F.min("id").alias("id"))
    roots = least.join(labels, "cid", "left").select("cid", "id", F.coalesce("label", "cid").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = roots.join(smallest, "root").select("cid", "component_id")
    return rows.join(of_class, "cid", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.expr("case when id is not null then coalesce(component_id, id) end").alias("component_id"))
