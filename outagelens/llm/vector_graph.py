"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to cluster shards, each to its nearest two; every shard builds
a pruned neighbour graph of its own members, the adjacency lists of a vector
are united over its shards, and in every shard each vector is searched from the
shard's medoids: a greedy walk to its surroundings, then an expansion over all
vectors in range. Dense shards are compared block by block instead. The search
then leaves the shard: a vector visits, as a guest, the first shards of the
vectors it is linked with and of those they are linked with, is compared there
with all members, and goes on until no round shows it another shard. Pairs found
are verified in double precision. Shards have a bounded size; an audit measures
recall against brute force, over all links and for each vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, connected_components, mix, stored

SHARD = 1500            # vectors a shard should have (before the overlap)
MOST = 6000             # vectors a shard may have; larger ones are split again
CENTRES = 512           # centres of one split, at most
SAMPLE = 20_000         # vectors that centres are fitted to, at most
LEVELS = 8              # splits of one shard at most; then its vectors are dealt by hash
DEGREE, NEAR, FAR, ALPHA = 24, 48, 8, 1.2   # degree bound, near candidates for pruning, random far edges, slack of the rule
PER_MEDOID = 32         # members of a shard for each medoid that a search starts from
BEAM = 24               # of the greedy walk
DENSE = 0.1             # share of the members in range of a member from which a shard is compared whole
BLOCK = 1024            # vectors compared with a shard at a time
AUDIT = 200             # vectors compared with all others by brute force


# ---------------------------------------------------------------- shards

def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-30), centres)
    return centres


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deal(vectors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rid, x, w, shard, own): each unit vector in the shards of its two nearest centres; ``own`` marks its first shard.

    Shards that are too large are split in further rounds by centres of their
    own; the parts of a last split that has no effect are dealt by hash. The
    second table has the visits (rid, shard) that bring every vector of such a
    shard to all its parts (None: there is no such shard).
    """
    todo = vectors.withColumn("shard", F.lit(0).cast("long")).withColumn("own", F.lit(True))
    done = None
    for level in range(LEVELS + 1):
        sizes = stored(todo.groupBy("shard").count(), f"graph-sizes{level}")
        large = sizes.where(f"count > {MOST if level else SHARD}")
        fine = todo.join(sizes.where(f"count <= {MOST if level else SHARD}").select("shard"), "shard")
        done = fine if done is None else done.unionByName(fine)
        if large.isEmpty():
            return done, None
        todo = todo.join(large, "shard")
        if level == LEVELS:
            parts = F.ceil(F.col("count") / MOST).cast("int")
            part = lambda k: F.abs(F.xxhash64("shard", k) / 2).cast("long")
            mine = F.pmod(F.xxhash64("rid"), parts).cast("int")
            rest = todo.withColumn("shard", part(mine)).drop("count")
            others = todo.select("rid", "shard", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("k"))
            return done.unionByName(rest), others.where("k <> mine").select("rid", part(F.col("k")).alias("shard"))
        # a bounded sample of each large shard; hashes make it the same on a second run
        share = F.lit(float(SAMPLE)) / F.col("count")
        draw = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = todo.where(draw < share).select("shard", "count", "x")

        def centres(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(group))
            x = _matrix(table.column("x"))
            k = int(min(CENTRES, max(2, -(-table.column("count")[0].as_py() // SHARD)), len(x)))
            c = fit_centres(x, k)
            yield pa.RecordBatch.from_arrays([table.column("shard").combine_chunks().slice(0, 1), pa.array([c.ravel().tolist()], pa.list_(pa.float64()))],
                                             names=["shard", "centres"])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("x"))
                shard = batch.column("shard").to_numpy()
                pairs = np.full((len(x), 2), -1, np.int64)
                where = batch.column("centres")
                for s in np.unique(shard):
                    mine = np.flatnonzero(shard == s)
                    c = np.array(where[int(mine[0])].as_py()).reshape(-1, x.shape[1])
                    near = np.argsort(-(x[mine] @ c.T), axis=1, kind="stable")[:, :2]
                    ids = (mix(np.arange(len(c), dtype=U64) + (mix(np.array([s], np.int64).view(U64) + U64(level)))) >> U64(1)).view(np.int64)
                    pairs[mine, :near.shape[1]] = ids[near]
                for k in (0, 1):
                    own = pc.and_(batch.column("own"), pa.scalar(k == 0))
                    part = pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("rid", "x", "w")), pa.array(pairs[:, k]), own],
                                                      names=["rid", "x", "w", "shard", "own"])
                    yield part.filter(pa.array(pairs[:, k] >= 0))

        fitted = stored(sample.groupBy("shard").applyInArrow(centres, "shard long, centres array<double>"), f"graph-centres{level}")
        dealt = todo.join(fitted, "shard").select("rid", "x", "w", "shard", "own", "centres").mapInArrow(
            assign, "rid long, x array<double>, w long, shard long, own boolean")
        todo = stored(dealt, f"graph-dealt{level}")
    return done, None


# ---------------------------------------------------------------- graphs of a shard

def robust_prune(similarity: np.ndarray, x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of the candidates (nearest first) keep one and drop those that are much nearer to it than to the vertex."""
    far = 1 - similarity[candidates]
    among = 1 - x[candidates] @ x[candidates].T
    live, kept = np.ones(len(candidates), bool), []
    for k in range(len(candidates)):
        if live[k]:
            kept.append(k)
            if len(kept) == degree:
                break
            live &= alpha * among[k] > far
    return candidates[kept]


def build(x: np.ndarray, rng_seed: int = 7) -> list[np.ndarray]:
    """Adjacency of a shard: robust-pruned neighbours, some random members (ways out of tight groups) and back edges."""
    m = len(x)
    rng = np.random.default_rng(rng_seed)
    out: list[np.ndarray] = []
    for low in range(0, m, 512):
        s = x[low:low + 512] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -2
        near = np.argpartition(-s, min(NEAR, m - 1), axis=1)[:, :NEAR] if m > NEAR else np.tile(np.arange(m), (len(s), 1))
        extra = rng.integers(m, size=(len(s), FAR))
        for i in range(len(s)):
            c = near[i][near[i] != low + i]
            kept = robust_prune(s[i], x, c[np.argsort(-s[i][c], kind="stable")])
            out.append(np.unique(np.concatenate([kept, extra[i][extra[i] != low + i]])))
    back: list[list[int]] = [[] for _ in range(m)]
    for i, own in enumerate(out):
        for j in own.tolist():
            if len(back[j]) < DEGREE:
                back[j].append(i)
    return [np.unique(np.concatenate([own, np.array(b, np.int64)])) for own, b in zip(out, back)]


def medoids(x: np.ndarray) -> np.ndarray:
    """The members nearest to the centres of a shard's parts."""
    centres = fit_centres(x, max(1, min(len(x), -(-len(x) // PER_MEDOID))), rounds=3)
    return np.unique(np.argmax(x @ centres.T, axis=0))


def range_search(x: np.ndarray, adjacency: list[np.ndarray], starts: np.ndarray, query: np.ndarray, least: float) -> np.ndarray:
    """Vertices with similarity ``least`` or more: a greedy walk from the medoids, then all in-range vertices are expanded."""
    seen = np.zeros(len(x), bool)
    seen[starts] = True
    first = (x[starts] @ query).tolist()
    heap = [(-s, v) for s, v in zip(first, starts.tolist())]
    heapq.heapify(heap)
    best, inside = heapq.nlargest(BEAM, first), [v for s, v in zip(first, starts.tolist()) if s >= least]
    heapq.heapify(best)
    while heap:
        s, v = heapq.heappop(heap)
        if len(best) >= BEAM and -s < best[0] and -s < least:
            break
        own = adjacency[v]
        own = own[~seen[own]]
        if not len(own):
            continue
        seen[own] = True
        for u, t in zip(own.tolist(), (x[own] @ query).tolist()):
            if t >= least:
                inside.append(u)
            if len(best) < BEAM:
                heapq.heappush(best, t)
            elif t > best[0]:
                heapq.heapreplace(best, t)
            elif t < least:
                continue
            heapq.heappush(heap, (-t, u))
    return np.array(inside, np.int64)


def _neighbours(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(group)).sort_by("rid")
    rid = table.column("rid").to_numpy()
    near = build(_matrix(table.column("x")))
    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array([rid[n].tolist() for n in near], pa.list_(pa.int64()))], names=["rid", "near"])


def _dense(x: np.ndarray, least: float) -> bool:
    """Whether members of a shard have over the share ``DENSE`` of the others in range (64 of them are asked)."""
    some = x[np.linspace(0, len(x) - 1, min(64, len(x))).astype(int)]
    return bool((some @ x.T >= least).mean() > DENSE)


def _known(hit: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Marks (row, shard) that the linked rows of each row have."""
    out = np.zeros((len(hit), marks.shape[1]), bool)
    wide = marks.astype(np.float32)
    for low in range(0, len(hit), BLOCK):
        out[low:low + BLOCK] = hit[low:low + BLOCK].astype(np.float32) @ wide > 0
    return out


def _weight(hit: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hit))
    for low in range(0, len(hit), BLOCK):
        out[low:low + BLOCK] = hit[low:low + BLOCK].astype(np.float64) @ w
    return out.astype(np.int64)


def _roots(hit: np.ndarray, guests: int) -> np.ndarray:
    """Smallest reachable row; the first ``guests`` rows of a bipartite ``hit`` are linked with the others (0: a square)."""
    size = guests + hit.shape[1]
    root = np.arange(size)
    while True:
        low = root.copy()
        for at in range(0, len(hit), BLOCK):
            part = hit[at:at + BLOCK]
            low[at:at + len(part)] = np.minimum(low[at:at + len(part)], np.where(part, root[guests:], size).min(axis=1, initial=size))
            if guests:
                low[guests:] = np.minimum(low[guests:], np.where(part, root[at:at + len(part), None], size).min(axis=0, initial=size))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _found(rid: np.ndarray, n: np.ndarray, root: np.ndarray, known: np.ndarray, shards: np.ndarray, here: int) -> pa.RecordBatch:
    """Rows of ``FOUND``; ``go`` has the shards other than this one that the row should visit."""
    known = known & (shards != here)
    at, of = np.nonzero(known)
    ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))]).astype(np.int32)
    go = pa.ListArray.from_arrays(pa.array(ends), pa.array(shards[of], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(root), go], names=["rid", "n", "root", "go"])


FOUND = "rid long, n long, root long, go array<long>"


def _search(least: float):
    """Links among the members of a shard; a link counts for a vector where the mate has its first shard."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by("rid")
        rid, w = table.column("rid").to_numpy(), table.column("w").to_numpy()
        here = table.column("shard")[0].as_py()
        own = table.column("own").to_numpy()
        x = _matrix(table.column("x"))
        m = len(x)
        hit = np.zeros((m, m), bool)
        if _dense(x, least):
            hit[:] = True
        else:
            adjacency = []
            for near in table.column("near").to_pylist():
                near = np.array(near or [], np.int64)
                at = np.minimum(np.searchsorted(rid, near), m - 1)
                adjacency.append(np.unique(at[rid[at] == near]))  # neighbours from other shards are found on visits
            starts = medoids(x)
            for i in range(m):
                hit[i, range_search(x, adjacency, starts, x[i], least - 1e-9)] = True
            hit |= hit.T.copy()  # found from either side
        for low in range(0, m, BLOCK):  # verification
            hit[low:low + BLOCK] &= x[low:low + BLOCK] @ x.T >= least
        np.fill_diagonal(hit, False)
        shards, first = np.unique(table.column("home").to_numpy(), return_inverse=True)
        known = _known(hit, np.arange(len(shards)) == first[:, None])
        known |= _known(hit, known)
        yield _found(rid, _weight(hit, w * own), rid[_roots(hit, 0)], known, shards, here)
    return run


def _visit(least: float):
    """Links of guests with the members of a shard, all of them compared."""

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by([("guest", "descending"), ("rid", "ascending")])
        rid, w = table.column("rid").to_numpy(), table.column("w").to_numpy()
        here = table.column("shard")[0].as_py()
        own = table.column("own").to_numpy()
        x = _matrix(table.column("x"))
        g = int(table.column("guest").to_numpy().sum())
        hit = np.zeros((g, len(x) - g), bool)
        for low in range(0, g, BLOCK):
            hit[low:low + BLOCK] = x[low:min(low + BLOCK, g)] @ x[g:].T >= least
        shards, first = np.unique(table.column("home").to_numpy(), return_inverse=True)
        marks = np.arange(len(shards)) == first[:, None]
        back = np.ascontiguousarray(hit.T)
        known = np.concatenate([_known(hit, marks[g:]), _known(back, marks[:g])])
        known |= np.concatenate([_known(hit, known[g:]), _known(back, known[:g])])
        n = np.concatenate([_weight(hit, (w * own)[g:]), np.zeros(len(x) - g, np.int64)])
        out = _found(rid, n, rid[_roots(hit, g)], known, shards, here)
        yield out.filter(pa.array(np.concatenate([np.ones(g, bool), hit.any(axis=0)])))
    return run


def follow(shards: DataFrame, hits: DataFrame, visits: DataFrame | None, least: float) -> DataFrame:
    """The rows of all searches: ``hits`` of the shards and those of the visits, in rounds until no vector has a shard to visit."""
    homes = shards.where("own").select("rid", F.col("shard").alias("home"))
    members = stored(shards.join(homes, "rid"), "graph-members")
    been = members.select("rid", "shard")
    found, last, step = hits, hits, 0
    while True:
        todo = last.select("rid", F.explode("go").alias("shard"))
        todo = todo if step or visits is None else todo.unionByName(visits)
        todo = stored(todo.distinct().join(been, ["rid", "shard"], "left_anti"), f"graph-visits{step}")
        if todo.isEmpty():
            return found
        # a shard with many guests meets them in blocks, each in a task of its own
        blocks = todo.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("blocks"))
        guests = (todo.join(blocks, "shard").join(members.where("own").drop("shard", "own"), "rid")
                  .select("rid", "x", "w", "shard", F.lit(False).alias("own"), "home",
                          F.pmod(F.xxhash64("rid", F.lit(3)), "blocks").cast("int").alias("block"), F.lit(1).alias("guest")))
        hosts = members.join(blocks, "shard").select(
            "rid", "x", "w", "shard", "own", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("guest"))
        last = stored(guests.unionByName(hosts).groupBy("shard", "block").applyInArrow(_visit(least), FOUND), f"graph-visited{step}")
        found, been = found.unionByName(last), been.unionByName(todo)
        step += 1


# ---------------------------------------------------------------- operator

def unit_vectors(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw, rid): all rows; ``rid`` is a hash of the vector, null for those that link with nothing: null or empty
    vectors, null, infinite or undefined components, length zero, and rows without an id."""
    v = F.col(vector_col).cast("array<double>")
    sound = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0))
    return frame.select(F.col(id_col).alias("id"), v.alias("raw"), F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(v)).alias("rid"))


def near_vectors(frame: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                 recall: float = 0.9) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept).

    Vectors are linked when their cosine in double precision is ``least`` or
    more; ``component_id`` is the smallest id reachable by links. Equal vectors
    are one vertex with a weight, so copies are never paired with each other.
    Rows that cannot be compared (see ``unit_vectors``) and vectors of another
    number of components link with nothing or among themselves only; a repeated
    id is a vector for each row; other columns do not matter; an empty table
    gives an empty result.

    The index is approximate: every vector is indexed and searched, and the
    links of ``AUDIT`` vectors are compared with brute force over all. A recall
    below ``recall``, of all their links or of a vector's on average, raises.
    """
    rows = stored(unit_vectors(frame, id_col, vector_col), "vectors")
    distinct = rows.where("rid is not null").groupBy("rid").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("w"), F.min("id").alias("id"))
    distinct = stored(distinct.withColumn("dims", F.size("raw")), "vectors-distinct")
    found = None
    for r in distinct.select("dims").distinct().collect():  # as many rounds as there are vector lengths
        own = distinct.where(F.col("dims") == r["dims"])
        got = _links(own, least, recall)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = distinct.select("rid", F.lit(0).cast("long").alias("n"), F.col("rid").alias("component"))
    weights = distinct.select("rid", "w", "id").join(found, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    first = weights.groupBy("component").agg(F.min("id").alias("component_id"))
    named = weights.join(first, "component").select("rid", "component_id", F.expr("coalesce(n, 0) + w - 1").alias("n_links"))
    out = rows.select("id", "rid").join(named, "rid", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.lit(True)))


def _links(distinct: DataFrame, least: float, recall: float) -> DataFrame:
    """(rid, n, component) of distinct vectors of one length; n counts the linked vectors with their weights."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("raw"))
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("rid"), values, batch.column("w")], names=["rid", "x", "w"])

    vectors = stored(distinct.select("rid", "raw", "w").mapInArrow(unit, "rid long, x array<double>, w long"), "graph-units")
    dealt, visits = deal(vectors)
    shards = stored(dealt, "graph-shards")
    near = shards.groupBy("shard").applyInArrow(_neighbours, "rid long, near array<long>")
    graph = near.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists at most
    homes = shards.where("own").select("rid", F.col("shard").alias("home"))
    hits = stored(shards.join(graph.join(homes, "rid"), "rid").groupBy("shard").applyInArrow(_search(least), FOUND), "graph-hits")
    hits = follow(shards, hits, visits, least)
    counts = stored(hits.groupBy("rid").agg(F.sum("n").alias("n")), "graph-counts")
    got, true = audit(vectors, counts, least)
    if true.any():
        each = float(np.minimum(got[true > 0] / true[true > 0], 1).mean())
        if got.sum() < recall * true.sum() or each < recall:
            raise RuntimeError(f"the index found {got.sum()} of {true.sum()} links of the audited vectors, {each:.1%} of those "
                               f"of a vector on average; less than {recall:.0%}")
    joined = connected_components(hits.select("rid", "root"), "rid", "root", "graph-cc")
    return counts.join(joined.select(F.col("v").alias("rid"), "component"), "rid")


def audit(vectors: DataFrame, counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links found, true links) of each of the ``AUDIT`` vectors with the smallest hashes among linked and unlinked ones alike."""
    spark = vectors.sparkSession
    some = counts.withColumn("h", F.xxhash64("rid", F.lit(1)))
    half = [some.where(c).orderBy("h").limit(AUDIT // 2).select("rid", "n") for c in ("n > 0", "n = 0")]
    picked = vectors.select("rid", "x").join(F.broadcast(half[0].unionByName(half[1])), "rid").toArrow()  # AUDIT rows
    true = np.zeros(picked.num_rows, np.int64)
    if not picked.num_rows:
        return true, true
    rid, q = picked.column("rid").to_numpy(), spark.sparkContext.broadcast(_matrix(picked.column("x")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rid), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += ((_matrix(batch.column("x")) @ q.value.T >= least) * batch.column("w").to_numpy()[:, None]
                          * (batch.column("rid").to_numpy()[:, None] != rid)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rid))), pa.array(total)], names=["i", "n"])

    for r in vectors.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # AUDIT rows
        true[r["i"]] = r["n"]
    return picked.column("n").to_numpy(), true
