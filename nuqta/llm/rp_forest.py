"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits space at random hyperplanes, at the median of a sample, down to its leaves.
Every vector belongs to one leaf of each tree. A query's branches of all trees wait in one
priority queue, a branch's priority being the least margin on the way to it; the leaves that
come out first are searched, and their members reranked by exact distance. Leaves are groups
of a shuffle, in which queries and members meet; a leaf of many members is several groups,
so that all of them are compared and none is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textvec import U64, mix, ranges

#: Members per leaf aimed at; leaves of a tree at most (so that the forest sent to the workers
#: is bounded: TREES * MAX_LEAVES * dimensions * 4 bytes); members of a leaf that one task
#: compares, beyond which the leaf is split into blocks that each query of it visits.
LEAF, MAX_LEAVES, LARGE = 2048, 16384, 16384
TREES = 6
#: Probes whose true neighbours decide how many leaves a query visits, and the share of these
#: neighbours to be found.
PROBES, TARGET = 256, 0.94
#: Sampled vectors per leaf for fitting the splits, and in all at most.
SAMPLE_PER_LEAF, MAX_SAMPLE = 24, 1 << 17


class Forest:
    """Trees of equal depth; node k's children are 2k + 1 (left) and 2k + 2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        inner = (1 << depth) - 1
        dims = sample.shape[1]
        self.normal = np.zeros((trees, inner, dims), np.float32)
        self.offset = np.zeros((trees, inner), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for k in range(inner):
                own = members.pop(k, np.zeros(0, int))
                if len(own) >= 2:  # between two of its vectors
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    v = a - b
                else:
                    v = np.zeros(dims, np.float32)
                if not np.linalg.norm(v) > 1e-12:
                    v = rng.standard_normal(dims)
                v = (v / np.linalg.norm(v)).astype(np.float32)
                m = sample[own] @ v
                at = np.float32(np.median(m)) if len(own) else np.float32(0)
                self.normal[t, k], self.offset[t, k] = v, at
                if 2 * k + 1 < inner:
                    members[2 * k + 1], members[2 * k + 2] = own[m < at], own[m >= at]

    def margins(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.normal[t].T - self.offset[t]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """(trees, n): the leaf of each vector."""
        out = np.zeros((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            if self.depth:
                right = self.margins(x, t) >= 0
                for _ in range(self.depth):
                    out[t] = 2 * out[t] + 1 + right[np.arange(len(x)), out[t]]
                out[t] -= (1 << self.depth) - 1
        return out

    def priority(self, x: np.ndarray) -> np.ndarray:
        """(n, trees * leaves): each leaf's priority in the queue that all trees share, the
        least margin on the way to it."""
        leaves = 1 << self.depth
        priority = np.empty((len(x), self.trees * leaves), np.float32)
        for t in range(self.trees):
            level = np.full((len(x), 1), np.inf, np.float32)
            m = self.margins(x, t) if self.depth else None
            for d in range(self.depth):
                own = m[:, (1 << d) - 1 : (1 << d + 1) - 1]
                level = np.stack([np.minimum(level, -own), np.minimum(level, own)], 2).reshape(len(x), -1)
            priority[:, t * leaves : (t + 1) * leaves] = level
        return priority

    def search(self, x: np.ndarray, visits: int) -> np.ndarray:
        """(n, visits): tree * leaves + leaf of the leaves that come first out of the queue."""
        priority = self.priority(x)
        visits = min(visits, priority.shape[1])
        return np.argpartition(-priority, visits - 1, axis=1)[:, :visits]


def nearest(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids (-1: none) of the k nearest members of each query, without
    the member that has the query's id. Every member is compared."""
    dist, found = _exact(queries, members[:LARGE], ids[:LARGE], own, k)
    for a in range(LARGE, len(members), LARGE):
        d, i = _exact(queries, members[a : a + LARGE], ids[a : a + LARGE], own, k)
        dist, found = _best(np.concatenate([dist, d], 1), np.concatenate([found, i], 1), k)
    return dist, found


def _best(dist: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([found, dist])
    dist, found = np.take_along_axis(dist, order, 1), np.take_along_axis(found, order, 1)
    again = np.zeros(found.shape, bool)
    by = np.argsort(found, 1, kind="stable")
    f = np.take_along_axis(found, by, 1)
    np.put_along_axis(again[:, :], by[:, 1:], f[:, 1:] == f[:, :-1], 1)
    dist = np.where(again, np.inf, dist)
    first = np.argsort(dist, 1, kind="stable")[:, :k]
    dist = np.take_along_axis(dist, first, 1)
    return dist, np.where(np.isinf(dist), -1, np.take_along_axis(found, first, 1))


def _exact(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    out_d, out_i = np.full((len(queries), k), np.inf, np.float32), np.full((len(queries), k), -1, np.int64)
    if not len(members):
        return out_d, out_i
    by = np.argsort(ids, kind="stable")  # ties in distance go to the least id
    members, ids = members[by], ids[by]
    norms = (members.astype(np.float64) ** 2).sum(1)
    norms32 = norms.astype(np.float32)
    n = min(k, len(members))
    near = min(len(members), k + 8)
    step = max(1, (1 << 22) // len(members))
    for a in range(0, len(queries), step):
        q = queries[a : a + step].astype(np.float64)
        rough = norms32 - 2 * (queries[a : a + step] @ members.T)
        rough[own[a : a + step][:, None] == ids] = np.inf
        at = np.argpartition(rough, near - 1, 1)[:, :near] if near < len(members) else np.broadcast_to(np.arange(len(members)), rough.shape)
        d = ((members[at].astype(np.float64) - q[:, None]) ** 2).sum(2)
        d[np.isinf(np.take_along_axis(rough, at, 1))] = np.inf
        order = np.lexsort([ids[at], d])[:, :n]
        d, at = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
        if near < len(members):  # where more tie with the last than were looked at, look at them all
            own2 = (q**2).sum(1)
            reach = (d[:, -1] - own2) + 1e-5 * (own2 + norms.max() + 1)
            for r in np.flatnonzero((rough <= reach[:, None]).sum(1) > near):
                c = np.flatnonzero(rough[r] <= reach[r])
                exact = ((members[c].astype(np.float64) - q[r]) ** 2).sum(1)
                c = c[np.lexsort([ids[c], exact])[:n]]
                at[r], d[r] = c, ((members[c].astype(np.float64) - q[r]) ** 2).sum(1)
        out_d[a : a + step, :n] = d
        out_i[a : a + step, :n] = np.where(np.isinf(d), -1, ids[at])
    return out_d, out_i


def visits_needed(given: DataFrame, forest: Forest, probes: np.ndarray, probe_ids: np.ndarray, k: int) -> int:
    """How many leaves a query must visit for TARGET of true neighbours to be met: the probes'
    neighbours are found by brute force in one pass over all vectors, and each is met at the
    first of its leaves to come out of the queue."""
    dims = probes.shape[1]
    sent = given.sparkSession.sparkContext.broadcast((forest, probes, probe_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, p, own = sent.value
        for b in batches:
            x, ids = _vectors(b.column(1), dims), b.column(0).to_numpy()
            if not len(x):
                continue
            d, i = _exact(p, x, ids, own, k)
            row = np.argsort(ids, kind="stable")
            at = row[np.searchsorted(ids[row], i).clip(0, len(ids) - 1)]
            ok = (i >= 0).ravel()
            who = np.repeat(np.arange(len(p)), k)[ok]
            home = f.leaf(x)
            leaves = [r.tobytes() for r in np.ascontiguousarray(home.T[at.ravel()[ok]])]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(d.ravel()[ok].astype(np.float64)), pa.array(i.ravel()[ok]), pa.array(leaves, pa.binary())], names=["probe", "d", "i", "leaves"])

    near = given.mapInArrow(run, "probe long, d double, i long, leaves binary").groupBy("probe").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("d", "i", "leaves")))), 1, k).alias("c"))
    order = np.argsort(np.argsort(-forest.priority(probes), 1, kind="stable"), 1, kind="stable")
    need = []
    for r in near.collect():  # PROBES rows
        for c in r["c"]:
            cell = np.frombuffer(c["leaves"], np.int64) + (np.arange(forest.trees) << forest.depth)
            need.append(int(order[r["probe"], cell].min()) + 1)
    return int(np.quantile(need, TARGET, method="higher")) if need else 1


def block_counts(given: DataFrame, forest: Forest, dims: int, large: int) -> np.ndarray:
    """Number of blocks of each leaf of each tree (tree * leaves + leaf), by its members."""
    sent = given.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        total = np.zeros(f.trees << f.depth, np.int64)
        for b in batches:
            x = _vectors(b.column(1), dims)
            for a in range(0, len(x), 1024):
                home = f.leaf(x[a : a + 1024]) + (np.arange(f.trees) << f.depth)[:, None]
                total += np.bincount(home.ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    out = np.ones(forest.trees << forest.depth, np.int64)
    members = given.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in members.where(F.col("n") > large).collect():  # TREES * MAX_LEAVES rows at most
        out[r["cell"]] = -(-r["n"] // large)
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def neighbours(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", ask: Column | None = None, k: int = 10, seed: int = 11, large: int = LARGE) -> DataFrame:  # noqa: A002
    """vec_id, neighbour_id, distance, rank: the k nearest others, among all rows of
    ``vectors``, of the rows for which ``ask`` is true (every row, if it isn't given), by
    Euclidean distance.

    Rows with a null id, or whose vector is null, has
    a null or a value that isn't finite, or another length than most, are left out; rows that repeat
    an id are one vector; equal distances are ranked by id; with fewer than k others there
    are fewer rows; an empty table gives none. Only the id and the vector are read."""
    asked = F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))
    given = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v"), asked.alias("ask"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < 1e18)"
    lengths = given.where(fine).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "vec_id long, neighbour_id long, distance double, rank int"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n = lengths["d"], lengths["n"]
    given = given.where(f"{fine} and size(v) = {dims}")
    depth = int(np.clip(np.ceil(np.log2(max(1, n / LEAF))), 0, np.log2(MAX_LEAVES)))
    wanted = min(SAMPLE_PER_LEAF << depth, MAX_SAMPLE)
    share = min(1.0, 1.2 * wanted / n + 100 / n)
    # first by a hash, wherever they lie in the table; the bound on it only spares sorting
    drawn = given.select("vec_id", "v").withColumn("hash", F.expr(f"shiftrightunsigned(xxhash64(vec_id, {seed}), 1)")).where(f"hash <= {int(share * (2**63 - 1))}")
    rows = drawn.orderBy("hash", "vec_id", "v").limit(wanted).drop("hash").toArrow()
    order = np.argsort(rows.column(0).to_numpy(), kind="stable")
    sample = _vectors(rows.column(1).combine_chunks(), dims)[order] if len(rows) else np.zeros((0, dims), np.float32)
    forest = Forest(sample, depth, TREES, seed)
    probes = order[np.linspace(0, len(order) - 1, min(PROBES, len(order))).astype(int)] if len(order) else order
    probe_ids = rows.column(0).to_numpy()[probes]
    visits = visits_needed(given.select("vec_id", "v"), forest, _vectors(rows.column(1).combine_chunks(), dims)[probes], probe_ids, k)
    blocks = block_counts(given.select("vec_id", "v"), forest, dims, large)
    sent = vectors.sparkSession.sparkContext.broadcast((forest, blocks))  # at most TREES * MAX_LEAVES hyperplanes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, blocks = sent.value
        for b in batches:
            x = _vectors(b.column(1), dims)
            ask = b.column(2).to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 256):
                part, ids = x[a : a + 256], b.column(0).slice(a, min(256, len(x) - a)).to_numpy()
                raw = pa.array([r.tobytes() for r in part], pa.binary())
                home = (f.leaf(part) + (np.arange(f.trees) << f.depth)[:, None]).ravel()
                row = np.tile(np.arange(len(part)), f.trees)
                block = (mix(ids[row].astype(U64)) % blocks[home].astype(U64)).astype(np.int64)
                asks = np.flatnonzero(ask[a : a + 256])
                if len(asks):
                    visit = f.search(part[asks], visits).astype(np.int64)
                    cell, who = visit.ravel(), np.repeat(asks, visit.shape[1])
                    n = blocks[cell]
                    row = np.concatenate([row, np.repeat(who, n)])
                    block = np.concatenate([block, ranges(n)])
                    own, home = len(home), np.concatenate([home, np.repeat(cell, n)])
                else:
                    own = len(home)
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(block), pa.array(np.arange(len(home)) >= own), pa.array(ids[row]), raw.take(pa.array(row))], names=["cell", "block", "asks", "vec_id", "v"])

    def search(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(-1, dims)
        _, first = np.unique(ids[~asks], return_index=True)
        q, first_q = np.unique(ids[asks], return_index=True)
        d, i = nearest(x[asks][first_q], x[~asks][first], ids[~asks][first], q, k)
        return pa.table({"vec_id": q, "d": pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * k, d.astype(np.float64).ravel()), "i": pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * k, i.ravel())})

    found = given.mapInArrow(place, "cell long, block long, asks boolean, vec_id long, v binary").groupBy("cell", "block").applyInArrow(search, "vec_id long, d array<double>, i array<long>")
    pairs = found.select("vec_id", F.filter(F.arrays_zip("d", "i"), lambda x: x["i"] >= 0).alias("c"))
    best = pairs.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), 1, k).alias("c"))
    return best.select("vec_id", F.posexplode("c").alias("p", "c")).select("vec_id", F.col("c.i").alias("neighbour_id"), F.sqrt("c.d").alias("distance"), (F.col("p") + 1).alias("rank"))
