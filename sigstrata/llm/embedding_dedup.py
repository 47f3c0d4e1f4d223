"""Embedding near-duplicates by robust-pruned flat graphs over overlapping cluster shards.

1. Equal vectors collapse into one node with a multiplicity.
2. Leaders picked from a bounded sample (SAMPLE nodes and SAMPLE_VALUES components) are centroids; no two are alike (cosine under
   APART), so that a dense group stays in one cluster. Every node joins its OVERLAP nearest clusters. A
   cluster of more than SHARD nodes is cut into blocks of at most about SHARD: each node is a member of
   one block and a query to all, so that a hot cluster spreads over tasks and loses no pair.
3. Each block builds a graph: from each node's nearest candidates, robust pruning keeps an edge to the
   closest and drops what is closer to it (by ALPHA) than to the node; reverse edges follow, and nodes
   that the medoid does not reach get an edge from their nearest that it does.
4. A node's adjacency lists from all its blocks are united, and in each block the united graph is
   searched for every query: a greedy beam search from the medoid, then the range expands through
   everything within the radius. Some queries are held against brute force; where too few links are
   found the block doubles its beam (audit).
5. Found pairs are verified in double precision. A pair that meets in several clusters counts in the
   first one both share. Blocks give sums of multiplicities and a spanning forest, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors
of different length. Repeated rows are vectors of their own. A null vec_id counts as a vector; a component's id is its
smallest other vec_id, null if there is none, and then all its vectors are kept. Empty tables give empty results. Nodes are
named by a 64-bit hash of the vector (two different vectors of a billion share one with chance 0.03).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigstrata.llm.common import components, discard, materialize, union

RADIUS = 0.9
SAMPLE = 16_384
SAMPLE_VALUES = 1 << 20
APART = 0.8
OVERLAP = 4
SHARD = 1_500
DEGREE = 16
POOL = 48
ALPHA = 1.2
BEAM = 16
AUDIT = 48
WANTED = 0.98


def nodes(vectors: DataFrame) -> DataFrame:
    """(node, v, m, rep): distinct linkable vectors, their multiplicity and smallest vec_id."""
    ok = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(embedding, x -> x <> 0)"
    return (
        vectors.where(ok).groupBy(F.col("embedding").alias("v")).agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("rep"))
        .select(F.xxhash64("v").alias("node"), "v", "m", "rep")
    )


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaders(sample: list[list[float]], wanted: int) -> dict[int, np.ndarray]:
    """By dimension: at most `wanted` unit vectors of the sample, no two with cosine of APART or more."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = unit(np.array([v for v in sample if len(v) == dim]))
        picked: list[np.ndarray] = []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            if picked:
                part = part[(part @ np.array(picked).T).max(axis=1) < APART]
            for v in part:
                if len(picked) < wanted and (not picked or (np.array(picked[-256:]) @ v).max() < APART):
                    picked.append(v)
        out[dim] = np.array(picked)
    return out


def _assign(centroids: dict[int, np.ndarray]):
    """Cluster numbers are per dimension: dim * 2**20 + rank of the centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            made: list = [None] * b.num_rows
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                c = centroids.get(dim)
                if c is None:
                    near = np.zeros((len(rows), 1), dtype=np.int64)
                else:
                    x = unit(flat[offsets[rows][:, None] + np.arange(dim)])
                    k = min(OVERLAP, len(c))
                    near = np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k]
                for r, cl in zip(rows.tolist(), np.sort(near + (dim << 20), axis=1).tolist(), strict=True):
                    made[r] = cl
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, type=pa.list_(pa.int64()))], names=[*b.schema.names, "clusters"])

    return run


def prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> np.ndarray:
    """Robust-pruned neighbours (n, degree), -1 where there are fewer."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, dtype=np.int64)
    if pool < 1:
        return out
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -9
        cand = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        s = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
        to_node = np.sqrt(np.maximum(2 - 2 * s, 0))
        y = x[cand]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("rid,rjd->rij", y, y), 0))
        alive = np.ones(cand.shape, dtype=bool)
        r = np.arange(len(rows))
        for j in range(degree):
            first = alive.argmax(axis=1)
            any_ = alive[r, first]
            out[rows[any_], j] = cand[r, first][any_]
            alive &= ALPHA * between[r, first] > to_node
            alive[r, first] = False
            if not alive.any():
                break
    return out


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def with_reverse(adj: np.ndarray, n: int) -> np.ndarray:
    """adj with the reverse of each edge, as a padded array."""
    a, j = np.nonzero(adj >= 0)
    b = adj[a, j]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return padded(pairs // n, pairs % n, n)


def padded(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Sorted edges (a, b) as an (n, widest) array with -1."""
    count = np.bincount(a, minlength=n)
    out = np.full((n, max(int(count.max(initial=0)), 1)), -1, dtype=np.int64)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)] = b
    return out


def connected(x: np.ndarray, adj: np.ndarray) -> np.ndarray:
    """adj with edges to nodes that the medoid does not reach, from their nearest that it does."""
    n = len(x)
    reach = np.zeros(n, dtype=bool)
    new = np.array([medoid(x)])
    extra_a, extra_b = [], []
    while True:
        while len(new):
            reach[new] = True
            near = adj[new].ravel()
            near = np.unique(near[near >= 0])
            new = near[~reach[near]]
        rest = np.flatnonzero(~reach)
        if not len(rest):
            break
        inside = np.flatnonzero(reach)
        part = rest[:256]
        sims = x[part] @ x[inside].T
        best = sims.max(axis=1).argmax()
        extra_a.append(int(inside[sims[best].argmax()]))
        extra_b.append(int(part[best]))
        new = part[best : best + 1]
    if not extra_a:
        return adj
    a, j = np.nonzero(adj >= 0)
    key = np.unique(np.concatenate([a * n + adj[a, j], np.array(extra_a) * n + np.array(extra_b)]))
    return padded(key // n, key % n, n)


def build(x: np.ndarray) -> np.ndarray:
    return connected(x, with_reverse(prune(x), len(x)))


def search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, radius: float, beam: int) -> np.ndarray:
    """Found members within the radius of each query: a (queries, members) mask."""
    n, nq = len(x), len(q)
    start = medoid(x)
    sim = np.full((nq, n), -9.0)
    done = np.zeros((nq, n), dtype=bool)
    sim[:, start] = q @ x[start]
    beam = min(beam, n)
    while True:
        edge = np.partition(sim, n - beam, axis=1)[:, n - beam]
        want = (sim >= np.minimum(edge, radius - 0.02)[:, None]) & (sim > -2) & ~done
        a, node = np.nonzero(want)
        if not len(a):
            return sim >= radius
        done |= want
        near = adj[node]
        row, col = np.repeat(a, adj.shape[1]), near.ravel()
        fresh = col >= 0
        row, col = row[fresh], col[fresh]
        fresh = sim[row, col] < -2
        key = np.unique(row[fresh] * n + col[fresh])
        for at in range(0, len(key), 1 << 17):
            r, c = key[at : at + (1 << 17)] // n, key[at : at + (1 << 17)] % n
            sim[r, c] = np.einsum("ij,ij->i", q[r], x[c])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _build(table: pa.Table) -> pa.Table:
    ids = table["node"].to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    adj = build(unit(_matrix(table["v"])[order]))
    return pa.table({"node": pa.array(ids), "near": pa.array([ids[r[r >= 0]].tolist() for r in adj], type=pa.list_(pa.int64()))})


def _search(radius: float):
    def run(table: pa.Table) -> pa.Table:
        ids, m = table["node"].to_numpy(), table["m"].to_numpy()
        member = table["member"].to_numpy(zero_copy_only=False).astype(bool)
        cluster = int(table["cluster"][0].as_py())
        order = np.lexsort((ids, ~member))
        x = unit(_matrix(table["v"])[order])
        ids, m, n = ids[order], m[order], int(member.sum())
        clusters = _matrix(table["clusters"])[order]
        links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        if n:
            lists = [table["near"][int(i)].as_py() for i in order[:n]]
            flat = np.array([y for near in lists for y in near], dtype=np.int64)
            a = np.repeat(np.arange(n), [len(near) for near in lists])
            at = np.minimum(np.searchsorted(ids[:n], flat), n - 1)
            inside = ids[at] == flat  # the united lists name nodes of other blocks as well
            key = np.unique(a[inside] * n + at[inside])
            adj = connected(x[:n], padded(key // n, key % n, n))
            beam = BEAM
            probe = np.linspace(0, len(ids) - 1, min(AUDIT, len(ids))).astype(int)
            true = x[probe] @ x[:n].T >= radius
            while beam < n and (search(x[:n], adj, x[probe], radius, beam) & true).sum() < WANTED * true.sum():
                beam *= 2
            for start in range(0, len(ids), 512):
                rows = np.arange(start, min(start + 512, len(ids)))
                a, b = np.nonzero(search(x[:n], adj, x[rows], radius, beam))
                a = rows[a]
                apart = a != b
                a, b = a[apart], b[apart]
                union(parent, a, b)
                for s in range(0, len(a), 1 << 18):
                    p, q = a[s : s + (1 << 18)], b[s : s + (1 << 18)]
                    shared = (clusters[p][:, :, None] == clusters[q][:, None, :]).any(axis=2)
                    first = np.where(shared, clusters[p], np.iinfo(np.int64).max).min(axis=1) == cluster
                    np.add.at(links, p[first], m[q[first]])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        return pa.table({"node": pa.array(ids), "links": pa.array(links), "root": pa.array(ids[parent])})

    return run


def link_nodes(distinct: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(node, links, root) rows of all blocks: parts of each node's count, and edges of a spanning forest."""
    n, dim = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(256, min(SAMPLE, SAMPLE_VALUES // max(dim or 1, 1)))
    wanted = max(1, min(most, -(-OVERLAP * n // SHARD)))
    sample = [r.v for r in distinct.select("v", "node").orderBy(F.xxhash64("node")).limit(most).select("v").collect()]
    centroids = leaders(sample, wanted)
    kind = distinct.schema["v"].dataType.simpleString()
    placed = materialize(
        distinct.select("node", "v", "m").mapInArrow(_assign(centroids), f"node long, v {kind}, m long, clusters array<long>")
    )
    # a row for each cluster, at most SAMPLE for each dimension of the sample
    sizes = placed.select(F.explode("clusters").alias("cluster")).groupBy("cluster").count()
    blocks = sizes.select("cluster", F.ceil(F.col("count") / SHARD).cast("int").alias("blocks"))
    home = placed.select("node", "v", "m", "clusters", F.explode("clusters").alias("cluster")).join(F.broadcast(blocks), "cluster")
    home = home.withColumn("home", F.pmod(F.xxhash64("node", "cluster"), F.col("blocks")).cast("int"))
    near = home.select("cluster", F.col("home").alias("block"), "node", "v").groupBy("cluster", "block").applyInArrow(_build, "node long, near array<long>")
    united = materialize(near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    asked = home.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.col("block") == F.col("home"))
    rows = asked.join(united, "node").withColumn("near", F.when(F.col("member"), F.col("near")))
    found = materialize(
        rows.select("cluster", "block", "node", "v", "m", "clusters", "member", "near")
        .groupBy("cluster", "block").applyInArrow(_search(radius), "node long, links long, root long")
    )
    discard(placed)
    discard(united)
    return found


def find_links(vectors: DataFrame, radius: float = RADIUS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    vectors = vectors.select("vec_id", "embedding")
    distinct = materialize(nodes(vectors))
    found = link_nodes(distinct, radius)
    sums = materialize(found.groupBy("node").agg(F.sum("links").alias("links")))
    labels = materialize(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = materialize(distinct.select("node", "rep").join(labels, distinct["node"] == labels["id"]).select("node", "label", "rep"))
    low = materialize(named.groupBy("label").agg(F.min("rep").alias("low")))
    comp = materialize(named.join(low, "label").select("node", "low"))
    result = materialize(
        distinct.join(sums, "node", "left").join(comp, "node", "left").select(
            "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.when(F.col("low").isNull(), F.col("rep")).otherwise(F.col("low")).alias("c")
        )
    )
    for x in (distinct, found, sums, labels, named, low, comp):
        discard(x)
    out = vectors.join(result, vectors["embedding"] == result["v"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
