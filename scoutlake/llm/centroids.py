"""Centroid clustering by dual-tree Lloyd rounds.

Vectors are cut into blocks where they lie; each block gets a cover tree once, kept in a table: a node's children have centres
among its points, more than half its radius apart, and every point of it is within that half of a child's centre. Each round
builds a tree of the same kind over the few centroids, sends it to all tasks, and walks both trees at once: a centroid
node is dropped for a node of vectors when the triangle inequality puts all of it beyond the nearest centroid known. What is
left at a leaf is compared exactly, in integers. Blocks give sums by cluster, so a round moves a few numbers a partition,
however many vectors one cluster holds.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out. A component
beyond 2**27 after scaling counts as 2**27 with its sign, so that squared distances stay exact in a long; an inertia beyond a
long is the largest long. Repeated rows are
vectors of their own; equal seed hashes go by vec_id (null, hashed as empty, first), then by components. With fewer vectors
than centroids all of them are seeds; an empty table gives no rows. Ties go to the smaller centroid. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.llm import shared

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256.0
#: Vectors of one tree; a tree is built and walked within one task.
BLOCK = 2048
#: Points of a leaf, at most, unless they are all equal.
LEAF = 16
_MOST = 1 << 27
#: Up to this size of components, squared distances are exact in float64.
_EXACT = 1 << 22
_NODE = np.dtype([("center", "<i4"), ("radius", "<f8"), ("start", "<i4"), ("end", "<i4"), ("first", "<i4"), ("last", "<i4")])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64."""
    if max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) <= _EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return np.rint((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        gap = a - row
        out[:, j] = (gap * gap).sum(1)
    return out


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points and the nodes over it; children of a node are neighbours in the list, the node's centre first.

    A node's radius is that of its own points, so a bound from it is as tight as it can be.
    """
    order = np.arange(len(points))
    if not len(points):
        return order, np.zeros(0, _NODE)
    nodes = [(0, float(np.sqrt(squared(points, points[:1])[:, 0].max())), 0, len(points), 0, 0)]
    at = 0
    while at < len(nodes):
        center, radius, start, end, _, _ = nodes[at]
        if end - start > leaf and radius > 0:
            own, half, first = order[start:end].copy(), radius / 2, len(nodes)
            gaps = np.sqrt(squared(points[own], points[own]).astype(np.float64))  # a block's square at most
            left, place, pick = np.arange(len(own)), start, int(np.flatnonzero(own == center)[0])
            while len(left):
                far = gaps[pick, left]
                inside = far <= half
                got = left[inside]
                order[place : place + len(got)] = own[got]
                nodes.append((int(own[pick]), float(far[inside].max()), place, place + len(got), 0, 0))
                place += len(got)
                left = left[~inside]
                pick = int(left[0]) if len(left) else 0
            nodes[at] = (center, radius, start, end, first, len(nodes))
        at += 1
    return order, np.array(nodes, _NODE)


def nearest(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, centroids: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Each point's nearest centroid (ties: the smaller), its squared distance, and how many pairs were compared at leaves."""
    listed, near = tree
    cluster, distance, compared = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), 0
    if not len(nodes):
        return cluster, distance, compared
    smallest = np.array([listed[n["start"] : n["end"]].min() for n in near])  # a leaf's centroids are all equal
    middles, spread, inner = centroids[near["center"]], near["radius"], near["last"] > 0
    jobs = [(0, 1, np.zeros(1, np.int64))]
    while jobs:
        first, last, open_ = jobs.pop()  # neighbours in the list of nodes, and the centroid nodes that any of them may need
        own = nodes[first:last]
        radius, is_leaf, held = own["radius"], own["last"] == 0, points[own["center"]]
        alive = np.ones((len(own), len(open_)), bool)
        gap = np.sqrt(squared(held, middles[open_]).astype(np.float64))
        while True:
            bound = (np.where(alive, gap, np.inf).min(1) + radius) * (1 + 1e-9) + 1e-6
            alive &= gap - spread[open_] - radius[:, None] <= bound[:, None]
            split = inner[open_] & (alive & (is_leaf[:, None] | (spread[open_] > radius[:, None]))).any(0)
            if not split.any():
                break
            below = [np.arange(near["first"][o], near["last"][o]) for o in open_[split]]
            under = np.concatenate(below)
            heirs = np.repeat(alive[:, split], [len(b) for b in below], 1)
            gap = np.concatenate([gap[:, ~split], np.sqrt(squared(held, middles[under]).astype(np.float64))], 1)
            alive, open_ = np.concatenate([alive[:, ~split], heirs], 1), np.concatenate([open_[~split], under])
        if is_leaf.any():
            who = np.argsort(smallest[open_])  # equal distances go to the first
            sizes = (own["end"] - own["start"])[is_leaf]
            at = order[np.concatenate([np.arange(n["start"], n["end"]) for n in own[is_leaf]])]
            seen = np.repeat(alive[is_leaf][:, who], sizes, 0)
            exact = np.where(seen, squared(points[at], middles[open_[who]]), np.iinfo(np.int64).max)
            best = exact.argmin(1)
            cluster[at], distance[at] = smallest[open_[who]][best], exact[np.arange(len(at)), best]
            compared += int(seen.sum())
        jobs += [(int(n["first"]), int(n["last"]), open_[alive[i]]) for i, n in enumerate(own) if n["last"]]
    return cluster, distance, compared


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<int>): the scaled vectors that count."""
    e = F.col("embedding")
    good = (F.size(e) == DIMENSIONS) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(e, lambda x: F.floor(F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), x.cast("double") * SCALE))).cast("int"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select("vec_id", scaled.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            own = batch.slice(at, BLOCK)
            points = own.column("v").flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.int64)
            order, nodes = cover_tree(points)
            ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column("vec_id"))
            made = [ids, *(pa.array([x.tobytes()], pa.binary()) for x in (points.astype("<i4"), order.astype("<i4"), nodes))]
            yield pa.RecordBatch.from_arrays(made, names=["ids", "points", "ranks", "nodes"])


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points, order, nodes = (batch.column(c)[i].as_py() for c in ("points", "ranks", "nodes"))
    return np.frombuffer(points, "<i4").reshape(-1, DIMENSIONS).astype(np.int64), np.frombuffer(order, "<i4"), np.frombuffer(nodes, _NODE)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cover_tree(centroids, 1)
        total = np.zeros((len(centroids), DIMENSIONS + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                points, order, nodes = _opened(batch, i)
                cluster, _, _ = nearest(points, order, nodes, centroids, tree)
                by = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[by], return_index=True)
                total[found, :DIMENSIONS] += np.add.reduceat(points[by], first)
                total[found, DIMENSIONS] += np.diff(np.append(first, len(by)))
        at = np.repeat(np.arange(len(centroids)), DIMENSIONS + 1)
        place = np.tile(np.arange(DIMENSIONS + 1), len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(total.ravel())], names=["cluster", "place", "total"])

    rows = blocks.mapInArrow(run, "cluster bigint, place bigint, total bigint").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = np.zeros((len(centroids), DIMENSIONS + 1), object)
    for r in rows.collect():  # centroids x (dimensions + 1) numbers
        out[r["cluster"], r["place"]] = int(r["total"])
    return {c: (row[DIMENSIONS], list(row[:DIMENSIONS])) for c, row in enumerate(out) if row[DIMENSIONS]}


def lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every vector that counts, after so many rounds, and the final centroids."""
    rows = kept_vectors(vectors)
    seed = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(seed, F.col("vec_id").asc_nulls_first(), "v").limit(k).collect()  # k rows
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), np.zeros((0, DIMENSIONS), np.int64)
    centroids = np.array([r["v"] for r in first], np.int64)
    blocks = shared.written(rows.mapInArrow(_blocks, f"ids array<{kind}>, points binary, ranks binary, nodes binary"), "cover-trees")
    for _ in range(rounds):
        for c, (n, total) in _sums(blocks, centroids).items():
            centroids[c] = [x // n for x in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cover_tree(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance, _ = nearest(*_opened(batch, i), centroids, tree)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return shared.written(blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "assigned"), centroids


def clustering(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """lloyd's rows with the inertia of each vector's cluster and of all, and a digest of the cluster's centroid."""
    assigned, centroids = lloyd(vectors, k, rounds)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["own"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # a row a centroid
    whole, most = sum(sums.values()), (1 << 63) - 1
    named = [(c, min(own, most), min(whole, most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, own in sums.items()]
    each = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The same in plain SQL for DuckDB: every vector against every centroid, round after round."""
    near = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    parts = [
        f"""kept as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(x::double * {SCALE:.0f})::bigint) as v from embeddings
            where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMENSIONS})""",
        f"at0 as (select row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as cluster, v as c from kept qualify cluster < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"all{r} as materialized (select n, vec_id, v, cluster, {near} as distance from kept, at{r})")
        parts.append(f"own{r} as materialized (select * from all{r} qualify row_number() over (partition by n order by distance, cluster) = 1)")
        if r < rounds:
            parts.append(f"""sums{r} as (select cluster, i, floor(sum(v[i])::double / count(*))::bigint as x from own{r}, range(1, 65) as places(i) group by all)""")
            parts.append(f"new{r} as (select cluster, list(x order by i) as c from sums{r} group by cluster)")
            parts.append(f"at{r + 1} as materialized (select cluster, coalesce(new{r}.c, at{r}.c) as c from at{r} left join new{r} using (cluster))")
    return f"""with {", ".join(parts)} select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
        sha256(array_to_string(c, ',')) as centroid_sha256 from own{rounds} join at{rounds} using (cluster)"""
