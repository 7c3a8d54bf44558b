"""Dual-tree Lloyd against rounds over all pairs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutlake.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k, rounds):
    """Rounds in Python integers: every vector against every centroid."""
    kept = [(i, [math.floor(max(-(2**27), min(2**27, x * 256))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in seeds[:k]]
    for n in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]
        if n < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else at[j]
    inertia = [sum(d for d, c in own if c == j) for j in range(len(at))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, min(inertia[c], 2**63 - 1), min(sum(inertia), 2**63 - 1), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True)), key=str)


def made(kind, n, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        middles = rng.normal(0, 3, (7, 64))
        vectors = middles[rng.integers(0, 7, n)] + rng.normal(0, 0.05, (n, 64))
    elif kind == "ties":
        vectors = rng.integers(0, 2, (n, 64)) / 256.0
        vectors[n // 2 :] = vectors[0]
    elif kind == "large":
        vectors = rng.normal(0, 1, (n, 64)) * 10.0 ** rng.integers(-3, 9, (n, 1))
    else:
        vectors = rng.normal(0, 0.1, (n, 64))
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["clusters", "ties", "large", "noise"])
def test_lloyd(spark, monkeypatch, kind):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rows = made(kind, 170)
    assert got(centroids.clustering(spark.createDataFrame(rows, SCHEMA).repartition(3), 9, 3)) == plain(rows, 9, 3)


def test_odd_rows(spark):
    rows = made("noise", 60)
    rows += [(100, None), (101, [0.5] * 63), (102, [0.5] * 65), (103, [None] + [0.5] * 63), (104, [math.nan] + [0.5] * 63), (105, [math.inf] + [0.5] * 63), (106, [-math.inf] * 64)]
    rows += [rows[5]] * 3 + [(None, [0.25] * 64), (5, [-0.001] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "cluster", "ids", "distance", "own", "a.b")})
    assert got(centroids.clustering(df, 6, 2)) == plain(rows, 6, 2)
    assert got(centroids.clustering(df.filter("vec_id < 4"))) == plain(rows[:4], 40, 5)


def test_no_rows(spark):
    out = centroids.clustering(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.collect()


def test_cover_tree_holds_its_bounds_and_prunes():
    points = np.array([v for _, v in made("clusters", 900)])
    points = np.floor(points * 256).astype(np.int64)
    order, nodes = centroids.cover_tree(points)
    assert sorted(order) == list(range(900))
    for node in nodes:
        own = order[node["start"] : node["end"]]
        assert node["center"] in own
        assert np.sqrt(centroids.squared(points[own], points[node["center"]][None])).max() <= node["radius"] + 1e-6
        if node["last"]:
            below = nodes[node["first"] : node["last"]]
            gaps = np.sqrt(centroids.squared(points[below["center"]], points[below["center"]]).astype(float)) + np.eye(len(below)) * 1e18
            assert gaps.min() > node["radius"] / 2 and below["radius"].max() <= node["radius"] / 2
            assert below["start"][0] == node["start"] and below["end"][-1] == node["end"]
    seeds = points[:40]
    cluster, distance, compared = centroids.nearest(points, order, nodes, seeds, centroids.cover_tree(seeds, 1))
    exact = centroids.squared(points, seeds)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < 900 * 40 / 3
