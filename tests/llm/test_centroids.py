import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests import oracle
from ticketloom.llm import centroids


def brute(rows, dimensions, clusters, rounds, scale):
    """(key, cluster, distance, cluster inertia, inertia, digest) with Python's integers."""
    kept = [
        (k, [math.floor(scale * x) for x in v])
        for k, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    seeds = sorted((hashlib.sha256(f"1:{k}".encode()).hexdigest(), v) for k, v in kept if k is not None)[:clusters]
    centres = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centres)]
    found = [(k, *nearest(v)[::-1]) for k, v in kept] if centres else []
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((k, c, d, inertia[c], sum(inertia.values()), names[c]) for k, c, d in found), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def run(df, **options):
    return sorted(map(tuple, centroids.centroid_clusters(df, "vec_id", "embedding", **options).collect()), key=repr)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[0][1]) for i in range(40)]  # copies
    rows += [(2_000, [0.5] * 6), (2_001, [-0.5] * 6), (2_001, [-0.5] * 6), (None, [0.1] * 6)]  # ties, repeated and no key
    rows += [(3_000, None), (3_001, []), (3_002, [1.0] * 5), (3_003, [1.0] * 7), (3_004, [math.nan] * 6)]
    rows += [(3_005, [math.inf, *[0.0] * 5]), (3_006, [None, *[0.0] * 5]), (3_007, [0.0] * 6)]
    options = {"dimensions": 6, "clusters": 7, "rounds": 3, "scale": 64}
    assert run(table(spark, rows), leading=2, **options) == brute(rows, **options)


def test_empty_clusters_and_few_keys(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0]) for i in range(6)]  # equal seeds: later ones stay empty
    options = {"dimensions": 3, "clusters": 16, "rounds": 2, "scale": 4}
    assert run(table(spark, rows), leading=1, **options) == brute(rows, **options)
    assert run(table(spark, []), leading=1, **options) == []
    assert run(table(spark, [(None, [1.0, 2.0, 3.0])]), leading=1, **options) == []


def test_far_components_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1e300, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [-1e6, 0.0, 1e6])]
    names = ["cluster", "distance", "vector", "lead", "rest", "_key", "_vector", "inertia"]
    df = table(spark, rows).select("*", *[F.lit("x").alias(n) for n in names])
    options = {"dimensions": 3, "clusters": 2, "rounds": 1, "scale": 64}
    assert run(df, leading=1, **options) == brute(rows[1:], **options)
    with pytest.raises(ValueError):
        run(df, leading=3, **options)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 40, 1 << 26]))
def test_filter_keeps_the_nearest(seed, most):
    rng = np.random.default_rng(seed)
    x, whole = rng.integers(-most, most + 1, (40, 8)), rng.integers(-most, most + 1, (6, 8))
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    lead, rest = centroids._turned(x, axes, 3)
    cluster, distance, _ = centroids.Centroids(whole, axes, 3).nearest(x, lead, rest)
    every = ((x[:, None] - whole) ** 2).sum(axis=2)
    assert cluster.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_filter_spares_work():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 64)) * np.linspace(8, 0.1, 64) * 20
    x = np.rint(centres[rng.integers(0, 16, 2_000)] + rng.normal(size=(2_000, 64))).astype(np.int64)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1]
    found = centroids.Centroids(np.rint(centres).astype(np.int64), axes, 16)
    assert found.nearest(x, *centroids._turned(x, axes, 16))[2] < 0.2 * x.shape[0] * 16


def test_query(spark, folder):
    from ticketloom.llm.queries import OP12_SQL, op12_centroid_clusters

    assert oracle.difference(op12_centroid_clusters(spark, folder), oracle.connect(folder), OP12_SQL) is None
