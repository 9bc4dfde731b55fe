"""Centroid clustering against Lloyd's rounds in plain integers."""

import hashlib
import math
import random

import pytest

from rosterlens.llm.centroids import Settings, cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster int"


def brute(rows, s):
    kept = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == s.dim and all(x is not None and math.isfinite(x) and abs(x) <= s.largest // s.scale for x in v)]
    centroids = [q for _, q in sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest(), r[1]))[: s.clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centroids)) for _, q in kept]

    for _ in range(s.rounds):
        near = assign()
        for k in range(len(centroids)):
            own = [q for (_, q), (_, c) in zip(kept, near) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(d for d, _ in near)
    return sorted((i, c, d, sum(e for e, k in near if k == c), whole, digests[c]) for (i, _), (d, c) in zip(kept, near))


def result(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_matches_plain_rounds(spark, spread):
    draw = random.Random(3)
    middles = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + draw.gauss(0, spread) for x in draw.choice(middles)]) for i in range(700)]
    s = Settings(clusters=9, rounds=6, dim=6, scale=32, block=64)
    history = []
    df = cluster_vectors(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), settings=s, history=history)
    assert result(df) == brute(rows, s)
    assert history[0] == 700 and len(history) == 7
    if spread < 0.1:  # clear clusters: later rounds look at few vectors again
        assert history[-1] < 100


def test_ties_repeats_and_empty_clusters(spark):
    rows = [(i % 7, [float(i % 2), 0.0]) for i in range(40)] + [(100, [0.5, 0.0])] * 3 + [(101, [-0.5, -0.1])]
    for clusters in (1, 2, 5, 60):
        s = Settings(clusters=clusters, rounds=3, dim=2, scale=2, block=5)
        assert result(cluster_vectors(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), settings=s)) == brute(rows, s)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (None, [0.3, 0.3]), (8, [1e200, 0.0]), (9, [0.0, 0.0]), (10, [-3e7, 3e7])]
    s = Settings(clusters=2, rounds=2, dim=2)
    got = result(cluster_vectors(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), settings=s))
    assert got == brute(rows, s) and [r[0] for r in got] == [1, 9]


def test_empty_table(spark):
    assert result(cluster_vectors(spark.createDataFrame([], SCHEMA))) == []
