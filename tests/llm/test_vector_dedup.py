"""Near-duplicate vectors against the cosines of all pairs."""

import math

import numpy as np
import pytest

from rosterlens.llm import queries
from rosterlens.llm.vector_dedup import Codes, Settings, in_range, near_vectors, rotations

SCHEMA = "vec_id long, embedding array<double>, label int, kept int"


def brute(rows, cosine=0.93):
    """Rows are (vec_id, vector, label); repeated rows are one vector."""
    nodes = sorted({(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}, key=repr)
    links = {k: set() for k in nodes}
    groups = {}
    for node in nodes:
        groups.setdefault((node[2], len(node[1])), []).append(node)
    for group in groups.values():
        m = in_range(np.array([v for _, v, _ in group]))
        m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
        for a in range(len(group)):
            for b in np.flatnonzero(m @ m[a] >= cosine):
                if a != b:
                    links[group[a]].add(group[b])
    component = {}
    for node in sorted(nodes, key=lambda k: k[0]):
        ahead = [node] if node not in component else []
        while ahead:
            k = ahead.pop()
            if k not in component:
                component[k] = node[0]
                ahead += links[k]
    out = []
    for i, v, l in rows:
        k = (i, tuple(v), l) if v is not None else None
        out.append((i, len(links[k]), component[k], i == component[k]) if k in links else (i, 0, i, True))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def at_cosine(draw, v, cosine):
    """A vector of the same length at the given cosine."""
    w = draw.standard_normal(len(v))
    w -= w @ v / (v @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * np.linalg.norm(v) * w / np.linalg.norm(w)


@pytest.mark.parametrize("settings", [Settings(), Settings(bucket=4, chunk=7)])
def test_pairs_around_the_threshold(spark, settings):
    draw = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        v = draw.standard_normal(64)
        rows += [v, *(at_cosine(draw, v, c) for c in (0.9301, 0.93001, 0.9299, 0.95, 0.999))]
    rows += [at_cosine(draw, rows[0], 0.99) for _ in range(120)] + list(draw.standard_normal((300, 64)))
    rows = [(i, [float(x) for x in v], int(draw.integers(2))) for i, v in enumerate(rows)]
    want = brute(rows)
    assert result(near_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), settings=settings)) == want
    assert sum(n for _, n, *_ in want) > 1000


@pytest.mark.parametrize("dim", [1, 2, 3, 40, 200])
def test_other_dimensions(spark, dim):
    draw = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(draw.standard_normal((150, dim)))]
    rows += [(1000 + i, [x * 1e-200 for x in rows[i][1]], 1) for i in range(20)] + [(2000 + i, [x * 1e200 for x in rows[i][1]], 1) for i in range(5)]
    assert result(near_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), settings=Settings(bucket=16, chunk=32))) == brute(rows)


def test_estimates_are_unbiased_and_within_their_errors():
    draw = np.random.default_rng(7)
    left = draw.standard_normal((4000, 64))
    for cosine in (0.0, 0.5, 0.93):
        right = np.array([at_cosine(draw, v, cosine) for v in left])
        turn = rotations(64, Settings())
        a, b = Codes.of(left, turn), Codes.of(right, turn)
        estimate = np.concatenate([np.diag(a.estimates(slice(k, k + 500), Codes(*(getattr(b, f)[k : k + 500] for f in ("signs", "factor", "spread", "rotated", "scale")), 64))) for k in range(0, 4000, 500)])
        error = (estimate - cosine) / (math.sqrt(1 - cosine**2) * a.spread)
        assert abs(error.mean()) < 0.08 and 0.9 < error.std() < 1.1 and abs(error).max() < 5.3


def test_query_on_the_given_table_and_a_large_group(spark):
    folder = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    assert result(queries.QUERIES["op12_embedding_near_dedup"](spark, folder)) == brute([(r.vec_id, r.embedding, r.label) for r in given])
    draw = np.random.default_rng(2)
    middle = draw.standard_normal(64)
    rows = [(i, [float(x) for x in at_cosine(draw, middle, 0.965)], 3) for i in range(700)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert result(near_vectors(df, settings=Settings(chunk=100))) == brute(rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 1)]
    rows = [*odd, (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [0.0, 1.0], 1), (14, [0.02, 1.0], 1), (14, [5.0, 1e-3], 1)]
    got = result(near_vectors(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)))
    assert got == brute(rows)
    assert (8, 3, 8, True) in got and got.count((9, 3, 8, False)) == 2


def test_one_vector_with_very_many_ids(spark):
    df = spark.range(60_000).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(0.6D, 0.8D), array(cast(id AS double) + 1, -1D)) AS embedding", "'x' AS label")
    got = near_vectors(df.where("id % 3 = 0 OR id < 300")).where("vec_id % 3 = 0").agg({"n_links": "max", "component_id": "max", "vec_id": "count"}).first()
    assert sorted(got.asDict().values()) == [0, 19_999, 20_000]


def test_empty_table(spark):
    assert result(near_vectors(spark.createDataFrame([], SCHEMA))) == []
    assert result(near_vectors(spark.createDataFrame([(1, None, 1, 0)], SCHEMA))) == [(1, 0, 1, True)]
