"""Centroid clustering against plain Python, on rows of every kind."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from lumenarc.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, cluster string, distance int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y", 3) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, width):
    import numpy as np

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*mine, strict=True)] if (mine := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(x[2] for x in found if x[1] == j), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def rows(n, width, seed):
    r = random.Random(seed)
    hubs = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    made = [(i, [x + r.gauss(0, 0.3) for x in hubs[i % 5]]) for i in range(n)]
    odd = [(n, None), (n + 1, made[0][1][:-1]), (n + 2, [*made[0][1], 1.0]), (n + 3, [None, *made[0][1][1:]]), (n + 4, [math.nan, *made[0][1][1:]]), (n + 5, [math.inf, *made[0][1][1:]]), (n + 6, [])]
    return made + odd + [(None, made[3][1]), (None, made[4][1]), (7, made[7][1]), (7, made[8][1])] + [(n + 10 + i, made[1][1]) for i in range(9)]


@pytest.mark.parametrize("n,width,k,rounds", [(120, 8, 8, 10), (40, 3, 4, 1), (30, 2, 60, 3), (50, 4, 1, 0)])
def test_clusters_are_the_plain_ones(spark, n, width, k, rounds):
    data = rows(n, width, n)
    got = centroids.cluster(frame(spark, data), k, rounds, width)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(data, k, rounds, width)))


def test_equal_vectors_and_tables_that_give_nothing(spark):
    same = [(i, [0.5, -0.5]) for i in range(20)]
    got = centroids.cluster(frame(spark, same), 8, 10, 2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    for none in ([], [(1, None), (2, [1.0])]):
        empty = centroids.cluster(frame(spark, none), 8, 10, 2)
        assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        centroids.cluster(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])]), 2, 1, 2).collect()
