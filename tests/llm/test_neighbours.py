"""Neighbours against all inner products."""

import math

import numpy as np

from rollcall.llm import neighbours

SHAPE = "vec_id long, embedding array<float>"


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], SHAPE)


def brute(ids, vectors, queries, k):
    x = np.asarray(np.asarray(vectors, dtype=np.float32), dtype=np.float64)
    out = {}
    for q in queries:
        at = ids.index(q)
        score = (x * x[at]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_several_blocks(spark, monkeypatch, clashing):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 700)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 40)
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, size=(3000, 1))
    ids = list(range(3000))
    t = table(spark, ids, vectors)
    got = by_query(neighbours.search(clashing(t), t.where("vec_id % 30 = 0")).collect())
    want = brute(ids, vectors, range(0, 3000, 30), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {q: dict(brute(ids, vectors, [q], 3000)[q]) for q in list(want)[:5]}
    assert all(math.isclose(s, exact[q][i], rel_tol=1e-12) for q in exact for i, s in got[q])


def test_ties_go_to_the_smaller_id(spark):
    ids = list(range(60))
    vectors = [[1.0, 2.0, 3.0]] * 50 + [[1.0, 0.0, 0.0]] * 10
    t = table(spark, ids, vectors)
    got = by_query(neighbours.search(t, t.where("vec_id in (0, 55)"), 5).collect())
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[55]] == [0, 1, 2, 3, 4]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [])]
    t = spark.createDataFrame(rows, SHAPE)
    got = by_query(neighbours.search(t, t, 20).collect())
    assert got == {0: [(1, 0.5)], 1: [(0, 0.5)]}
    assert neighbours.search(t.where("vec_id = 3"), t).count() == 0
    assert neighbours.search(t.where("false"), t.where("false")).count() == 0


def test_repeated_rows(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], SHAPE)
    assert by_query(neighbours.search(t, t.where("vec_id = 0")).collect()) == {0: [(1, 1.0), (1, 1.0)]}
