"""Near copies among vectors against all cosines."""

import numpy as np
import pytest

from rollcall.llm import near_vectors

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept), sorted."""
    def fine(v, label):
        return v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    near = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and label == other and fine(v, label) and fine(w, other) and len(v) == len(w):
                x, y = np.array(v, dtype=np.float32).astype(float), np.array(w, dtype=np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, js in enumerate(near):
        for j in js:
            part[root(i)] = root(j)
    least = {}
    for i, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(vec_id, least.get(root(i), vec_id))
    return sorted(((r[0], len(near[i]), least.get(root(i)), r[0] == least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def told(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cloud(rng, n, dims, groups, spread):
    """Vectors about some centres; leading dimensions vary most."""
    scale = 1 / np.arange(1, dims + 1) ** 0.5
    centres = rng.normal(size=(groups, dims)) * scale
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * scale * spread


@pytest.mark.parametrize("tile, step, sparse", [(1024, 16, 0.02), (16, 5, 0.5), (40, 3, 0.0)])
def test_against_all_cosines(spark, monkeypatch, clashing, tile, step, sparse):
    for name, value in (("TILE", tile), ("STEP", step), ("SPARSE", sparse), ("SAMPLE", 64), ("PAIRS", 50)):
        monkeypatch.setattr(near_vectors, name, value)
    rng = np.random.default_rng(5)
    x = cloud(rng, 260, 12, 30, 0.16) * rng.uniform(0.1, 9, size=(260, 1))
    rows = [(i, [float(v) for v in np.float32(x[i])], int(rng.integers(0, 3))) for i in range(260)]
    rows += [(400 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(300, rows[7][1], (rows[7][2] + 1) % 3), (9, rows[8][1], rows[8][2])]
    got = told(near_vectors.near_copies(clashing(spark.createDataFrame(rows, SHAPE)).repartition(5)))
    want = brute(rows)
    assert got == want and 20 < sum(r[1] > 0 for r in want) and len({r[2] for r in want}) > 20


def test_unusable_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(bad + bad)] + [(20, [1.0, 2.0], None), (21, [1.0, 2.0], None), (22, [1.0, 2.0, 0.0], 1), (23, [1.0, 2.0], 1)]
    rows += [(None, [5.0, -3.0], 1), (None, [1.0, 2.0], 1), (25, [-1.0, 1.0], 2), (24, [-2.0, 2.0], 2), (26, [0.0, 1.0], 3), (27, [-0.0, 1.0], 3)]
    want = brute(rows)
    # A row without an id is no component's name; alone it is kept, beside others it is not.
    assert sum(r[:3] == (None, 0, None) for r in want) == 1 and (None, 1, 23, False) in want
    want = sorted([(None, 0, None, True) if r[:3] == (None, 0, None) else r for r in want], key=repr)
    assert told(near_vectors.near_copies(spark.createDataFrame(rows, SHAPE))) == want


def test_the_threshold_itself_links(spark):
    # Cosines of exactly 0.6, and a hair less.
    rows = [(0, [1.0, 0.0], 1), (1, [3.0, 4.0], 1), (2, [3.0, 4.0001], 1)]
    assert told(near_vectors.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.6)) == [
        (0, 1, 0, True), (1, 2, 0, False), (2, 1, 0, False),
    ]


def test_extreme_sizes_and_long_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=2000)
    rows = [(0, (v * 1e-200).tolist(), 1), (1, (v * 1e200).tolist(), 1), (2, rng.normal(size=2000).tolist(), 1)]
    got = told(near_vectors.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert got == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)]


def test_a_group_of_copies_is_one_class(spark):
    t = spark.range(3000).selectExpr("id as vec_id", "array(1f, 2f, 3f) as embedding", "1 as label")
    assert {tuple(r)[1:3] for r in near_vectors.near_copies(t).collect()} == {(2999, 0)}


def test_empty_table(spark):
    t = spark.createDataFrame([], SHAPE)
    assert near_vectors.near_copies(t).count() == 0
    assert told(near_vectors.near_copies(spark.createDataFrame([(1, None, 1)], SHAPE))) == [(1, 0, 1, True)]
