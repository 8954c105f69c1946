import tracemalloc

import numpy as np
import pytest
from pyspark.sql import types as T

from foldline.llm import common, lattice

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType())])


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA)


def brute(vectors):
    x = np.array(vectors, np.float32).astype(float)
    u = x / np.sqrt((x**2).sum(1, keepdims=True))
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    for _ in range(200):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(u))])
    return link.sum(1), comp


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(500, 8)) * 3
    c = lattice.decode(y)
    own = ((y - c) ** 2).sum(1)
    around = ((y[:, None] - c[:, None] - lattice.NEIGHBOURS) ** 2).sum(2).min(1)
    assert (own <= around + 1e-9).all() and own.max() <= 1 + 1e-9
    assert ((2 * c) % 1 == 0).all() and (c.sum(1) % 2 == 0).all()


def test_recall_at_the_threshold_itself():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = lattice.cells(x), lattice.cells(0.9 * x + np.sqrt(1 - 0.81) * z)
    met = (lattice._meet(b[:, :, 0], a) | lattice._meet(a[:, :, 0], b)).any(1)
    assert met.mean() > 0.97


@pytest.mark.parametrize("block", [lattice.BLOCK, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = []
    for size in (1,) * 40 + (2, 3, 5, 60):
        centre = rng.normal(size=64)
        vectors += [(centre + rng.normal(size=64) * 0.15).tolist() for _ in range(size)]
    step = rng.normal(size=64)
    v = rng.normal(size=64)
    vectors += [(v + k * 0.25 * step).tolist() for k in range(8)]  # a chain whose ends are far apart
    vectors += [vectors[0]] * 30
    links, comp = brute(vectors)
    df = frame(spark, vectors)
    rows = lattice.near_vectors(df).orderBy("vec_id").collect()
    found = np.array([r.n_links for r in rows])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert [r.component_id for r in rows] == comp.tolist()
    assert all(r.kept == (r.component_id == r.vec_id) for r in rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 2.0, 3.0]
    vectors = [base, base, None, [0.0] * 3, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [], [1.0], [x * 1e30 for x in base], base, base, [-x for x in base]]
    ids = [4, 3, *range(5, 13), None, 4, 13]
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(frame(spark, vectors, ids)).collect())
    lone = [((False, i), 0, i, True) for i in range(5, 12)]
    assert got == [((False, 3), 3, 3, True), ((False, 4), 3, 3, False), ((False, 4), 3, 3, False), *lone, ((False, 12), 3, 3, False), ((False, 13), 0, 13, True), ((True, 0), 0, None, True)]
    assert lattice.near_vectors(frame(spark, [])).count() == 0
    assert lattice.near_vectors(frame(spark, [None, []])).count() == 2


def test_a_full_block_takes_bounded_memory():
    """4,096 near vectors in one cell: eight million pairs, verified in parts."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=64) + rng.normal(size=(lattice.BLOCK, 64)) * 0.05
    node = np.arange(len(x))
    lives = np.ones(len(x), bool)
    own = lattice.cells(lattice._unit(x))[:, 0, 0]
    tracemalloc.start()
    seen = 0
    for p, q in lattice._verify(node, x, lives, int(own[0]), 0, None):
        assert len(p) <= lattice.PAIRS
        seen += len(p)
    assert tracemalloc.get_traced_memory()[1] < 500e6 and seen > 0
    tracemalloc.stop()


def test_one_vector_and_one_component_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 5)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    vectors = [centre.tolist()] * 50 + [(centre + rng.normal(size=16) * 0.1).tolist() for _ in range(40)] + [rng.normal(size=16).tolist() for _ in range(20)] + [None] * 5
    links, comp = brute(vectors[:110])
    rows = lattice.near_vectors(frame(spark, vectors)).orderBy("vec_id").collect()
    assert [r.n_links for r in rows] == [*links.tolist(), *[0] * 5] and [r.component_id for r in rows] == [*comp.tolist(), *range(110, 115)]
