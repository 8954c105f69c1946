import numpy as np
import pytest

from foldline.llm import knn
from tests.llm.test_lattice import frame


def brute(rows, every=100, k=10):
    d = 8
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v.tolist()), v.tolist())
    for i, q in asked.items():
        s = sorted((-int(np.dot(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(256, 20_000, 4_096), (7, 30, 2)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("PIVOTS", "BLOCK", "QUERY_BLOCK"), sizes, strict=True):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(900, 8)) * rng.choice([0.1, 1, 5], size=(900, 1))).round(2)
    v[400:700] = v[400]  # ties, and one large group
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    rows += [(100, v[5].tolist()), (950, v[3].tolist()), (950, v[3].tolist()), (None, v[3].tolist()), (1000, None), (1001, [1.0] * 3), (1100, [float("nan")] * 8), (1200, [None] + [1.0] * 7), (-100, v[9].tolist())]
    got = knn.top_k(frame(spark, [x for _, x in rows], [i for i, _ in rows])).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_few_or_no_rows(spark):
    assert knn.top_k(frame(spark, [])).count() == 0
    assert knn.top_k(frame(spark, [[1.0, 2.0]], [0])).count() == 0
    assert [tuple(r) for r in knn.top_k(frame(spark, [[1.0, 2.0], [1e-3, 0.0]], [0, 1])).collect()] == [(0, 1, 1, 1024)]
    assert knn.top_k(frame(spark, [[1.0]], [7])).count() == 0


def test_rows_go_only_where_they_are_asked_for(spark, monkeypatch):
    for name, value in (("PIVOTS", 64), ("BLOCK", 50), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(knn, name, value)
    sent = []
    plain = knn.routed

    def counted(data, asked):
        out = plain(data, asked)
        routes = asked.select("cell", "block", "part").distinct()
        sent.append((out.count(), data.join(routes.select("cell", "block").distinct(), ["cell", "block"], "left_semi").count(), routes.select("part").distinct().count()))
        return out

    monkeypatch.setattr(knn, "routed", counted)
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(20, 8)) * 5, 100, axis=0) + rng.normal(size=(2000, 8)) * 0.2  # clear groups
    rows = [(int(i), x.round(3).tolist()) for i, x in enumerate(v)]
    got = knn.top_k(frame(spark, [x for _, x in rows], [i for i, _ in rows]), every=10).collect()
    assert sorted(map(tuple, got)) == brute(rows, every=10)
    copies, wanted, parts = sent[0]
    assert wanted <= 2000 and copies < 0.5 * 2000 * parts  # and not every row for every block of queries


def test_huge_components(spark):
    big = 3e38
    rows = [(0, [big, 1.0]), (1, [big, -1.0]), (2, [-big, 0.0]), (3, [1.0, 1.0])]
    got = [tuple(r) for r in knn.top_k(frame(spark, [x for _, x in rows], [i for i, _ in rows])).collect()]
    assert [(r[2], r[3]) for r in sorted(got)] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]
