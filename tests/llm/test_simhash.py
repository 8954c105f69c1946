import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foldline.llm import simhash
from foldline.llm.components import components
from tests.llm.util import documents, words


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    """Fingerprint to the smallest index that links reach."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        base = words(rng, rng.randrange(3, 120)).split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "Edit"
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy))
    texts += [None, "", " \n", "one", "ONE", "é x y", "one two three four"] + ["copy of copies"] * 20
    got = {r.doc_id: r for r in simhash.simhash_digest(documents(spark, texts)).collect()}
    fps = [brute_fp(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_groups(fps)
    again = simhash.simhash_digest(documents(spark, ["a", "a", "b c"], [7, 7, None])).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in again))) == ["(7, 7)", "(7, 7)", "(None, None)"]
    assert simhash.simhash_digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 100])
def test_links_join_the_right_groups(spark, monkeypatch, block):
    """Balls of near fingerprints, with chains between them; small blocks send large keys the long way."""
    rng = np.random.default_rng(4)
    fps = set(rng.integers(0, 2**63, 500).tolist())
    for centre in list(fps)[:6]:
        for _ in range(300):
            x = centre
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    x = np.array(fps, np.uint64)
    monkeypatch.setattr(simhash, "BLOCK", block)
    key = np.zeros(len(x), np.uint64)
    links, large = simhash._links(key, x.reshape(-1, 1))
    if block == 100:
        assert sum(len(f) for _, f in large) == len(x) and not links
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "node long")
    links = simhash.linked(df)
    assert links.count() < 60 * len(x)
    comp = {r.node: r.component for r in components(links).collect()}
    want = brute_groups(fps)
    signed = x.view(np.int64).tolist()
    mine = [comp.get(v, v) for v in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_blocks_together_say_the_same():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 600).astype(np.uint64)).reshape(-1, 1)
    whole = {tuple(map(int, p)) for a, b in simhash._forest(x) for p in zip(a, b, strict=True)}
    parts = [np.arange(len(x))[i : i + 100] for i in range(0, len(x), 100)]
    split = set()
    for i, u in enumerate(parts):
        for v in parts[i:]:
            rows = u if v is u else np.r_[u, v]
            got = simhash._forest(x[rows]) if v is u else simhash._forest_between(x[rows], np.arange(len(rows)) < len(u))
            split |= {(int(rows[p]), int(rows[q])) for a, b in got for p, q in zip(a, b, strict=True)}

    def roots(links):
        r = list(range(len(x)))
        for _ in range(50):
            for a, b in links:
                r[a] = r[b] = min(r[a], r[b])
        return r

    assert roots(whole) == roots(split) and len(whole) < len(x)


def near_copies(rng, n, share):
    """Texts with a copy each in which this share of the words is replaced, and the similarity of their shingles."""
    out = []
    for _ in range(n):
        w = words(rng, 400, 4000).split()
        c = [f"n{rng.random()}" if rng.random() < share else x for x in w]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, c))
        out.append((" ".join(w), " ".join(c), len(a & b) / len(a | b)))
    return out


def test_wide_fingerprints_find_similarity_of_eight_tenths():
    pairs = [p for p in near_copies(random.Random(6), 400, 0.02) if p[2] >= 0.8]
    a, b = (np.array([simhash.fingerprint(p[i].encode(), 5, True) for p in pairs]) for i in (0, 1))
    met = (simhash.window_keys(a) == simhash.window_keys(b)).any(axis=0)
    assert len(pairs) > 100 and (met & simhash.within(a, b)).mean() > 0.95
    assert not simhash.within(a, np.roll(a, 1, axis=0)).any()


@pytest.mark.parametrize("block", [simhash.BLOCK, 60])
def test_one_of_each_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    lone = [words(rng, rng.randrange(20, 300), 4000) for _ in range(60)]
    pairs = [p for p in near_copies(rng, 40, 0.012) if p[2] >= 0.84]
    centre = words(rng, 400, 4000).split()
    ball = [" ".join(w if rng.random() > 0.01 else f"z{rng.random()}" for w in centre) for _ in range(100)]
    texts = lone + [p[0] for p in pairs] + [p[1] for p in pairs] + ball + [lone[5]] * 30 + ["", None]
    df = documents(spark, texts)
    out = simhash.keep_one(df)
    kept = sorted(r.doc_id for r in out.collect())
    assert out.columns == df.columns
    n, m = len(lone), len(pairs)
    assert kept[:n] == list(range(n))  # clean documents stay
    assert kept[n : n + m] == list(range(n, n + m))
    late = kept[n + m :]
    assert len([i for i in late if i < n + 2 * m]) <= m // 20 + 1
    assert len([i for i in late if n + 2 * m <= i < n + 2 * m + 100]) == 1
    assert late[-1] == len(texts) - 2 and len([i for i in late if i >= n + 2 * m + 100]) == 1  # no words: one stays


def test_rows_without_distinct_ids_keep_one_each(spark):
    rows = simhash.keep_one(documents(spark, ["a b c d e f", "a b c d e f", "x y z", "x y z", "q"], [1, 1, None, None, 1])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("1", "a b c d e f"), ("1", "q"), ("None", "x y z")]
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(7, 7), (None, 3), (201, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5} | {i: 5 for i in range(200, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("node")).first()[0] == 0


def test_very_long_texts(spark):
    rng = random.Random(21)
    long = words(rng, 200_000, 5_000)
    rows = simhash.simhash_digest(documents(spark, [long, long + " end", "x" * 1_000_000])).orderBy("doc_id").collect()
    fp = brute_fp(long)
    assert rows[0].fingerprint == f"{fp:016x}" and [r.component_id for r in rows] == [0, 0, 2]
