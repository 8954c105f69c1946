"""The exact join of texts by shingles, against all pairs."""

import random

import numpy as np
import pytest

from foldline.llm import common, jaccard, simhash
from tests.llm.util import documents, words


def similarity(x, y, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def brute_kept(texts):
    """Indexes that are the smallest of those that chains of pairs of 0.8 or more join."""
    sets = [jaccard.shingle_set(t.encode(), 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard.similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [i for i, r in enumerate(root) if r == i]


def with_tail(rng, w, share):
    """``w`` with so much of its end replaced."""
    n = round(len(w) * share)
    return " ".join(w[: len(w) - n] + [f"n{rng.random()}" for _ in range(n)])


def test_pairs_below_the_limit_stay(spark):
    """Texts that share a long passage at 0.65 to 0.79 are no near-duplicates; fingerprints linked most of them."""
    rng = random.Random(11)
    texts = []
    for share in (0.12, 0.14, 0.16, 0.18, 0.2):
        for _ in range(12):
            w = words(rng, 400, 4000).split()
            texts += [" ".join(w), with_tail(rng, w, share)]
    assert all(0.65 <= similarity(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert simhash.keep_one(documents(spark, texts)).count() == len(texts)
    s = [np.arange(n, dtype=np.uint64) for n in (80, 79, 100)]
    assert jaccard.similar(s[0], s[2]) and not jaccard.similar(s[1], s[2])  # the limit itself links


def test_pairs_at_the_limit_and_short_texts_go(spark):
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 60:  # long texts at 0.80 to 0.82
        w = words(rng, 400, 4000).split()
        other = with_tail(rng, w, rng.uniform(0.09, 0.11))
        if 0.8 <= similarity(" ".join(w), other) <= 0.82:
            pairs.append((" ".join(w), other))
    for n in range(8, 21):  # 4 shingles against 5, to 16 against 17
        for _ in range(8):
            w = words(rng, n, 100_000).split()
            pairs.append((" ".join(w), " ".join([*w, "more"])))
    assert all(similarity(a, b) >= 0.8 for a, b in pairs)
    texts = [a for a, _ in pairs] + [b for _, b in pairs]
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()) == list(range(len(pairs)))


@pytest.mark.parametrize(("few", "block"), [(jaccard.FEW, jaccard.BLOCK), (2, 7)])
def test_same_as_all_pairs(spark, monkeypatch, few, block):
    """Groups around centres, chains between them, common passages; small limits send all keys the long way."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(13)
    passage, texts = words(rng, 60, 4000).split(), []
    for _ in range(12):
        centre = words(rng, rng.randrange(8, 120), 4000).split()
        for _ in range(rng.randrange(1, 40)):
            w = [x if rng.random() > 0.02 else f"n{rng.random()}" for x in centre]
            texts.append(" ".join(w[: len(w) - rng.randrange(len(w) // 5)] + rng.choice([[], passage])))
    rng.shuffle(texts)
    kept = sorted(r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect())
    assert kept == brute_kept(texts) and 12 < len(kept) < len(texts)


def test_sketches_never_differ_in_more_bits_than_sets_do():
    rng = np.random.default_rng(14)
    for n, m, both in [(0, 0, 0), (0, 3, 0), (1, 1, 1), (64, 65, 60), (400, 420, 380), (900, 5_000, 700), (3_000, 3_000, 2_700)]:
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = np.sort(h[:n]), np.sort(h[n - both :])
        assert len(b) == m and jaccard.differing(jaccard.sketch(a), jaccard.sketch(b)) <= n + m - 2 * both
    a, b = rng.integers(0, 1 << 63, (2, 400), dtype=np.uint64)
    assert (jaccard.UP + jaccard.DOWN) * jaccard.differing(jaccard.sketch(a), jaccard.sketch(b)) > 800  # unlike sets are ruled out


def test_rows_without_ids_whatever_the_sieve_lets_through(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE", 64)
    rows = spark.createDataFrame([(i, str(i)) for i in [*range(-50, 300), None]], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(-40, 200, 7)], "id long")
    got = common.without(rows, ids, "id")
    assert got.columns == rows.columns and {r.id for r in got.collect()} == {*range(-50, 300), None} - set(range(-40, 200, 7))
    assert common.without(rows, ids.limit(0), "id").count() == 351


def shuffled(spark):
    """Bytes of shuffle written so far."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_a_near_one_are_not_shuffled(spark):
    """Keys are, of a fifth of the shingles; texts were again and again, whole."""
    rng = random.Random(15)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(400)) for _ in range(300)]
    df = documents(spark, [*texts, texts[7] + " end"])
    before, size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), sum(map(len, texts))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = shuffled(spark)
        assert simhash.keep_one(df).count() == len(texts)
        assert shuffled(spark) - start < size / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_fingerprints_propose_pairs(spark):
    """The pipeline's stage asks for pairs by SimHash and pigeonring filtering: what four bits or fewer join, none else."""
    rng = random.Random(16)
    fps = [0, -1]
    for _ in range(30):
        fps.append(rng.getrandbits(64) - (1 << 63))
        fps += [fps[-1] ^ sum(1 << b for b in rng.sample(range(63), k)) for k in (0, 1, 4, 5)]
    sets = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    pairs = [(r.a, r.b) for r in jaccard.near(sets, simhash.linked).collect()]
    bits = lambda i, j: ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count()
    roots = []
    for links in (pairs, [(i, j) for j in range(len(fps)) for i in range(j) if bits(i, j) <= simhash.BITS]):
        root = list(range(len(fps)))
        for _ in range(8):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        roots.append(root)
    assert roots[0] == roots[1] and all(i < j for i, j in pairs)


def test_what_fingerprints_propose_is_counted_and_what_they_miss_is_found(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "linked", lambda fps: asked.append(fps.count()) or linked(fps))
    linked = lambda fps: fps.crossJoin(fps.toDF("b")).where("node < b").toDF("a", "b")
    rng = random.Random(17)
    w = words(rng, 400, 4000).split()
    texts = [" ".join(w), with_tail(rng, w, 0.01), with_tail(rng, w, 0.1), with_tail(rng, w, 0.2), words(rng, 300, 4000)]
    kept = brute_kept(texts)
    assert [r.doc_id for r in simhash.keep_one(documents(spark, texts)).orderBy("doc_id").collect()] == kept and asked == [5]
    linked = lambda fps: fps.select(fps.node.alias("a"), fps.node.alias("b")).limit(0)
    assert [r.doc_id for r in simhash.keep_one(documents(spark, texts)).orderBy("doc_id").collect()] == kept and len(asked) == 2
