import math
import random
import zlib
from collections import Counter

import numpy as np

from foldline.llm import quality
from tests.llm.util import documents, words

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    m = quality.train(docs, labels)
    got = quality.score(docs, m).join(labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    h = got[got.held_out]
    assert ((h.predicted == h.quality).mean()) > 0.97
    assert h.score[h.quality == 1].mean() > 0.9 > 0.3 > h.score[h.quality == 0].mean()
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    kept = quality.keep_good(docs, m)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_odd_rows(spark):
    docs = documents(spark, ["", None, "fine words here", "x" * 300_000, "fine words here"], [1, 2, 3, None, 3])
    for labels in ([], [(1, 1), (2, 1)], [(1, 0), (1, 1), (2, None), (99, 1), (3, 0), (None, 1)]):
        m = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = quality.score(docs, m).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert quality.score(documents(spark, []), m).count() == 0


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def plain_features(text):
    """The features, counted byte by byte and word by word."""
    b = text.encode()
    n, w = max(len(b), 1), b.split()
    k = max(len(w), 1)
    at = Counter(bytes([x]) for x in b)
    share = lambda chars: sum(at[c.encode()] for c in chars) / n
    rows = [x for x in b.split(b"\n") if x.strip()]
    upper = sum(at[bytes([x])] for x in range(65, 91)) + sum(text.count(c) for c in "ÀÄÉÊÍÑÖÜÈÇ")
    return [
        math.log1p(len(w)), (n - k) / k, len(set(w)) / k, sum(x == y for x, y in zip(w, w[1:], strict=False)) / k, upper / n, share("0123456789"), share(".,:;!?'\"()-"), share("!"), share("|"),
        share("#$%&*^~@=+_\\"), share(" \t\r\n"), sum(c for x, c in at.items() if x[0] > 127) / n, math.log1p(len(rows)), len(w) / max(len(rows), 1), 1 - len(set(rows)) / max(len(rows), 1), max(Counter(w).values(), default=0) / k,
        at[b"."] / k, share("<>{}[]/"), max(map(len, w), default=0), at[b"@"] / k,
    ]


def test_scores_against_plain_loops(spark):
    rng = random.Random(9)
    good = [". ".join(words(rng, 9, 900).capitalize() for _ in range(rng.randrange(1, 12))) + ".\n" + words(rng, 5) for _ in range(120)]
    junk = [words(rng, 30).upper() + "!!! $$$ | | a@b <b>" * rng.randrange(4) for _ in range(80)]
    texts = [*good, *junk, "", None, "ÀÄÉ ÊÍÑ ÖÜÈÇ é", "same same same\nsame\nsame", "x" * 5_000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(good) + len(junk))], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert m.pairs and len(m.tables) == len(quality.FEATURES)
    for r in quality.score(docs, m).collect():
        x = plain_features(texts[r.doc_id] or "")
        assert np.allclose(x, quality.features((texts[r.doc_id] or "").encode()), rtol=1e-12), r.doc_id
        x = quality.features((texts[r.doc_id] or "").encode())  # the last bits decide at an edge
        z = m.base
        for value, edges, t in zip(x, m.edges, m.tables, strict=True):
            z += t[sum(e <= value for e in edges)]
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            z += t[sum(e <= x[a] for e in m.coarse[a])][sum(e <= x[b] for e in m.coarse[b])]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_keep_good_with_the_names_of_helpers(spark):
    docs = documents(spark, ["fine words here", None]).selectExpr("*", "'mine' AS _text")
    out = quality.keep_good(docs, quality.Model(base=3.0))
    assert out.columns == docs.columns and [r._text for r in out.collect()] == ["mine", "mine"]
