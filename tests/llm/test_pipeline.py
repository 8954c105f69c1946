"""The pipeline's stages, and what each decides, against plain Python."""

import random
import re

import corpus_pipeline as cp
from foldline.llm import lines, packing, quality
from foldline.llm.queries import oracle_sql, queries
from tests.llm.util import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(rng):
    good = [". ".join(words(rng, 12, 3000).capitalize() for _ in range(rng.randrange(5, 30))) + "." for _ in range(260)]
    junk = ["".join(f"{w.upper()}!! " for w in words(rng, 80).split()) for _ in range(90)]
    texts = [f"Common head line here\n{t}" for t in good] + junk
    texts[7] += " Write to a.b@example.com or +49 30 1234567."
    texts += [texts[3], texts[3] + " end", texts[4].replace("w1", "w2", 1)]
    return texts, len(good), len(junk)


def test_each_stage(spark, tmp_path):
    texts, n_good, n_junk = corpus(random.Random(8))
    d = str(tmp_path)
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < n_good), 0) for i in range(n_good + n_junk)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS and all(r.n_chars == len(r.text) for r in kept[name])
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "simhash", "pii", "packing"]
    assert {r.doc_id for r in kept["quality"]} == set(range(len(texts))) - set(range(n_good, n_good + n_junk))
    by_host = {s: [r.text for r in kept["quality"] if r.source == s] for s in ("s0", "s1")}
    for r, q in zip(sorted(kept["lines"]), sorted(kept["quality"]), strict=True):
        pages = set(by_host[q.source])
        common = {x.strip() for x in q.text.split("\n") if sum(x.strip() in {y.strip() for y in p.split("\n")} for p in pages) >= max(lines.MIN_PAGES, lines.RATIO * len(pages) + 1e-9)}
        assert r.text == "\n".join(x for x in q.text.split("\n") if x.strip() not in common) and "Common head" not in r.text
    assert {r.doc_id for r in kept["simhash"]} == set(range(n_good))
    assert next(r.text for r in kept["pii"] if r.doc_id == 7).endswith("Write to [EMAIL] or [PHONE].")
    assert sum(a.text != b.text for a, b in zip(sorted(kept["pii"]), sorted(kept["simhash"]), strict=True)) == 1
    assert sum(r.length for r in kept["packing"]) == sum(len(packing.tokenize(r.text)) + 1 for r in kept["pii"])
    assert sorted(map(tuple, cp.run(spark, d).collect())) == sorted(map(tuple, kept["packing"]))


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
    assert len(quality.FEATURES) == len(quality.features(b"a b"))


def test_no_documents_and_odd_ones(spark, tmp_path):
    """Nothing to do, and null or empty values in every column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (2, "Fine words here.", None, "s", 16), (None, "Fine words here.", "en", "s", 16)])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] * len(rows), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        got = cp.run(spark, d).collect()
        assert all(r.length > 0 for r in got) and (rows or not got)
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in cp.STAGES[1:-1]:
            out = stage(spark, docs, d)
            assert out.columns == COLUMNS and out.count() == (len(rows) if stage is not cp.one_of_each else len({r[1] or "" for r in rows}))


def test_few_texts_go_to_python_at_a_time_and_once(spark, tmp_path):
    before, d = spark.conf.get(cp.BATCH), str(tmp_path)
    docs = spark.range(1_200).coalesce(1).selectExpr("id AS doc_id", "concat('Some words ', id) AS text")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    try:
        kept = cp.good_only(spark, docs, d)
        assert kept.count() == 1_200 and "binary" not in kept._jdf.queryExecution().optimizedPlan().toString()
        sizes = docs.mapInArrow(lambda batches: (b.slice(0, 1).select(["doc_id"]) for b in batches), "doc_id long").count()
        assert sizes >= 3
    finally:
        spark.conf.set(cp.BATCH, before)
