import hashlib

import pytest
from pyspark.sql import functions as F

from foldline.llm import lines
from tests.llm.util import documents


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_drops_only_what_a_host_repeats(spark):
    texts = [f"head\nbody {i}\n\n  head " for i in range(10)] + ["head\nother"] + [None, "", "\n"] + ["copy line\nsecond"] * 9
    sources = ["a"] * 10 + ["b"] + ["a", "a", None] + ["c"] * 9
    df = documents(spark, texts, sources=sources)
    got = {r.doc_id: r for r in lines.line_digest(df).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept_sha256) == (4, 2, sha("body 0\n"))
    assert (got[10].n_dropped, got[10].kept_sha256) == (0, sha("head\nother"))  # all pages of b, but one page
    assert (got[11].n_lines, got[11].n_dropped) == (0, 0) and got[12].n_lines == 1
    assert all((got[i].n_dropped, got[i].kept_sha256) == (2, sha("")) for i in range(14, 23))
    assert len(got) == len(texts)
    out = lines.drop_boilerplate(df)
    assert out.columns == df.columns and out.count() == len(texts)
    kept = {r.doc_id: r.text for r in lines.drop_boilerplate(df, copies_once=True).collect()}
    assert kept[0] == "body 0\n" and all(kept[i] == "copy line\nsecond" for i in range(14, 23))  # nine copies are one page
    assert lines.line_digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("pages", "goes"), [(2, False), (6, False), (9, True), (30, True)])
def test_shares_of_a_host(spark, pages, goes):
    """Of 300 pages a line on 3 % to 10 % goes, one on 2 % stays; other hosts have their own count."""
    texts = [f"body {i}" + "\nshared line" * (i < pages) for i in range(300)] + ["other\nshared line"] + [f"other {i}" for i in range(99)]
    got = {r.doc_id: r.n_dropped for r in lines.line_digest(documents(spark, texts, sources=["big"] * 300 + ["small"] * 100)).collect()}
    assert {got[i] for i in range(pages)} == {int(goes)} and sum(got.values()) == pages * goes


def test_many_flagged_lines_take_the_shuffled_way(spark, monkeypatch):
    df = documents(spark, [f"head\nbody {i}" for i in range(40)])
    want = sorted(map(tuple, lines.line_digest(df).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, lines.line_digest(df).collect())) == want and want[0][2] == 1


def test_columns_with_the_names_of_helpers(spark):
    df = documents(spark, [f"head\nbody {i}" for i in range(6)] + [None])
    odd = df.select("*", *(F.lit(n).alias(n) for n in ("_lines", "_host", "_flagged", "_salt", "_to", "_said", "_keys", "_hit", "_Hit_")))
    out = lines.drop_boilerplate(odd)
    assert out.columns == odd.columns
    rows = out.orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"body {i}" for i in range(6)] + [None] and {(r._lines, r._host, r._hit) for r in rows} == {("_lines", "_host", "_hit")}
    assert lines.mark_lines(odd).select("_lines").first()[0][0].dropped


def test_very_long_texts(spark):
    long = "\n".join(["menu", *(f"line {i}" for i in range(60_000)), "x" * 500_000])
    df = documents(spark, [long, "menu\nb", "menu\nc"], sources=["a"])
    got = {r.doc_id: r for r in lines.line_digest(df).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept_sha256) == (60_002, 1, sha(long[5:]))
