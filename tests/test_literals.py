"""Statements without their literals have the digests of the statements, whatever they hold."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldline.functions import Options, columns, statement_digest, without_literals
from foldline.functions.engine import compute
from foldline.goldens import GOLDENS
from foldline.plans import logs
from foldline.queries import CASES, FAULTS

PIECES = (
    *"0 1 9 5 . , ( ) - + / * @ : = < > ! ? ; & | % ^ ~ # $ _ [ ] { } ` ' \" \\".split(), " ", "\t", "\n", "\x0b", "\x00", "\x01", " ", "é", "名", "🙂", "�",
    "a", "e", "x", "b", "N", "_utf8", "0x1F", "0b1", "1e5", "1.5", "1.", ".5", "2.5e-3", "12abc", "'s'", "'it''s'", "'a\\'b'", "'", '"d"', "x'1f'", "N'n'", "/*", "*/", "/*!50000 ", "/*+ ", "--", "-- ", "@@", "@x", "->", "->>", "in", "null", "is", "not",
    "SELECT ", "VALUES ", "(1,2),(3,4)", "IN (1, 2)", "t.1", "t. 1", "t.5e1",
)


@pytest.mark.parametrize(("ansi", "plain"), [(False, False), (True, False), (False, True), (True, True)])
def test_digests_stay(spark, ansi, plain):
    rng = random.Random(17 * ansi + plain)
    some = [c[2] for c in CASES] + [f[0] for f in FAULTS] + [g[0] for g in GOLDENS]
    some += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(12_000)]
    calm = [p for p in PIECES if not set(p) & set("'\"`\\#$/\x00\x01�")] + ["'s'", "'it''s'", "'é�'", "/", " ", " ", ", "]
    some += ["".join(rng.choice(calm) for _ in range(rng.randrange(1, 20))) for _ in range(8_000)]
    options = Options(ansi_quotes=ansi, no_backslash_escapes=plain)
    rows = spark.createDataFrame([(s,) for s in some], "s string").repartition(4).select("s", without_literals("s", options).alias("t")).collect()
    for r in rows:
        a, b = (compute(x.encode(), "8.0", ansi, plain) for x in (r.s, r.t))
        assert a == b, (r.s, r.t)
    assert sum(r.s != r.t for r in rows) > 1_500


def test_statements_that_differ_in_literals_become_one(spark):
    df = spark.range(500).selectExpr("concat('SELECT a1 FROM t2 WHERE b = ', id, ' AND c IN (', id / 7, ', -', id, 'e3) OR d = ''', id, '''''x \\\\''''')  AS s")
    assert df.select(without_literals("s")).distinct().count() == 1
    broken = spark.range(1).select(F.concat(F.lit("SELECT 1, "), F.unhex(F.lit("ff41")).cast("string"), F.lit(" , 'a'")).alias("s"))
    assert broken.select(without_literals("s").cast("binary")).first()[0] == b"SELECT 1, \xffA , 'a'"
    inside = spark.range(1).select(F.concat(F.lit("SELECT '"), F.unhex(F.lit("e2")).cast("string"), F.lit("', 7")).alias("s"))
    assert inside.select(statement_digest("s")).first()[0]["text"] == "SELECT ?, ..."


def test_very_long_statements(spark):
    rows = ", ".join(f"({i}, 'a''b\\\\{i}', {i}.5)" for i in range(150_000))
    df = spark.createDataFrame([(f"INSERT INTO t VALUES {rows}",), ("SELECT " + "- 1" * 500_000,), ("SELECT '" + "\\'" * 1_000_000 + "'",), (None,), ("",)], "s string")
    got = [r[0] and r[0]["text"] for r in df.select(statement_digest("s")).collect()]
    assert got[0].endswith("VALUES (...) /* , ... */") and got[1].startswith("SELECT ? - ?") and got[2:] == ["SELECT ?", None, ""]


def test_columns_of_bytes_and_nulls(spark):
    df = spark.createDataFrame([(bytearray(b"SELECT 1"),), (None,), (bytearray(b"SELECT \xff"),), (bytearray(b"SELECT 'a"),)], "s binary")
    got = [r[0] for r in df.select(statement_digest("s")).collect()]
    assert got[1] is None and got[0]["text"] == "SELECT ?" and got[3]["error"]["position"] == 7
    assert got[2]["hash"] == compute(b"SELECT \xff").hash


def test_small_logs_are_spread_and_large_ones_stay(spark, monkeypatch):
    log = spark.range(100).selectExpr("concat('SELECT ', id) AS sql").coalesce(1)
    assert logs.spread(log).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(logs, "SMALL", 0)
    assert logs.spread(log).rdd.getNumPartitions() == 1


def test_long_texts_are_dealt_evenly_whatever_their_size(spark, monkeypatch):
    log = spark.range(100).selectExpr("concat('SELECT ', id) AS sql").coalesce(1)
    monkeypatch.setattr(logs, "PART", 100)
    dealt = logs.dealt(log)
    sizes = dealt.groupBy(F.spark_partition_id()).count().select(F.max("count"), F.sum("count")).first()
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and tuple(sizes)[1] == 100 and sizes[0] < 20


def test_long_texts_go_to_python_by_few_bytes(spark, monkeypatch):
    before = spark.conf.get(logs.BATCH)
    monkeypatch.setattr(logs, "BATCH_BYTES", 40_000)

    @F.arrow_udf("long")
    def held(x: pa.Array) -> pa.Array:
        return pa.array([sum(len(s.as_py()) for s in x)] * len(x), pa.int64())

    try:
        log = logs.dealt(spark.range(400).selectExpr("repeat(char(65 + id % 26), 1000) AS sql"))
        assert log.select(held("sql").alias("n")).agg(F.max("n")).first()[0] <= 41_000
    finally:
        spark.conf.set(logs.BATCH, before)


def test_slices_and_what_is_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(columns, "SLICE_BYTES", 100)
    monkeypatch.setattr(columns, "REMEMBERED_TOTAL", 5_000)
    known, most = columns._Remembered(Options()), []
    values = [None if i % 7 == 0 else b"SELECT a%d FROM t" % (i % 40) for i in range(300)] + [b"SELECT '" + b"x" * 500 + b"'", b""]

    def one(sql):
        most.append(known.held)
        return None if sql is None else known[sql]

    got = columns._by_distinct(pa.array(values, pa.string()), one, columns._RAW_ARROW).to_pylist()
    assert [x and x["hash"] for x in got] == [None if s is None else compute(s).hash for s in values]
    assert 0 < max(most) <= 5_000 and len(most) > 60
    assert max(map(len, columns._slices(pa.array(values, pa.binary())))) < 10
    assert columns._by_distinct(pa.array([], pa.binary()), one, columns._RAW_ARROW).to_pylist() == []
