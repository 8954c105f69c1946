"""Column functions, operators, sources and sinks on Spark."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from foldline import functions as fn
from foldline import operators as op
from foldline import sources
from foldline.functions import Options, engine
from foldline.operators import digests
from foldline.queries import queries
from foldline.streaming import digest_sessions, digest_windows

#: How JSON writes a less-than sign here.
LESS = chr(92) + "u003c"


def test_columns_agree_with_the_engine(spark):
    statements = ["SELECT 1", "SELECT 'x", None, "", "INSERT INTO t VALUES (1),(2)", "SELECT 名 FROM `a``b`"]
    df = spark.createDataFrame([(s,) for s in statements], "sql string")
    for options in (Options(), Options("5.7"), Options("9.0", True, True, 9)):
        rows = df.select("sql", fn.statement_digest("sql", options).alias("d")).collect()
        for r in rows:
            if r.sql is None:
                assert r.d is None
                continue
            want = engine.compute(r.sql.encode(), options.version, options.ansi_quotes, options.no_backslash_escapes, options.max_length)
            assert (r.d.hash, r.d.text) == (want.hash, want.text.decode("utf-8", "replace"))
            assert (r.d.error and r.d.error.message) == (want.fault and want.fault.message)
    with pytest.raises(ValueError):
        Options("4.1")


def test_the_digest_is_computed_once(spark):
    plan = op.with_digest(spark.createDataFrame([("SELECT 1",)], "sql string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_distinct_first_gives_the_same(spark):
    log = spark.createDataFrame([(i, None if i % 7 == 0 else f"SELECT {i % 3} FROM t{i % 2}") for i in range(50)], "id long, sql string")
    assert sorted(map(str, op.with_digest(log).collect())) == sorted(map(str, op.digest_statements(log).select(op.with_digest(log).columns).collect()))


def test_sql_functions(spark):
    fn.register(spark)
    r = spark.sql("SELECT statement_digest('SELECT 1') h, statement_digest_text('SELECT 1') t, statement_digest_json('SELECT ''<') e, statement_digest_json('SELECT 1 < 2') j, statement_digest(NULL) n").first()
    want = engine.compute(b"SELECT 1")
    assert (r.h, r.t, r.n) == (want.hash, "SELECT ?", None)
    assert json.loads(r.e) == {"error": "lex error at position 7: unterminated string literal (near \"SELECT '<\")"}
    assert LESS in r.e and json.loads(r.j)["text"] == "SELECT ? < ?" and LESS in r.j
    assert [tuple(x) for x in spark.sql("SELECT * FROM tokenize_sql('a = 1')").collect()] == [(482, 0, 1, "a"), (415, 2, 3, "="), (628, 4, 5, "1")]


def test_log_operators(spark):
    log = op.with_digest(spark.createDataFrame([(1, "SELECT 1"), (2, "SELECT 2"), (3, "SELECT a"), (4, None)], "ts long, sql string"))
    top = op.top_digests(log.where("sql is not null"), 1).first()
    assert (top.digest_text, top.n) == ("SELECT ?", 2)
    known = log.where("ts = 1")
    assert [r.ts for r in op.known_digests(log, known).orderBy("ts").collect()] == [1, 2]
    assert [r.ts for r in op.unknown_digests(log, known).orderBy("ts").collect()] == [3, 4]
    assert {r.ts for r in op.first_seen(log, "ts").collect()} == {1, 3, 4}
    changes = op.compare_logs(log.where("ts < 3"), log.where("ts in (2, 3)")).collect()
    assert [r.change for r in changes] == ["new"]
    assert [r.nth for r in op.numbered(log.where("ts < 3").withColumn("ts", F.timestamp_seconds("ts")), "ts").orderBy("ts").collect()] == [1, 2]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(i * 60, f"SELECT {i} FROM t{i % 2}") for i in range(40)], "s long, sql string").select(F.timestamp_seconds("s").alias("ts"), "sql")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    for name, f in (("w", digest_windows), ("s", digest_sessions)):
        q = f(stream).writeStream.outputMode("append" if name == "s" else "complete").format("memory").queryName(f"out_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = digest_windows(log).groupBy().agg(F.sum("n")).first()[0]
    assert spark.table("out_w").groupBy().agg(F.sum("n")).first()[0] == batch == 40
    assert digest_sessions(log).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("\n　SELECT 1 <\n 2; \n")
    (tmp_path / "in" / "b.sql").write_text(" \n")
    log = op.with_digest(sources.from_files(spark, str(tmp_path / "in")))
    assert [r.sql for r in log.collect()] == ["SELECT 1 <\n 2;"]
    log = log.union(op.with_digest(sources.from_text(spark, "SELECT 'open")))
    for form, want in (("text", "SELECT ? < ?"), ("hash", engine.compute(b"SELECT 1 < 2").hash)):
        sources.write_digests(log, str(tmp_path / form), form)
        assert [r.value for r in spark.read.text(str(tmp_path / form)).collect()] == [want]
    sources.write_digests(log, str(tmp_path / "json"), "json")
    line = spark.read.text(str(tmp_path / "json")).first().value
    assert json.loads(line)["digest_text"] == "SELECT ? < ?" and LESS in line
    sources.write_digests(log, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines"), wholetext=True).first().value.startswith("DIGEST: ")


def run(*args, stdin=""):
    return subprocess.run([sys.executable, "-m", "foldline.cli", *args], input=stdin, capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_command_line(tmp_path):
    f = tmp_path / "q.sql"
    f.write_text(" SELECT 2 < 1\n")
    h = engine.compute(b"SELECT 2 < 1").hash
    assert run("--file", str(f)).stdout == f"DIGEST: {h}\nDIGEST_TEXT: SELECT ? < ?\n"
    assert run("SELECT 1", "--text-only", "--hash-only").stdout == "SELECT ?\n"
    assert run("--hash-only", stdin="SELECT 9 < 8").stdout == h + "\n"
    assert run("--sql", "SELECT a", "-f", str(f), "--json", "--text-only").stdout == json.dumps({"digest": engine.compute(b"SELECT a").hash, "digest_text": "SELECT `a`"}, indent=2) + "\n"
    assert LESS in run("SELECT 1<2", "--json").stdout
    for bad in (run(stdin=" \n"), run("--sql", "SELECT 'a"), run("-f", str(tmp_path / "none"))):
        assert bad.returncode == 1 and bad.stderr.startswith("Error: ") and not bad.stdout
    assert "no SQL input provided" in run(stdin=" ").stderr


def test_statements_that_differ_in_literals_are_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(digests, "with_digest", lambda log, *a, real=digests.with_digest: (read.append(log.count()), real(log, *a))[1])
    log = spark.range(500).selectExpr("id", "CASE WHEN id > 1 THEN concat('SELECT ', id, ' FROM t', id % 2) WHEN id = 1 THEN 'SELECT ''a' END AS sql")
    want = op.with_digest(log)
    assert op.digest_statements(log).columns == want.columns
    assert sorted(map(str, op.digest_statements(log).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, op.summarize_statements(log).collect())) == sorted(map(str, op.summarize(want).collect()))
    assert read == [3, 3, 4]  # and a null


def test_distinct_first_does_not_join(spark):
    plan = queries()["digest_distinct_first"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 2
