"""Joins that spread heavy keys, components with hubs, the shared folder."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foldline.llm import common
from foldline.llm.components import components


@pytest.mark.parametrize("heavy", [common.HEAVY, 4])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_back_is_a_join(spark, monkeypatch, heavy, how):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rows = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN null ELSE id % 40 END AS a", "id % 2 AS b")
    groups = rows.where("a is not null and a <> 5").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    want = rows.join(groups.drop("n"), ["a", "b"], how).select("id", "a", "b", "top")
    got = common.join_back(rows, groups, ["a", "b"], "id", how)
    assert got.columns == ["id", "a", "b", "top"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_heavy_key_is_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = spark.range(4_000).selectExpr("id", "CASE WHEN id < 3000 THEN 7 ELSE id END AS a")
    groups = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    out = common.join_back(rows, groups, ["a"], "id").where("a = 7").select(F.spark_partition_id().alias("p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3_000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1_500


@pytest.mark.parametrize("heavy", [common.HEAVY, 5])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "HEAVY", heavy)
    rng = random.Random(3)
    edges = [(1_000, i) for i in range(300)] + [(i, i + 1) for i in range(2_000, 2_060)] + [(rng.randrange(3_000, 3_100), rng.randrange(3_000, 3_100)) for _ in range(80)] + [(5, 5), (None, 1), (2_060, 299)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id AS _a", "id AS _A_", "id AS b")
    assert common.fresh(df, "_a", "b", "c") == ["_a__", "b_", "c"]
