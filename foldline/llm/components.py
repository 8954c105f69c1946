"""Connected components by alternating large-star and small-star steps, wholly in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import join_back, scratch


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes as one link from each to the smallest that it is joined with.

    A dense group is found again by many keys, and each would tell it by links of its own; by their smallest nodes they
    mostly tell the same.
    """
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(node))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        np.minimum.at(new, low[x], m)
        np.minimum.at(new, low[y], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    far = low != np.arange(len(node))
    return node[far], node[low[far]]


def _large_star(e: DataFrame, links: int) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    told = join_back(both.where("v > u"), low, ["u"], "v", total=2 * links)
    return told.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, links: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    lifted = join_back(e, low, ["u"], "v", total=links).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lifted.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Links may repeat, point either way or form loops; loops and nulls are ignored. Each round is written to the shared
    folder; the driver gets a count and a checksum only. Rounds grow with the logarithm of the longest chain. Links of a
    node that has very many are spread over tasks.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch(e)
    before = _mark(e)
    while before[0]:
        e = scratch(_small_star(_large_star(e, before[0]), before[0]))
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
