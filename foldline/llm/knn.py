"""Exact top-k search by inner product: a Voronoi kNN join.

Rows are grouped by their nearest pivot. From each group's summary (pivot, radius, largest norm) follows a bound on what
any of its rows can score; a query goes only to groups whose bound reaches what it has surely found, and each block of a
group is searched locally.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.llm.common import scratch
from foldline.llm.vectors import dimension, finite, matrix

#: Pivots are the rows of least hash: as many as the square root of the rows, within these bounds. A block is what one task
#: searches at once, and so many queries ask it together.
PIVOTS, MOST_PIVOTS, BLOCK, QUERY_BLOCK = 256, 4_096, 20_000, 4_096


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by way of doubles where those are exact too. Beyond a long they are its limits."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if most < 2**62 else np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(ids: np.ndarray, data: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the k best rows of a block for each query, ties to smaller ids; never a row with the query's id."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    out = []
    for at in range(0, len(qids), 256):
        q = qids[at : at + 256]
        scores = _products(queries[at : at + 256], data)
        for i, s in enumerate(scores):
            mine = np.flatnonzero(ids != q[i])
            s = s[mine]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                able = np.flatnonzero(s >= least)
                able = able[np.argsort(-s[able], kind="stable")][:k]
            else:
                able = np.argsort(-s, kind="stable")
            out.append((np.full(len(able), q[i]), ids[mine[able]], s[able]))
    return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))


def routed(data: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``data`` (cell, block, ...) once for each part that has asked for their block."""
    return data.join(asked.select("cell", "block", "part").distinct(), ["cell", "block"])


def top_k(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the k rows of highest score.

    Components become floor(1024 * x). Rows with a null id, a null vector, null or non-finite components or another
    length than the commonest take no part. Rows that share the query's id are the query's own; if several rows have a
    query's id, the least of their vectors asks. Repeated rows of other ids are candidates each. With fewer than k
    candidates all are returned.

    The driver sees the pivots and one summary for each of them. A group is searched in blocks by hash of the row, and
    queries ask in blocks of one cell or of some near ones, so neither a large group nor many queries meet in one task. A block of rows
    is sent to those blocks of queries that ask for it and to no others; each returns k rows for a query at most.
    Components are limited to those of a long, and so are scores.
    """
    spark = df.sparkSession
    d = dimension(df, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return empty
    ok = df.where(F.col(id_col).isNotNull() & finite(F.col(vec_col)) & (F.size(vec_col) == d))
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * 1024).cast("long")).alias("vec"))
    some = rows.orderBy(F.xxhash64("id", "vec"), "id").limit(min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows.count())))).toArrow()
    pivot_ids, pivots = some["id"].to_numpy(), matrix(some["vec"], d, np.int64)
    centre = pivots.astype(float)
    half = (centre**2).sum(1) / 2

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(1), d, float)
            g = np.argmin(half - x @ centre.T, axis=1) if len(x) else np.zeros(0, np.int64)
            r = np.sqrt(((x - centre[g]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(r), pa.array(np.sqrt((x**2).sum(1)))], names=["id", "vec", "cell", "radius", "norm"])

    held = scratch(rows.mapInArrow(assign, "id long, vec array<long>, cell int, radius double, norm double"))
    asks = F.col("id") % every == 0
    summary = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r"), F.max("norm").alias("norm"), F.count_if(asks).alias("asks")).collect()
    radius, norm, blocks, parts = np.zeros(len(pivots)), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    for s in summary:
        c = s["cell"]
        radius[c], norm[c], blocks[c], parts[c] = s["r"], s["norm"], -(-s["n"] // BLOCK), max(1, -(-s["asks"] // QUERY_BLOCK))
    asked_of = {s["cell"]: s["asks"] for s in summary if s["asks"]}
    if not asked_of:
        return empty
    # Cells that lie at like distances from a pivot ask together until they have a block of queries; large ones ask alone.
    base, part, room = np.zeros(len(pivots), np.int64), 0, QUERY_BLOCK
    for c in np.argsort(((centre - centre[0]) ** 2).sum(1), kind="stable").tolist():
        n = asked_of.get(c, 0)
        if n > room:
            part, room = part + 1, QUERY_BLOCK
        base[c] = part
        room -= n
        if room < 0:
            part, room = part + int(parts[c]), QUERY_BLOCK
    queries = held.where(asks).groupBy("id").agg(F.min(F.struct("vec", "cell")).alias("q")).select("id", "q.vec", "q.cell")

    def route(batches):
        """A query with each block of each group that it needs."""
        for batch in batches:
            q, ids = matrix(batch.column(1), d, np.int64), batch.column(0).to_numpy()
            x = q.astype(float)
            size = np.sqrt((x**2).sum(1))
            # Pivots are rows too: the k-th best of them is a score that the query surely reaches.
            sure = np.where(ids[:, None] == pivot_ids[None, :], -np.inf, x @ centre.T)
            floor = np.sort(sure, axis=1)[:, -k] if len(pivot_ids) >= k else np.full(len(x), -np.inf)
            bound = np.minimum(x @ centre.T + size[:, None] * radius, size[:, None] * norm)
            bound = np.where(blocks > 0, bound + 1e-9 * np.abs(bound) + 1, -np.inf)
            i, g = np.nonzero((bound >= floor[:, None]) & (blocks > 0))
            i, g = np.repeat(i, blocks[g]), np.repeat(g, blocks[g])
            b = np.arange(len(g)) - np.searchsorted(g + i * len(blocks), g + i * len(blocks), side="left")
            own = batch.column(2).to_numpy()
            part = base[own[i]] + (ids[i] // every) % parts[own[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.astype(np.int32)), pa.array(b.astype(np.int64)), pa.array(part.astype(np.int64)), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))],
                names=["cell", "block", "part", "id", "vec"],
            )

    asked = scratch(queries.mapInArrow(route, "cell int, block long, part long, id long, vec array<long>"))
    in_cell = F.element_at(F.array(*(F.lit(int(max(b, 1))) for b in blocks)), F.col("cell") + 1)
    data = held.select("cell", F.pmod(F.xxhash64("id", "vec"), in_cell).cast("long").alias("block"), "id", "vec")
    sent = routed(data, asked).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))

    def local(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False)
        ids, x = t["id"].to_numpy(), matrix(t["vec"], d, np.int64)
        q, v, s = search(ids[~asks], x[~asks], ids[asks], x[asks], k)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    found = sent.groupBy("cell", "block", "part").applyInArrow(local, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB, for vectors of one length and distinct ids.
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
