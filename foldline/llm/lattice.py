"""Embedding near-dedup by lattice hashing.

Each table projects unit vectors to eight dimensions at random and decodes them to the nearest point of the E8 lattice.
A vector lives in that cell and visits the cells of the nearest neighbouring points; vectors that meet are verified by
cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import buckets, join_back, scratch
from foldline.llm.components import components, stars
from foldline.llm.vectors import dimension, finite, matrix

COSINE = 0.9
#: Tables, cells visited in each besides one's own, and the lattice's scale. Two random vectors at cosine 0.9 meet in
#: some table with probability 0.99 (tests/llm/test_lattice.py measures it); nothing is fitted to data.
TABLES, VISITS, SCALE, SEED = 6, 4, 0.55, 20_240_501
#: A cell with more members is verified in blocks of so many, pair by pair of blocks.
BLOCK = 4_096
#: Pairs that are verified at a time, and rows that are compared with a block at a time.
PAIRS, ROWS = 50_000, 512

_TWO = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
_HALF = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
#: The 240 shortest vectors of E8.
NEIGHBOURS = np.array(_TWO + _HALF)
_MIX = np.random.default_rng(SEED).integers(1, 2**63, (TABLES, 8), dtype=np.uint64) | np.uint64(1)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    y = np.rint(x)
    rest = x - y
    worst = np.abs(rest).argmax(1)
    r = np.arange(len(x))
    step = np.where(rest[r, worst] >= 0, 1.0, -1.0) * (y.sum(1) % 2 != 0)
    y[r, worst] += step
    return y


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell(t: int, points: np.ndarray) -> np.ndarray:
    """A 63-bit name for a lattice point of table t."""
    with np.errstate(over="ignore"):
        h = ((2 * points).astype(np.int64).astype(np.uint64) * _MIX[t]).sum(-1, dtype=np.uint64) + np.uint64(t)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(1)).astype(np.int64)


def cells(u: np.ndarray) -> np.ndarray:
    """Names of cells [row, table, 1 + visits] for unit vectors; the first is where the vector lives."""
    d = max(u.shape[1], 8)
    u = np.pad(u, ((0, 0), (0, d - u.shape[1])))
    rng = np.random.default_rng(SEED)
    out = np.empty((len(u), TABLES, 1 + VISITS), np.int64)
    for t in range(TABLES):
        p = np.linalg.qr(rng.standard_normal((d, 8)))[0] * np.sqrt(d / 8) / SCALE
        y = u @ p + 2 * rng.random(8)
        c = decode(y)
        # The cell of c + v is the nearer the larger (y - c) . v is.
        side = (y - c) @ NEIGHBOURS.T
        near = np.argsort(-side, axis=1, kind="stable")[:, :VISITS]
        out[:, t, 0] = _cell(t, c)
        out[:, t, 1:] = _cell(t, c[:, None, :] + NEIGHBOURS[near])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _meet(own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (own[..., None] == seen).any(-1)


def _cosines(x: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In double precision as they are defined, or by unit vectors where squares overflow or vanish."""
    a, b = x[i], x[j]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        exact = (a * b).sum(1) / (np.sqrt((a**2).sum(1)) * np.sqrt((b**2).sum(1)))
    odd = ~np.isfinite(exact)
    exact[odd] = (u[i[odd]] * u[j[odd]]).sum(1)
    return exact


def _verify(node: np.ndarray, x: np.ndarray, lives: np.ndarray, cell: int, table: int, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of one cell, or between its two blocks, that no earlier table or other cell of this table counts; PAIRS at most at a time."""
    u = _unit(x)
    c = None
    for a in range(0, len(u), ROWS):
        i, j = np.nonzero(u[a : a + ROWS] @ u.T >= COSINE - 1e-9)
        i += a
        ok = (node[i] < node[j]) & (lives[i] | lives[j])
        if first is not None:
            ok &= first[i] != first[j]
        i, j = i[ok], j[ok]
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            near = _cosines(x, u, p, q) >= COSINE
            p, q = p[near], q[near]
            if not len(p):
                continue
            c = cells(u) if c is None else c
            p_visits, q_visits = _meet(c[q][:, :, 0], c[p]), _meet(c[p][:, :, 0], c[q])
            here = (p_visits | q_visits).argmax(1) == table
            # In this table a pair is counted where the second lives, if the first comes there; else where the first lives.
            keep = here & (np.where(p_visits[:, table], c[q, table, 0], c[p, table, 0]) == cell)
            yield p[keep], q[keep]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): one row for each row.

    Vectors link at cosine >= 0.9. A vector that is null, zero, of another length than the commonest, or holds null or
    non-finite components links with nothing, and so does a row with a null id. Equal vectors are one class, verified
    once and counted with their number; a third of all rows being one vector costs one member. Rows that share an id
    but not the vector are vectors each, in the component of their least id.

    Cells are named first, and only vectors that meet another one carry their components to a task. There a pair is
    counted once, in the first table where it meets, so that links are summed and never listed; a block returns a count
    for each vector and links that span it. Large cells are dealt in pairs of blocks, and a block's pairs are verified
    PAIRS at a time. Rows of one vector, and vectors of one component, are spread over tasks when they get their results.
    """
    d = dimension(df, vec_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.col("id").isNotNull() & finite(F.col("vec")) & (F.size("vec") == d) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("h", F.when(good, F.xxhash64(F.lit(1), "vec"))).withColumn("g", F.when(good, F.xxhash64(F.lit(2), "vec")))
    classes = rows.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = scratch(classes)
    if d:
        counts, links = _count_links(classes, d)
        comp = components(links)
    else:
        spark = df.sparkSession
        counts, comp = spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "node long, component long")
    of = classes.select("h", "g", "low", "n").join(counts.withColumnRenamed("node", "h"), "h", "left").join(comp.withColumnRenamed("node", "h"), "h", "left")
    of = scratch(of.select("h", "g", "low", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "h").alias("component")))
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_back(of.withColumnRenamed("n", "rows"), lowest, ["component"], "h").select("h", "g", F.col("rows").alias("n"), "n_links", "component_id")
    out = join_back(rows.select("id", "h", "g"), of, ["h", "g"], "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


def _count_links(classes: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) and the spanning links (a, b) of classes (h, n, vec)."""
    names = buckets(classes, 1)

    def members(batches):
        for batch in batches:
            c = cells(_unit(matrix(batch.column(1), d, float)))
            k = 1 + VISITS
            cell = c.reshape(len(c), -1)
            table = np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), k), len(c))
            lives = np.tile(np.arange(TABLES * k) % k == 0, len(c))
            node = np.repeat(batch.column(0).to_numpy(), TABLES * k)
            cell = cell.ravel()
            yield pa.RecordBatch.from_arrays([pa.array((cell % names).astype(np.int32)), pa.array(cell), pa.array(table), pa.array(lives), pa.array(node)], names=["bucket", "cell", "t", "lives", "node"])

    def shared(t: pa.Table) -> pa.Table:
        """Members of cells where someone lives and someone else comes, with the cell's number of blocks."""
        cell, lives = t["cell"].to_numpy(), t["lives"].to_numpy(zero_copy_only=False)
        _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        living = np.bincount(at, lives, len(n))
        keep = (n[at] > 1) & (living[at] > 0)
        block = np.zeros(len(cell), np.int64)
        order = np.argsort(at, kind="stable")
        starts = np.r_[0, np.cumsum(n)[:-1]]
        block[order] = (np.arange(len(cell)) - starts[at[order]]) // BLOCK
        return t.drop_columns("bucket").append_column("block", pa.array(block)).append_column("blocks", pa.array(-(-n[at] // BLOCK))).filter(pa.array(keep))

    met = classes.select("h", "vec").mapInArrow(members, "bucket int, cell long, t int, lives boolean, node long")
    met = scratch(met.groupBy("bucket").applyInArrow(shared, "cell long, t int, lives boolean, node long, block long, blocks long"))
    both = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    both = both.select("cell", "t", "lives", "node", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") <= F.col("to")).alias("first"))
    full = both.join(classes.select(F.col("h").alias("node"), "n", "vec"), "node")
    # A few thousand cells in a group; a pair of large blocks falls to a group of its own by its hash.
    parts = buckets(met, 0.5)
    full = full.withColumn("bucket", F.pmod(F.xxhash64("cell", "t", "i", "j"), F.lit(parts)))

    def local(t: pa.Table) -> pa.Table:
        cell, tab, i, j = (t[c].to_numpy() for c in ("cell", "t", "i", "j"))
        lives, first = (t[c].to_numpy(zero_copy_only=False) for c in ("lives", "first"))
        node, weight, x = t["node"].to_numpy(), t["n"].to_numpy(), matrix(t["vec"], d, float)
        order = np.lexsort((j, i, tab, cell))
        k = np.stack([cell, tab, i, j])[:, order]
        cuts = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(0), True])
        links = np.zeros(len(node), np.int64)
        out_a, out_b = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r = order[a:b]
            between = first[r] if i[r[0]] != j[r[0]] else None
            for p, q in _verify(node[r], x[r], lives[r], int(cell[r[0]]), int(tab[r[0]]), between):
                p, q = r[p], r[q]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                s, t_ = stars(node[p], node[q])
                out_a.append(s)
                out_b.append(t_)
        none = [np.zeros(0, np.int64)]
        n, at = np.unique(node[links > 0], return_inverse=True)
        links = np.bincount(at, links[links > 0], len(n)).astype(np.int64)
        a, b = stars(np.concatenate(out_a or none), np.concatenate(out_b or none))
        # One shape for both: counts have no second node.
        return pa.table({"a": np.r_[n, a], "b": pa.array(np.r_[n, b], mask=np.r_[np.ones(len(n), bool), np.zeros(len(b), bool)]), "links": np.r_[links, np.zeros(len(a), np.int64)]})

    said = scratch(full.groupBy("bucket").applyInArrow(local, "a long, b long, links long"))
    return said.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), said.where("b is not null").select("a", "b")


#: The same in DuckDB, over all pairs, for distinct ids; the operator meets a pair at the limit with a probability of 0.99.
NEAR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN k ON v.vec_id = k.a
"""
