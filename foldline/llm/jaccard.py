"""Exact near-duplicates: links between texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of 64 bits propose pairs first, found by pigeonring filtering (simhash.linked); they can't tell the
limit, so each pair is counted, and what they miss is found exactly. Shingles have one order for all texts. Two sets of
similarity 0.8 share a shingle among the first fifth of each, so those are the keys (prefix filter), and the places of a
shared key bound the overlap (positional filter). Neither loses a pair. Shingles that are common come last; commonness is
a guess from a table of fixed size, and any order gives the same links.

A key of few texts proposes all of its pairs. A key of many proposes its smallest node with each other first. Only pairs
that the links found so far don't join go on. Sketches, whose differing bits never outnumber the shingles in which two
sets differ, rule out most; every pair that is left is counted on the two texts, and only such texts are shuffled.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm.common import buckets, join_back, lean, scratch, sieve, without
from foldline.llm.components import components
from foldline.llm.substring import sequence_hashes, word_hashes

#: Least similarity, as a fraction, so that the limit itself is exact.
UP, DOWN = 4, 5
#: A key of more texts than this proposes a star first.
FEW = 24
#: Pairs of the rest of such a key are made in blocks of so many texts.
BLOCK = 2_048
#: Cells of the table of common shingles, and pairs or sets that are held at a time.
CELLS, PAIRS, SETS = 1 << 22, 1_000_000, 256
#: Rows that go to Python at a time: each may hold two long texts.
ROWS = 500


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ROWS, int(before)) if int(before) > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text whose A-Z are lower-cased, repeats included; long texts come in stretches."""
    w = text.lower().split()
    if not w:
        return
    joined = b" ".join(w)
    n = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(n + 1) - 1
    k = max(len(w) - words + 1, 1)
    starts, stops = (ends - n)[:k].tolist(), ends[min(words, len(w)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    for at in range(0, k, 1 << 13):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 13)], stops[at : at + (1 << 13)], strict=True)], "<u8")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted; made from hashes of its words, which workers remember."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = min(words, len(w))
    return np.unique(sequence_hashes(word_hashes(w)[0], np.arange(len(w) - n + 1), n, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the limit; sets without shingles are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m whose first shared shingle is at these places can reach the limit."""
    return (UP + DOWN) * np.minimum(n - at, m - to) >= UP * (n + m)


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is in over half of the shingles' hashes. Signed."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 13):
        total += np.unpackbits(s[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(s), bitorder="little").view("<i8")[0])


def sketch(s: np.ndarray) -> bytes:
    """The parity of the shingles in each cell, of at least 64 cells and as many as the set has shingles, a power of two."""
    width = max(64, 1 << max(len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger folded: no more than there are shingles that one set alone has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    w = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, w), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) & np.uint64(CELLS - 1)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a set that are its keys, in the order of all sets."""
    rank = common[_cell(s)]
    return s[np.lexsort((s, rank))][: len(s) - (UP * len(s) + DOWN - 1) // DOWN + 1] if len(s) else s


def _surveyed(docs: DataFrame, words: int) -> DataFrame:
    """(node, a, b) for each text, 128 bits of its words; and (cell, n) for cells that stand out in a task."""

    def run(batches):
        count = np.zeros(CELLS, np.int32)
        for batch in batches:
            a, b = [], []
            for x in batch.column(1):
                text = x.as_py() or b""
                said = b" ".join(text.lower().split())
                a.append(xxhash.xxh64_intdigest(said, 1))
                b.append(xxhash.xxh64_intdigest(said, 2))
                s = shingle_set(text, words)
                np.add.at(count, _cell(s), 1)
            none = pa.nulls(len(a), pa.int64())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *signed, none, none], names=["node", "a", "b", "cell", "n"])
        out = np.flatnonzero(count >= 8 * (1 + count.mean()))
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(out), pa.array(count[out], pa.int64())], names=["node", "a", "b", "cell", "n"])

    return docs.mapInArrow(lean(run), "node bigint, a bigint, b bigint, cell bigint, n bigint")


def _common(surveyed: DataFrame) -> np.ndarray:
    """A rank for each cell: 0, or the logarithm of its count. The driver gets a part of ``CELLS`` rows at most."""
    t = surveyed.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[t["cell"].to_numpy()] = (4 * np.log2(t["n"].to_numpy())).astype(np.uint8)
    return out


def _prefixes(docs: DataFrame, words: int, common) -> DataFrame:
    """(node, n, keys, fp, sketch): the size of each set, its keys, eight bytes each, its fingerprint and its sketch."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py() or b"", words) for x in batch.column(1)]
            keys, sketches = (pa.array(x, pa.binary()) for x in ([prefix(s, common.value).tobytes() for s in sets], [sketch(s) for s in sets]))
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), keys, pa.array([fingerprint(s) for s in sets], pa.int64()), sketches]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "keys", "fp", "sketch"])

    return docs.mapInArrow(lean(run), "node bigint, n int, keys binary, fp bigint, sketch binary")


def near(sets: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): pairs that connect all nodes of ``sets`` (node, fp) whose fingerprints chains of near ones join."""
    fps = scratch(sets.groupBy("fp").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")))
    same = join_back(sets.select("node", "fp"), fps, ["fp"], "node").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = scratch(linked(fps.select(F.col("fp").alias("node"))).select(F.col("a").alias("_a"), F.col("b").alias("_b")))
    a, b = (fps.select(F.col("fp").alias(f"_{c}"), F.col("low").alias(c)) for c in "ab")
    met = pairs.join(a, "_a").join(b, "_b")
    return same.union(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``comp`` (node, component) doesn't join."""
    of_a, of_b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    told = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return told.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _distinct(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (a, b))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def proposed(prefixes: DataFrame) -> DataFrame:
    """(k, a, b, n, at): pairs (a, b) of keys of few texts and stars of the others, where k is null; and each row (k, node,
    size, place) of the others, where b is null."""
    n_buckets = buckets(prefixes, 0.5)

    def deal(batches):
        for batch in batches:
            n, node = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
            sizes = np.array([len(k) for k in keys], np.int64)
            k, row = np.concatenate([np.zeros(0, np.uint64), *keys]), np.repeat(np.arange(len(node)), sizes)
            at = np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bucket = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_buckets)
            for i in range(0, len(k), 100_000):
                p = slice(i, i + 100_000)
                cols = [bucket[p].astype(np.int32), k[p].view(np.int64), node[row[p]], n[row[p]], at[p].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "k", "node", "n", "at"])

    def pairs(t: pa.Table) -> pa.Table:
        k, node, n, at = (t[c].to_numpy() for c in ("k", "node", "n", "at"))
        order = np.lexsort((node, k))
        starts, sizes = _runs(k[order])
        a, b, rest = [], [], []
        for m in np.unique(sizes[sizes > 1]):
            s = starts[sizes == m]
            i, j = np.triu_indices(int(m), 1) if m <= FEW else (np.zeros(m - 1, np.int64), np.arange(1, m))
            step = max(1, PAIRS // len(i))
            for x in range(0, len(s), step):
                p, q = order[(s[x : x + step, None] + i).ravel()], order[(s[x : x + step, None] + j).ravel()]
                ok = _may(n[p].astype(np.int64), at[p], n[q].astype(np.int64), at[q])
                a.append(node[p[ok]])
                b.append(node[q[ok]])
            if m > FEW:
                rest.append(order[(s[:, None] + np.arange(m)).ravel()])
        a, b = _distinct(a, b)
        r, none = np.concatenate([np.zeros(0, np.int64), *rest]), pa.nulls(len(a), pa.int64())
        cols = {"k": (none, pa.array(k[r])), "a": (pa.array(a), pa.array(node[r])), "b": (pa.array(b), pa.nulls(len(r), pa.int64()))}
        cols |= {c: (pa.nulls(len(a), pa.int32()), pa.array(v[r], pa.int32())) for c, v in (("n", n), ("at", at))}
        return pa.table({c: pa.chunked_array(v) for c, v in cols.items()})

    dealt = prefixes.mapInArrow(deal, "bucket int, k bigint, node bigint, n int, at int")
    return dealt.groupBy("bucket").applyInArrow(pairs, "k bigint, a bigint, b bigint, n int, at int")


def _close(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out that their sets reach the limit."""

    def run(batches):
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            ok = [(UP + DOWN) * differing(s, t) <= (DOWN - UP) * (i + j) for i, j, s, t in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first, second = sets.select("node", "n", "sketch").toDF("a", "_n", "_x"), sets.select("node", "n", "sketch").toDF("b", "_m", "_y")
    return pairs.join(first, "a").join(second, "b").select("a", "b", "_n", "_m", "_x", "_y").mapInArrow(lean(run), "a bigint, b bigint")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose two texts reach the limit; only texts of pairs that sketches leave are shuffled."""

    def run(batches):
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(text: bytes) -> np.ndarray:
            s = held.pop(text, None)
            held[text] = shingle_set(text, words) if s is None else s
            if len(held) > SETS:
                held.popitem(last=False)
            return held[text]

        for batch in batches:
            ok = [similar(of(x.as_py() or b""), of(y.as_py() or b"")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = scratch(_close(sets, pairs))
    needed = docs.where(sieve(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node"))
    first, second = (needed.toDF(*names).hint("merge") for names in (("a", "_x"), ("b", "_y")))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "_x", "_y").mapInArrow(lean(run), "a bigint, b bigint")


def crossed(rest: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): pairs of the keys of many texts whose nodes ``comp`` doesn't join; every two blocks are a task's work."""
    comp = comp.select("node", "component")
    rows = scratch(rest.join(comp, "node", "left").select("k", "node", "n", "at", F.coalesce("component", "node").alias("of")))
    apart = rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.min("of").alias("low"), F.max("of").alias("high"))
    rows = rows.join(apart.where("low <> high").select("k", "blocks"), "k").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    dealt = dealt.select("k", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") <= F.col("to")).alias("first"), "node", "n", "at", "of")

    def pairs(t: pa.Table) -> pa.Table:
        node, n, at, of = (t[c].to_numpy().astype(np.int64) for c in ("node", "n", "at", "of"))
        first, same = t["first"].to_numpy(zero_copy_only=False), t["i"][0].as_py() == t["j"][0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        a, b = [], []
        for x, p in enumerate(left):
            q = right[x + 1 :] if same else right
            q = q[(of[q] != of[p]) & _may(n[p], at[p], n[q], at[q])]
            a.append(np.full(len(q), node[p]))
            b.append(node[q])
        a, b = _distinct(a, b)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("k", "i", "j").applyInArrow(pairs, "a bigint, b bigint").distinct()


def links(docs: DataFrame, sets: DataFrame, words: int, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links that connect all nodes of ``sets`` that chains of pairs of the least similarity join. ``docs`` (node,
    text as binary; nodes distinct) has their texts, and may have others."""
    got = scratch(verified(docs, sets, near(sets, linked), words))
    found = scratch(proposed(sets.select("node", "n", "keys")))
    pairs = apart(found.where("b is not null").select("a", "b").distinct(), components(got))
    got = scratch(got.union(verified(docs, sets, pairs, words)))
    rest = found.where("b is null").select("k", F.col("a").alias("node"), "n", "at")
    if rest.isEmpty():
        return got
    return got.union(verified(docs, sets, crossed(rest, components(got)), words))


def redundant(docs: DataFrame, id_col: str, text_col: str, words: int, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id): rows whose id is not the smallest of those that links join them with. Ids are distinct longs. ``linked`` makes
    (a, b), links of near ones, from distinct fingerprints (node)."""
    with _small_batches(docs.sparkSession):
        return scratch(_redundant(docs, id_col, text_col, words, linked))


def _redundant(docs: DataFrame, id_col: str, text_col: str, words: int, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    surveyed = scratch(_surveyed(rows, words))
    common = docs.sparkSession.sparkContext.broadcast(_common(surveyed))
    # Texts of the same words are copies of the one with the smallest id, which alone goes on.
    seen = surveyed.where("cell is null").select("node", "a", "b")
    first = seen.groupBy("a", "b").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    later = scratch(join_back(seen, first, ["a", "b"], "node").where("node <> low").select("node"))
    sets = scratch(_prefixes(without(rows, later, "node"), words, common))
    comp = components(links(rows, sets, words, linked))
    return later.union(comp.where("node <> component").select("node")).withColumnRenamed("node", id_col)
