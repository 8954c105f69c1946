"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is a ring of m segments. If two fingerprints differ in at most t bits, then from some segment on every chain
of l consecutive segments differs in at most l * t / m bits: chains keep a proportional budget.

Narrow fingerprints, 64 bits in five segments, link at four bits. Candidates are those that may agree on a chain of three
segments, which misses none; the whole chain condition prunes them before all bits count.

Wide fingerprints, 512 bits in eight segments, link at 96 bits and meet by windows of 16 bits. They estimate the similarity
of shingles and miss some pairs. The pipeline's stage (``keep_one``) has pairs proposed by narrow fingerprints, counts their
shingles, and finds what fingerprints miss exactly: see jaccard.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import buckets, fresh, join_back, mixed, scratch, without
from foldline.llm.components import components, stars
from foldline.llm.jaccard import redundant, shingle_hashes

WORDS, BITS, SEGMENTS = 4, 4, 5
EDGES = (0, 13, 26, 39, 52, 64)
WIDE_BITS, WIDE_WORDS, WINDOW, STRIDE = 96, 8, 16, 8
#: A key with more fingerprints than this is not linked in one task but in blocks of so many, pair by pair of blocks.
BLOCK = 16_384


def fingerprint(text: bytes, words: int = WORDS, wide: bool = False) -> np.ndarray:
    """Words of 64 bits, one or eight; a bit is set if it is in over half of the shingles' hashes."""
    width = WIDE_WORDS if wide else 1
    total, k = np.zeros(64 * width, np.int64), 0
    for h in shingle_hashes(text, words):
        x = np.stack([h if i == 0 else mixed(h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i in range(width)], axis=1)
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        k += len(h)
    return np.packbits(2 * total > k, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, wide: bool = False) -> DataFrame:
    """(id, fp): one row for each row; a narrow fingerprint is a signed long, a wide one 64 bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = [fingerprint(x.as_py() or b"", words, wide) for x in batch.column(1)]
            col = pa.array([x.tobytes() for x in fp], pa.binary()) if wide else pa.array(np.array(fp, np.uint64).reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), col], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp {'binary' if wide else 'bigint'}")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    i %= SEGMENTS
    return (fp >> np.uint64(EDGES[i])) & np.uint64((1 << (EDGES[i + 1] - EDGES[i])) - 1)


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """Thirty keys for each fingerprint, one row of the result for each key's kind.

    A chain starts with an equal segment. Its second segment differs in one bit at most, so one of its halves is equal;
    its third in two at most, so one of its thirds is. A key is a segment, a half of the next and a third of the one
    after that: pairs that keep the budgets of some chain of three share a key.
    """
    out = []
    for i in range(SEGMENTS):
        one, two, three = (_segment(fp, i + j) for j in range(3))
        for half in (two & np.uint64(63), two >> np.uint64(6)):
            for third in (three & np.uint64(15), (three >> np.uint64(4)) & np.uint64(15), three >> np.uint64(8)):
                out.append(np.uint64(len(out)) << np.uint64(32) | one << np.uint64(12) | half << np.uint64(5) | third)
    return np.stack(out)


def window_keys(fp: np.ndarray) -> np.ndarray:
    """The 16-bit windows of wide fingerprints [row, word], one row of the result for each place in the ring."""
    ring = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8 * WIDE_WORDS).astype(np.uint64)
    n = ring.shape[1]
    return np.stack([np.uint64(i << 32) | ring[:, i] << np.uint64(8) | ring[:, (i + 1) % n] for i in range(0, n, STRIDE // 8)])


def _ring(d: np.ndarray, bits: int) -> np.ndarray:
    """Whether from some segment on all chains keep their budgets, for differences [row, segment]."""
    m = d.shape[1]
    out = np.zeros(len(d), bool)
    for i in range(m):
        total, ok = np.zeros(len(d), np.int64), ~out
        for length in range(1, m + 1):
            total = total + d[:, (i + length - 1) % m]
            ok &= total * m <= length * bits
            if not ok.any():
                break
        out |= ok
    return out


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of words link: the pigeonring test, then the full Hamming test on what is left."""
    x = a ^ b
    wide = x.shape[1] > 1
    d = np.bitwise_count(x) if wide else np.stack([np.bitwise_count(_segment(x[:, 0], i)) for i in range(SEGMENTS)], axis=1)
    bits = WIDE_BITS if wide else BITS
    # The cheapest chains first: some segment must keep the budget of one.
    ok = d.min(axis=1) * d.shape[1] <= bits
    ok[ok] = _ring(d[ok].astype(np.int64), bits)
    ok[ok] = np.bitwise_count(x[ok]).sum(axis=1, dtype=np.int64) <= bits
    return ok


def _near(pool: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(pool ^ x).sum(axis=1, dtype=np.int64) <= (WIDE_BITS if pool.shape[1] > 1 else BITS)


def _forest(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (as row numbers) that connect what is near in ``fp`` [row, word], never all pairs.

    A search from each fingerprint looks only at those not reached yet, so a dense ball around a centre is done in a
    few sweeps. Each one that is reached gives one link.
    """
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(fp[left], fp[x])
            if hit.any():
                y = left[hit]
                yield np.full(len(y), x), y
                queue.extend(y)
                left = left[~hit]


def _forest_between(fp: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for links between two blocks of ``fp``: the search goes to and fro, and reaches each fingerprint once."""
    pools = [np.flatnonzero(first), np.flatnonzero(~first)]
    while len(pools[0]) and len(pools[1]):
        queue, pools[0] = [(1, pools[0][0])], pools[0][1:]
        while queue:
            to, x = queue.pop()
            if not len(pools[to]):
                continue
            hit = _near(fp[pools[to]], fp[x])
            if hit.any():
                y = pools[to][hit]
                yield np.full(len(y), x), y
                queue.extend((1 - to, i) for i in y)
                pools[to] = pools[to][~hit]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _links(key: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
    """Links (as row numbers) of one bucket, and (key, rows) of keys that are too large for one task."""
    order = np.argsort(key, kind="stable")
    starts, sizes = _runs(key[order])
    links, large = [], []
    for n in np.unique(sizes[sizes > 1]):
        s = starts[sizes == n]
        if n <= 48:  # many small keys at once: all pairs of each
            i, j = np.triu_indices(int(n), 1)
            step = max(1, 500_000 // (len(i) * fp.shape[1]))
            for k in range(0, len(s), step):
                a, b = order[(s[k : k + step, None] + i).ravel()], order[(s[k : k + step, None] + j).ravel()]
                ok = within(fp[a], fp[b])
                links.append((a[ok], b[ok]))
        elif n <= BLOCK:
            for k in s:
                rows = order[k : k + n]
                links.extend((rows[x], rows[y]) for x, y in _forest(fp[rows]))
        else:
            large.extend((int(key[order[k]]), order[k : k + n]) for k in s)
    return links, large


def _words(t: pa.Table, name: str = "node") -> np.ndarray:
    """Fingerprints [row, word] of a table; narrow ones are their own nodes."""
    if "fp" not in t.column_names:
        return t[name].to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(t["fp"].to_pylist()), "<u8").reshape(-1, WIDE_WORDS)


def _cat(parts: list, dtype: type = np.int64) -> np.ndarray:
    return np.concatenate([np.asarray(p, dtype) for p in parts] or [np.zeros(0, dtype)])


def linked(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all nodes of ``fps`` that chains of near fingerprints join.

    ``fps`` has a column node: the fingerprint itself, distinct; or any number, beside the wide fingerprint in fp.
    """
    wide = "fp" in fps.columns
    n = buckets(fps, 0.25)
    fp_col = ", fp binary" if wide else ""

    def keys(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            k = (window_keys(_words(t)) if wide else chain_keys(_words(t)[:, 0])).ravel()
            times = len(k) // max(len(t), 1)
            bucket = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)
            for i in range(times):  # a batch for each kind of key, so that none is many times as large as what came in
                part = slice(i * len(t), (i + 1) * len(t))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part].astype(np.int32)), pa.array(k[part].view(np.int64)), *batch.columns], names=["bucket", "k", *batch.schema.names])

    def local(t: pa.Table) -> pa.Table:
        fp, node, key = _words(t), t["node"].to_numpy(), t["k"].to_numpy()
        links, large = _links(key.view(np.uint64), fp)
        a, b = stars(node[_cat([x for x, _ in links])], node[_cat([y for _, y in links])])
        out = {
            "a": _cat([a] + [node[r] for _, r in large]),
            "b": _cat([b] + [np.full(len(r), np.uint64(k)).view(np.int64) for k, r in large]),
            "block": _cat([np.full(len(a), -1)] + [np.arange(len(r)) // BLOCK for _, r in large]),
        }
        if wide:
            none = pa.nulls(len(a), pa.binary())
            out["fp"] = pa.chunked_array([none, *(t["fp"].combine_chunks().take(pa.array(r)) for _, r in large)], pa.binary())
        return pa.table(out)

    found = scratch(fps.select("node", *["fp"] * wide).mapInArrow(keys, f"bucket int, k bigint, node bigint{fp_col}").groupBy("bucket").applyInArrow(local, f"a bigint, b bigint, block bigint{fp_col}"))
    links = found.where("block < 0").select("a", "b")
    large = found.where("block >= 0")
    if large.isEmpty():
        return links
    # Every pair of blocks of a large key is a task of its own.
    blocks = large.groupBy("b").agg((F.max("block") + 1).alias("blocks"))
    dealt = large.join(blocks, "b").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"))
    dealt = dealt.select("b", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), (F.col("block") <= F.col("to")).alias("first"), F.col("a").alias("node"), *["fp"] * wide)

    def pair(t: pa.Table) -> pa.Table:
        fp, node = _words(t), t["node"].to_numpy()
        got = list(_forest(fp) if t["i"][0].as_py() == t["j"][0].as_py() else _forest_between(fp, t["first"].to_numpy(zero_copy_only=False)))
        a, b = stars(node[_cat([x for x, _ in got])], node[_cat([y for _, y in got])])
        return pa.table({"a": a, "b": b})

    return links.union(dealt.groupBy("b", "i", "j").applyInArrow(pair, "a bigint, b bigint"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, component_id): one row for each row; the component is the smallest id that chains of links reach.

    A text without words has fingerprint zero and is linked like any other; rows with equal fingerprints are linked. A
    null id never is the smallest, unless all of its group are null. Texts are read once and only fingerprints are
    shuffled; exact copies of a fingerprint meet in a map-side aggregation, so copies cost no pairs.
    """
    rows = scratch(fingerprints(docs, id_col, text_col, words))
    fps = scratch(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")))
    comp = components(linked(fps.select(F.col("fp").alias("node"))))
    of = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    of = scratch(of)
    lowest = of.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_back(of.withColumnRenamed("n", "rows"), lowest, ["component"], "fp").select("fp", F.col("rows").alias("n"), "component_id")
    return join_back(rows, of, ["fp"], id_col).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The rows, all columns unchanged, without those that are near-duplicates of a row that comes before: smallest id first.

    Near are texts whose sets of shingles have a similarity of 0.8 or more, counted and not estimated, and what chains of
    such pairs join; exactly one row of each such group stays. Where ids repeat or are null, rows are ordered by id, null
    last, and text.
    """
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    if ids.where((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).isEmpty():
        return without(docs, redundant(docs, id_col, text_col, words, linked), id_col)
    (row,) = fresh(docs, "_row")
    rows = scratch(docs.orderBy(F.col(id_col).asc_nulls_last(), text_col).withColumn(row, F.monotonically_increasing_id()))
    return without(rows, redundant(rows, row, text_col, words, linked), row).select(docs.columns)


def simhash_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return near_groups(docs, id_col, text_col).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
