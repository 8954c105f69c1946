"""Suffix-array dedup on bytes with run-length indexes.

The Burrows-Wheeler transform of a bucket of text is kept by its runs: a byte, a length, and the text positions of the
first and the last suffix of each. Matching statistics, how far each suffix agrees with its neighbours in order, are found
at the ends of runs only and streamed from there to the left, where they grow by one a byte for as long as suffixes stay in
their runs. With them long matches are marked.

So that equal stretches meet in one bucket wherever they are, windows are routed by their minimizer: the least hash among
the short strings in a window depends on the window's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import anywhere, buckets, copies, dealt, keyed, mixed, read_dealt, scratch, unkeyed
from foldline.llm.substring import GATHERED

#: Bytes in a window, and in the strings whose least hash routes it.
WINDOW, GRAM = 400, 64
#: Neighbourhoods of one minimizer that go to one index; with more, its windows are hashed and compared one by one.
INDEXED = 2_048
#: Windows of a text that are looked at together, so that very long texts take bounded memory.
STRETCH = 1 << 18

_BYTE = np.random.default_rng(4).integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bases modulo a Mersenne prime. Texts can be made that all bases modulo 2**64 confuse, but not these.
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 392_406_881)
_SMALL = (_BYTE >> np.uint64(33)) | np.uint64(1)


@lru_cache(4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _INVERSE if inverse else _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(8)
def _prime_powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:  # twice as many at a time
        out = np.r_[out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)]
    return out[:n]


def _room(n: int) -> int:
    return 1 << max(n + 1, 1 << 17).bit_length()


class Rolling:
    """Hashes of any stretches of a text, by prefix sums modulo 2**64."""

    def __init__(self, text: np.ndarray) -> None:
        n = _room(len(text))
        self.inverse = _powers(n, True)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[0][text] * _powers(n, False)[: len(text)], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


class Checked:
    """Hashes of any stretches of a text of STRETCH bytes or so, of 62 bits, by prefix sums modulo a prime in two bases."""

    def __init__(self, text: np.ndarray) -> None:
        n, p = _room(len(text)), np.uint64(_PRIME)
        self.sums, self.inverse = [], []
        for b, base in enumerate(_BASES):
            x = _SMALL[b][text] * _prime_powers(n, base)[: len(text)]
            x = (x & p) + (x >> np.uint64(31))  # below 2**32, so that sums of millions do not overflow
            self.sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(x)])
            self.inverse.append(_prime_powers(n, pow(base, -1, _PRIME)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = np.uint64(_PRIME)
        a, b = ((s[end] - s[start]) % p * i[start] % p for s, i in zip(self.sums, self.inverse, strict=True))
        return a << np.uint64(31) | b


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive items."""
    k = len(x) - n + 1
    full = np.full(-(-len(x) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, n)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:k], ahead[n - 1 : n - 1 + k])


def minimizers(text: bytes, window: int, gram: int) -> Iterator[np.ndarray]:
    """Columns (gram hash, two neighbourhood hashes, gram position, first window, last window) of a text's minimizers.

    Each window start belongs to one: the leftmost string of least hash in the window. A neighbourhood is all bytes of
    the windows that belong to it, with the string's place among them.
    """
    whole = np.frombuffer(text, np.uint8)
    for base in range(0, len(whole) - window + 1, STRETCH):
        b = whole[base : base + STRETCH + window - 1]
        roll, check = Rolling(b), Checked(b)
        n = len(b) - gram + 1
        grams = roll(slice(0, n), slice(gram, gram + n))
        # The high bits decide, then the place: among equals the leftmost.
        low = np.uint64((1 << 23) - 1)
        least = sliding_least((grams & ~low) | np.arange(n, dtype=np.uint64), window - gram + 1)
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        p = at[first]
        around = roll(first, last + window) ^ mixed((p - first).astype(np.uint64) * np.uint64(_BASE) + (last - first).astype(np.uint64))
        yield grams[p], around, check(first, last + window), p + base, first + base, last + base


def _class_rows(parts: int, window: int, gram: int):
    """Texts to minimizers, a row for each bucket: c0 gram hash, c1, c2 neighbourhood hashes, c3 unit, c4, c5 first and last window, c6 seen twice."""

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in held]
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        g, a, b, u, lo, hi = cols
        fresh = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        many = np.diff(np.r_[np.flatnonzero(fresh), len(g)])[np.cumsum(fresh) - 1] > 1
        # Of equal neighbourhoods one goes on and says that there are more; the others are known to be repeated.
        go = np.flatnonzero(fresh)
        go = go[np.lexsort((lo[go], u[go]))]
        rest = [c[~fresh] for c in (u, lo, hi)]
        yield dealt(((g[go] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), [c[go] for c in (*cols, many.astype(np.int8))], anywhere(parts, *rest), rest)

    def run(batches):
        held, n = [[] for _ in range(6)], 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for g, a, b, _, lo, hi in minimizers(text.as_py(), window, gram):
                    for h, x in zip(held, (g, a, b, np.full(len(g), uid, np.int64), lo, hi), strict=True):
                        h.append(x)
                    n += len(g)
                    if n >= GATHERED:
                        yield from send(held)
                        held, n = [[] for _ in range(6)], 0
        if n:
            yield from send(held)

    return run


_CLASS = "bucket int, " + ", ".join([f"c{i} binary" for i in range(7)] + [f"o{i} binary" for i in range(3)])
#: What a neighbourhood needs: nothing more (all its windows are repeated), an index, or window hashes.
FULL, INDEX, HASH = 0, 1, 2


def _classes(t: pa.Table) -> pa.Table:
    """(uid, gram, first, last, need) from the minimizers of a bucket."""
    kinds_of = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int8)
    g, a, b, u, lo, hi, many = (read_dealt(t, f"c{i}", d) for i, d in enumerate(kinds_of))
    order = np.lexsort((lo, u, b, a, g))
    g, a, b, u, lo, hi, many = (x[order] for x in (g, a, b, u, lo, hi, many))
    new_g = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    new_a = new_g | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(g) else new_g
    of_g, of_a = np.cumsum(new_g) - 1, np.cumsum(new_a) - 1
    copies_ = np.bincount(of_a, 1 + many)[of_a] if len(g) else np.zeros(0)
    kinds = np.bincount(of_g, new_a).astype(np.int64)[of_g] if len(g) else np.zeros(0, np.int64)
    full = copies_ > 1
    # Where a minimizer has several neighbourhoods, one of each is compared; it may match others in part.
    compare = (kinds > 1) & new_a
    need = np.where(kinds > INDEXED, HASH, INDEX)
    u1, lo1, hi1 = (read_dealt(t, f"o{i}", np.int64) for i in range(3))
    return pa.table(
        {
            "uid": np.r_[u[full], u1, u[compare]],
            "gram": np.r_[np.zeros(int(full.sum()) + len(u1), np.int64), g[compare].view(np.int64)],
            "first": np.r_[lo[full], lo1, lo[compare]],
            "last": np.r_[hi[full], hi1, hi[compare]],
            "need": np.r_[np.full(int(full.sum()) + len(u1), FULL), need[compare]].astype(np.int32),
        }
    )


_BINARY = [*(f"c{i}" for i in range(5)), "o0", "o1", "bytes"]
_AROUND_NAMES = ["bucket", *_BINARY, "uid", "first"]
_AROUND = "bucket int, " + ", ".join(f"{c} binary" for c in _BINARY) + ", uid long, first long"


def _around_rows(parts: int, window: int):
    """Texts with what their minimizers need to rows (bucket, bytes, uid, first) or window hashes (c0, c1, units, firsts, seen twice), and windows that are known."""

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b, u, s = (np.concatenate(x) for x in held)
        order = np.lexsort((s, u, b, a))
        a, b, u, s = a[order], b[order], u[order], s[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        many = np.diff(np.r_[np.flatnonzero(fresh), len(a)])[np.cumsum(fresh) - 1] > 1
        rest = [u[~fresh], s[~fresh]]
        bucket = ((a[fresh] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        out = dealt(bucket, [x[fresh] for x in (a, b, u, s, many.astype(np.int8))], anywhere(parts, *rest), rest)
        none = [pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())]
        yield pa.RecordBatch.from_arrays([*out.columns, *none], names=_AROUND_NAMES)

    def index_rows(rows: list[tuple]) -> pa.RecordBatch:
        bucket, uid, first, text = zip(*rows, strict=True)
        none = [pa.nulls(len(rows), pa.binary()) for _ in _BINARY[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *none, pa.array(text, pa.binary()), pa.array(uid, pa.int64()), pa.array(first, pa.int64())], names=_AROUND_NAMES)

    def run(batches):
        held, n = [[] for _ in range(4)], 0
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                text, uid = value.as_py(), batch.column(0)[i].as_py()
                for need in batch.column(2)[i].as_py():
                    around = text[need["first"] : need["last"] + window]
                    if need["need"] == INDEX:
                        rows.append(((need["gram"] % (1 << 64) >> 20) % parts, uid, need["first"], around))
                        if len(rows) >= 8192:
                            yield index_rows(rows)
                            rows = []
                        continue
                    x, s = np.frombuffer(around, np.uint8), np.arange(need["last"] - need["first"] + 1)
                    cols = Rolling(x)(s, s + window), Checked(x)(s, s + window), np.full(len(s), uid, np.int64), s + need["first"]
                    for h, c in zip(held, cols, strict=True):
                        h.append(c)
                    n += len(s)
                    if n >= GATHERED:
                        yield from send(held)
                        held, n = [[] for _ in range(4)], 0
            if rows:
                yield index_rows(rows)
        if n:
            yield from send(held)

    return run


#: What stands between texts of an index; no match goes across it.
GAP = 256


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of bytes and gaps, with a text position at both ends of each run.

    What is kept has the size of the runs and not of the text: in repetitive text, most suffixes stand beside another that
    the same byte precedes. The suffix order is only there while the index is built.
    """

    def __init__(self, text: np.ndarray, most: int) -> None:
        """``text``: 16-bit symbols, a gap last; agreement is looked at as far as ``most``, beyond it counts as more."""
        n = len(text)
        order = _suffix_order(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing stands before the text
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]) if n else np.zeros(0, np.int64)
        self.size = n
        self.symbol = before[head]
        self.length = np.diff(np.r_[head, n])
        self.first, self.last = order[head], order[np.r_[head[1:], n] - 1]
        # One step to the left of a run's end stands a suffix whose neighbour follows from the runs alone: from the end
        # of the run before, or the head of the run after, that has the same symbol.
        by = np.lexsort((head, self.symbol))
        a, b = by[:-1], by[1:]
        same = (self.symbol[a] == self.symbol[b]) & (self.symbol[a] >= 0)
        agree = np.zeros(len(a), np.int64)
        inner = same & (self.symbol[a] != GAP)
        agree[inner] = 1 + _agree(text, self.last[a[inner]], self.first[b[inner]], most)
        self.up, self.down = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        self.up[b], self.down[a] = agree, agree
        self.gaps = np.flatnonzero(text == GAP)

    def _streamed(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each text position what is known at the next sample from it on, and one more for each byte between."""
        at, known = np.r_[at, self.gaps], np.r_[known, np.zeros(len(self.gaps), np.int64)]
        i = np.arange(self.size)
        out = np.full(self.size, self.size)
        out[at] = np.arange(len(at))
        nearest = np.minimum.accumulate(np.where(out < self.size, i, self.size)[::-1])[::-1]
        return known[out[nearest]] + nearest - i

    def statistics(self) -> np.ndarray:
        """For each text position, how far its suffix agrees with that of any other."""
        up, down = self.first > 0, self.last > 0
        return np.maximum(self._streamed(self.first[up] - 1, self.up[up]), self._streamed(self.last[down] - 1, self.down[down]))


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a suffix that ends sorts before one that goes on."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = (text.astype(np.uint64) + np.uint64(2)) % np.uint64(GAP + 2) + np.uint64(1)  # a gap is the least symbol
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank, depth = _ranks(order, key[order]), 7
    while True:
        # Only ranks that several suffixes share are sorted on, each within its own place.
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        open_ = np.r_[same, False] | np.r_[False, same]
        if not open_.any():
            return order
        slots = np.flatnonzero(open_)
        who = order[slots]
        after = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[who]))
        who, after = who[by], after[by]
        order[slots] = who
        major = rank[who]
        new = np.r_[True, (major[1:] != major[:-1]) | (after[1:] != after[:-1])]
        rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        depth *= 2


def _ranks(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A rank is the first slot of the suffixes that are equal so far."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes agree from a and from b on, up to a gap, looking at ``most`` or a few more."""
    n, out, step = len(text), np.zeros(len(a), np.int64), 16
    for at in range(0, len(a), 1 << 16):
        left = at + np.flatnonzero((a[at : at + (1 << 16)] < n) & (b[at : at + (1 << 16)] < n))
        while len(left):
            k = out[left][:, None] + np.arange(step)
            x, y = a[left][:, None] + k, b[left][:, None] + k
            same = (x < n) & (y < n)
            from_a = text[np.minimum(x, n - 1)]
            same &= (from_a == text[np.minimum(y, n - 1)]) & (from_a != GAP)
            run = np.where(same.all(1), step, np.argmin(same, axis=1))
            out[left] += run
            left = left[(run == step) & (out[left] < most)]
    return out


def _joined(uid: np.ndarray, first: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbourhoods as one text with gaps, those that overlap in their document made one: symbols, and the place in it, the unit and the first byte of each stretch."""
    parts, place, units, firsts, n, end = [], [], [], [], 0, 0
    gap = np.full(1, GAP, np.uint16)
    for k in np.lexsort((first, uid)).tolist():
        x, lo = np.frombuffer(text[k], np.uint8), int(first[k])
        stop = lo + len(x)
        if units and units[-1] == uid[k] and lo <= end:
            x, stop = x[end - lo :], max(stop, end)
        else:
            if parts:
                parts.append(gap)
                n += 1
            place.append(n), units.append(int(uid[k])), firsts.append(lo)  # noqa: B018
        parts.append(x.astype(np.uint16))
        n, end = n + len(x), stop
    return np.concatenate([*parts, gap]), np.array(place), np.array(units), np.array(firsts)


def _repeated_windows(window: int):
    """(uid, first, last): runs of repeated windows of a bucket."""

    def run(t: pa.Table) -> pa.Table:
        out_u, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hashed = t.filter(pc.is_valid(t["c0"]))
        if hashed.num_rows:
            a, b, u, s, many = (read_dealt(hashed, f"c{i}", d) for i, d in enumerate((np.uint64, np.uint64, np.int64, np.int64, np.int8)))
            order = np.lexsort((b, a))
            fresh = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
            group = np.cumsum(fresh) - 1
            hit = np.bincount(group, 1 + many[order])[group] > 1 if len(a) else fresh
            out_u += [u[order][hit], read_dealt(hashed, "o0", np.int64)]
            out_s += [s[order][hit], read_dealt(hashed, "o1", np.int64)]
        indexed = t.filter(pc.is_valid(t["bytes"]))
        if indexed.num_rows:
            text, place, uid, first = _joined(indexed["uid"].to_numpy(), indexed["first"].to_numpy(), indexed["bytes"].to_pylist())
            at = np.flatnonzero(RunIndex(text, window).statistics() >= window)
            of = np.searchsorted(place, at, side="right") - 1
            out_u.append(uid[of])
            out_s.append(first[of] + at - place[of])
        u, s = np.concatenate(out_u), np.concatenate(out_s)
        order = np.lexsort((s, u))
        u, s = u[order], s[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (s[1:] > s[:-1] + 1)] if len(u) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        return pa.table({"uid": u[begin], "first": s[begin], "last": s[np.r_[begin[1:], len(s)] - 1] if len(s) else s})

    return run


def _with_removed(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame | None, DataFrame]:
    """rows, and (uid, text, many, runs) for every unit: its bytes, whether another has the same, and runs of repeated windows."""
    parts = buckets(docs, 2)
    rows, units = keyed(docs, id_col, text_col)
    texts = units.select("uid", F.col("text").cast("binary").alias("text"))
    classes = texts.mapInArrow(_class_rows(parts, window, gram), _CLASS).groupBy("bucket").applyInArrow(_classes, "uid long, gram long, first long, last long, need int")
    classes = scratch(classes)
    same = copies(units).select("uid", "many")
    if rows is not None:  # rows that are equal in id and text are copies of each other
        again = rows.groupBy("uid").agg((F.count(F.lit(1)) > 1).alias("again"))
        same = same.join(again, "uid").select("uid", (F.col("many") | F.col("again")).alias("many"))
    spread = texts.repartition(parts, "uid")
    needs = classes.where(F.col("need") != FULL).groupBy("uid").agg(F.collect_list(F.struct("gram", "first", "last", "need")).alias("needs"))
    # Sorted, so that a task that runs again after a loss sends on exactly what it sent before.
    whole = spread.join(needs.hint("shuffle_hash"), "uid").select("uid", "text", F.array_sort("needs").alias("needs")).sortWithinPartitions("uid")
    around = whole.mapInArrow(_around_rows(parts, window), _AROUND)
    part = around.groupBy("bucket").applyInArrow(_repeated_windows(window), "uid long, first long, last long")
    runs = part.union(classes.where(F.col("need") == FULL).select("uid", "first", "last"))
    runs = runs.groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    facts = same.join(runs, "uid", "left")
    return rows, spread.join(facts.hint("shuffle_hash"), "uid").select("uid", "text", "many", "runs")


def _gone(text: bytes, many: bool, runs: pa.Scalar, window: int) -> np.ndarray:
    if many and len(text) >= window:
        return np.ones(len(text), bool)
    edge = np.zeros(len(text) + 1, np.int64)
    if runs.is_valid:
        r = runs.values
        np.add.at(edge, np.asarray(r.field("first"), np.int64), 1)
        np.add.at(edge, np.asarray(r.field("last"), np.int64) + window, -1)
    return np.cumsum(edge)[: len(text)] > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every row's text without the bytes that a repeated string covers.

    Texts are UTF-8 bytes, matches stay within a text, and a byte goes if a string of ``window`` bytes that covers it
    starts anywhere else too, in the same text or another; strings are judged on the input. What is kept is binary, for
    a cut may part a character. A null text is empty. Every row is a document: repeated rows,
    and rows that share only the id or have none, are copies of each other as far as their texts agree.

    Neighbourhoods of a minimizer that are equal throughout are settled by 126 bits of hashes, 62 of them modulo a prime;
    the others, at the edges of matches, are sent to the minimizer's bucket and indexed there. A minimizer that stands in
    more than INDEXED different neighbourhoods has its windows compared by such hashes instead, so that they spread.
    Texts of any length are looked at in stretches of STRETCH bytes.
    """
    rows, marked = _with_removed(docs, id_col, text_col, window, gram)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                gone = _gone(text, batch.column(2)[i].as_py(), batch.column(3)[i], window)
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text))
            n, k, s, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, k, s)), pa.array(kept, pa.binary())], names=["uid", "n_bytes", "n_removed", "n_spans", "kept"])

    return unkeyed(rows, marked.mapInArrow(run, "uid long, n_bytes long, n_removed long, n_spans long, kept binary"), id_col)


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    out = deduplicate(docs, id_col, text_col, window)
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, for distinct ids.
SUFFIX_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, unnest(range(octet_length(b) - {WINDOW - 1})) AS s, b FROM d WHERE octet_length(b) >= {WINDOW}),
w AS (SELECT doc_id, s, md5(b[s + 1 : s + {WINDOW}]) AS h FROM p),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM w SEMI JOIN m USING (h)),
i AS (SELECT doc_id, s, sum(CASE WHEN s <= before + {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM g),
r AS (SELECT doc_id, span, min(s) AS lo, max(s) + {WINDOW} AS hi FROM i GROUP BY doc_id, span),
k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS since FROM r),
a AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(hex(b[since + 1 : lo]), '' ORDER BY lo) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN a.doc_id IS NULL THEN d.b ELSE unhex(kept || hex(d.b[last + 1 : octet_length(d.b)])) END) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
