"""Substring dedup on words by difference-cover anchors.

Windows are hashed only where their position modulo a period is in a difference cover. Whatever the alignment of two
equal windows, some anchor in them stands at cover positions of both, so a window that is repeated holds an anchor that
is. Where an anchor is repeated, the windows around it are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import anywhere, buckets, copies, dealt, keyed, mixed, read_dealt, unkeyed

#: Words in a window; the period and its cover: every residue is a difference of two of its members.
WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
#: Hashes that a task gathers before it sends them on, and words whose hashes it remembers.
GATHERED, REMEMBERED = 1_000_000, 200_000

_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word, 11)
        return h


_word_hash = _WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as rows."""
    return np.frombuffer(b"".join(map(_word_hash.__getitem__, words)), np.uint64).reshape(-1, 2).T


def sequence_hashes(h: np.ndarray, starts: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n items from each start; each place has a multiplier of its own."""
    out = np.full(len(starts), seed, np.uint64)
    for k in range(n):
        out += h[starts + k] * _ODD[(k + seed) % 64]
    return mixed(out)


def anchors(h: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions and the hashes there of what is left of a window after the period."""
    n = window - period + 1
    at = np.arange(max(len(h) - n + 1, 0))
    at = at[np.isin(at % period, cover)]
    return at, sequence_hashes(h, at, n)


def _anchor_rows(parts: int, window: int, period: int, cover: tuple[int, ...]):
    """Texts to anchors: c0, c1 hashes that are single so far and their units, c2 hashes seen twice; o0, o1 the units and hashes of those."""

    def send(hs: list, us: list) -> Iterator[pa.RecordBatch]:
        h, u = np.concatenate(hs), np.concatenate(us)
        order = np.argsort(h)
        h, u = h[order], u[order]
        fresh = np.r_[True, h[1:] != h[:-1]]
        many = np.diff(np.r_[np.flatnonzero(fresh), len(h)])[np.cumsum(fresh) - 1] > 1
        single, twice = ~many, fresh & many
        # Singles by unit, so that units compress; those seen twice need no answer from elsewhere, but others need to know.
        h1, u1 = h[single], u[single]
        by_unit = np.argsort(u1, kind="stable")
        h1, u1, h2 = h1[by_unit], u1[by_unit], h[twice]
        bucket = np.concatenate([h1, h2]) >> np.uint64(20)
        bucket = (bucket % np.uint64(parts)).astype(np.int64)
        flag = np.r_[np.zeros(len(h1), np.int8), np.ones(len(h2), np.int8)]
        yield dealt(bucket, [np.concatenate([h1, h2]), np.r_[u1, np.zeros(len(h2), np.int64)], flag], anywhere(parts, u[many], h[many]), [u[many], h[many]])

    def run(batches):
        hs, us, n = [], [], 0
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                _, a = anchors(word_hashes(words)[0], window, period, cover)
                hs.append(a), us.append(np.full(len(a), uid, np.int64))  # noqa: B018
                n += len(a)
                if n >= GATHERED:
                    yield from send(hs, us)
                    hs, us, n = [], [], 0
        if n:
            yield from send(hs, us)

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """(uid, h): the anchors of each unit that stand elsewhere too."""
    h, u, flag = read_dealt(t, "c0", np.uint64), read_dealt(t, "c1", np.int64), read_dealt(t, "c2", np.int8)
    order = np.argsort(h)
    h, u, flag = h[order], u[order], flag[order]
    fresh = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    n = np.bincount(group, 1 + flag) if len(h) else np.zeros(0)
    told = (n[group] > 1) & (flag == 0) if len(h) else np.zeros(0, bool)
    out_u, out_h = np.r_[u[told], read_dealt(t, "o0", np.int64)], np.concatenate([h[told], read_dealt(t, "o1", np.uint64)])
    return pa.table({"uid": out_u, "h": out_h.view(np.int64)})


def _window_rows(parts: int, window: int, period: int, cover: tuple[int, ...]):
    """Texts with their repeated anchors to windows: c0, c1 hashes, c2, c3 the earliest place so far; o0, o1 places that are not."""

    def send(w: list, v: list, us: list, ss: list) -> Iterator[pa.RecordBatch]:
        a, b, u, s = (np.concatenate(x) for x in (w, v, us, ss))
        order = np.lexsort((s, u, b, a))
        a, b, u, s = a[order], b[order], u[order], s[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        late_u, late_s = u[~first], s[~first]
        a, b, u, s = a[first], b[first], u[first], s[first]
        by_place = np.lexsort((s, u))
        a, b, u, s = a[by_place], b[by_place], u[by_place], s[by_place]
        yield dealt(((a >> np.uint64(20)) % np.uint64(parts)).astype(np.int64), [a, b, u, s], anywhere(parts, late_u, late_s), [late_u, late_s])

    def run(batches):
        held, n = ([], [], [], []), 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                h = word_hashes(text.as_py().split())
                at, a = anchors(h[0], window, period, cover)
                at = at[np.isin(a, np.asarray(batch.column(2)[i].values, np.int64).view(np.uint64))]
                edge = np.zeros(h.shape[1] + 1, np.int64)
                np.add.at(edge, np.maximum(at - period + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: max(h.shape[1] - window + 1, 0)] > 0)
                held[0].append(sequence_hashes(h[0], starts, window))
                held[1].append(sequence_hashes(h[1], starts, window, 31))
                held[2].append(np.full(len(starts), batch.column(0)[i].as_py(), np.int64))
                held[3].append(starts.astype(np.int32))
                n += len(starts)
                if n >= GATHERED:
                    yield from send(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield from send(*held)

    return run


def _later(t: pa.Table) -> pa.Table:
    """(uid, start): windows whose words start earlier too."""
    a, b, u, s = read_dealt(t, "c0", np.uint64), read_dealt(t, "c1", np.uint64), read_dealt(t, "c2", np.int64), read_dealt(t, "c3", np.int32)
    order = np.lexsort((s, u, b, a))
    a, b, u, s = a[order], b[order], u[order], s[order]
    late = ~np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return pa.table({"uid": np.r_[u[late], read_dealt(t, "o0", np.int64)], "start": np.r_[s[late], read_dealt(t, "o1", np.int32)]})


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n places a window from one of the starts covers."""
    edge = np.zeros(n + window + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _with_removed(docs: DataFrame, id_col: str, text_col: str, window: int, period: int, cover: tuple[int, ...]) -> tuple[DataFrame | None, DataFrame]:
    """rows, and (uid, text, copy, starts) for every unit: its text's bytes, and the starts of its windows that are to go."""
    if not all(any((d + r) % period in cover for d in cover) for r in range(period)) or period > window:
        raise ValueError("cover is no difference cover of the period, or the period exceeds the window")
    parts = buckets(docs, 4)
    rows, units = keyed(docs, id_col, text_col)
    texts = units.select("uid", F.col("text").cast("binary").alias("text"))
    blobs = lambda n, m: ", ".join(["bucket int", *(f"c{i} binary" for i in range(n)), *(f"o{i} binary" for i in range(m))])
    found = texts.mapInArrow(_anchor_rows(parts, window, period, cover), blobs(3, 2)).groupBy("bucket").applyInArrow(_repeated, "uid long, h long")
    told = found.groupBy("uid").agg(F.collect_set("h").alias("hs"))
    kept_copies = copies(units)
    # Texts are dealt by unit once: both joins below read the same exchange.
    spread = texts.repartition(parts, "uid")
    # Later copies need no windows: all of theirs start earlier in the first.
    firsts = told.join(kept_copies.where("first"), "uid", "left_semi")
    # Sorted, so that a task that runs again after a loss sends on exactly what it sent before.
    whole = spread.join(firsts.hint("shuffle_hash"), "uid").select("uid", "text", "hs").sortWithinPartitions("uid")
    windows = whole.mapInArrow(_window_rows(parts, window, period, cover), blobs(4, 2)).groupBy("bucket").applyInArrow(_later, "uid long, start int")
    gone = windows.groupBy("uid").agg(F.collect_set("start").alias("starts"))
    facts = kept_copies.select("uid", (~F.col("first")).alias("copy")).join(gone, "uid", "left")
    return rows, spread.join(facts.hint("shuffle_hash"), "uid").select("uid", "text", "copy", "starts")


def _gone(words: list[bytes], copy: bool, starts: pa.Scalar, window: int) -> np.ndarray:
    if copy and len(words) >= window:
        return np.ones(len(words), bool)
    if not starts.is_valid or copy:
        return np.zeros(len(words), bool)
    return covered(len(words), np.asarray(starts.values, np.int64), window)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(id, n_words, n_removed, kept): every row's text without the words that a repeated window covers.

    Words are runs of anything but space and the five other ASCII white-space characters. A window of ``window`` words goes if its words also start earlier: in a
    smaller id, or earlier in the same text; windows are judged on the input. Kept words are joined by one space. A null
    text has no words. Repeated rows count as one document and get the same result; rows with equal ids and other texts
    come in the order of their texts' digests; null ids come first.

    Exact copies of a text are told by its hash: only the first of them is compared, later ones lose all that a window
    covers. What a task has seen twice itself it sends on once, so a common passage costs a row for each task and not
    for each document. Hashes go to buckets whose number follows the input; windows are compared by 128 bits.
    """
    rows, marked = _with_removed(docs, id_col, text_col, window, period, cover)

    def run(batches):
        for batch in batches:
            n, k, kept = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().split()
                gone = _gone(words, batch.column(2)[i].as_py(), batch.column(3)[i], window)
                n.append(len(words)), k.append(int(gone.sum()))  # noqa: B018
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.string())], names=["uid", "n_words", "n_removed", "kept"])

    return unkeyed(rows, marked.mapInArrow(run, "uid long, n_words long, n_removed long, kept string"), id_col)


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    out = deduplicate(docs, id_col, text_col, window)
    return out.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, for distinct ids.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS s, ws FROM d WHERE len(ws) >= 20),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 20], ' ')) AS h FROM p),
f AS (SELECT h, min((doc_id, s)) AS low FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.s FROM w JOIN f USING (h) WHERE (w.doc_id, w.s) <> f.low),
c AS (SELECT DISTINCT doc_id, s + k AS i FROM g, range(20) r(k)),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
k AS (SELECT e.doc_id, count(*) AS n, count(c.i) AS gone, string_agg(e.word, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
