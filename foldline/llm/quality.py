"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over one feature at a time, then over pairs of features; since a tree over one or two
binned features is a table, the sum of all trees is one lookup table for each feature and one for each pair. A score is
the sum of the table entries of a row's bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import lean

#: At most so many labelled rows are fitted on, those of least hash; a documented bound, not a share of the input.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SMOOTH = 32, 12, 8, 150, 60, 0.1, 4, 20.0
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_length", "distinct_share", "repeat_share", "upper_share", "digit_share", "punct_share", "bang_share", "bar_share",
    "symbol_share", "space_share", "high_byte_share", "log_lines", "words_a_line", "same_line_share", "top_word_share", "stops_a_word", "markup_share", "longest_word", "at_share",
)

_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_PUNCT, _SYMBOL, _MARKUP = b".,;:!?'\"()-", b"#$%&*^~@=+_\\", b"<>{}[]/"
_HIGH = bytes(range(128, 256))


def features(text: bytes) -> list[float]:
    """What a whole text looks like, as numbers. Nothing here knows its language, source or id."""
    n = max(len(text), 1)
    words = text.split()
    k = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    # Capitals with accents are two bytes, of which the second is 0x80 to 0x9E after 0xC3.
    upper = len(text) - len(text.translate(None, _UPPER)) + sum(text.count(b"\xc3" + bytes([x])) for x in (0x80, 0x84, 0x89, 0x8A, 0x8D, 0x91, 0x96, 0x9C, 0x88, 0x87))
    return [
        np.log1p(len(words)), (n - k) / k, len(counts) / k, sum(map(eq, words, words[1:])) / k, upper / n, share(_DIGIT), share(_PUNCT), text.count(b"!") / n, text.count(b"|") / n,
        share(_SYMBOL), share(b" \t\r\n"), share(_HIGH), np.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), max(counts.values(), default=0) / k,
        text.count(b".") / k, share(_MARKUP), float(max(map(len, counts), default=0)), text.count(b"@") / k,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, most: int) -> np.ndarray:
    """A tree over ordered bins with at most ``most`` leaves, as the value of each bin."""
    parts = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + SMOOTH)
    while len(parts) < most:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                x = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                i = int(np.argmax(x))
                best = max(best, (float(x[i]), (a, b), int(cuts[i])), key=lambda t: t[0])
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross cut of a table into four leaves: its gain, and the value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    r, s = cg[:-1, -1:], ch[:-1, -1:]
    c, d = cg[-1:, :-1], ch[-1:, :-1]
    tg, th = cg[-1, -1], ch[-1, -1]
    quads = ((a, b), (r - a, s - b), (c - a, d - b), (tg - r - c + a, th - s - d + b))
    score = sum(x**2 / (y + SMOOTH) for x, y in quads)
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    v = [float(x[i, j] / (y[i, j] + SMOOTH)) for x, y in quads]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(score[i, j] - tg**2 / (th + SMOOTH)), out


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the logistic loss. Without rows, or with one label only, the model is its smoothed prior."""
    m = Model(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if len(y) == 0 or y.min() == y.max():
        return m
    k = x.shape[1]
    cut = lambda v, n: np.unique(np.quantile(v, np.arange(1, n) / n))
    m.edges, m.coarse = [cut(x[:, j], BINS) for j in range(k)], [cut(x[:, j], PAIR_BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    z = np.full(len(y), m.base)
    prob = lambda: 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for j in range(k):
            p = prob()
            t = RATE * _leaves(np.bincount(bins[j], y - p, len(m.tables[j])), np.bincount(bins[j], p * (1 - p), len(m.tables[j])), LEAVES)
            m.tables[j] += t
            z += t[bins[j]]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(m.coarse[a]) + 1, len(m.coarse[b]) + 1
        cell, p = wide[a] * shape[1] + wide[b], prob()
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    able = [j for j in range(k) if len(m.coarse[j])]
    ranked = sorted(combinations(able, 2), key=lambda ab: -_quadrants(*grids(*ab)[1:])[0])
    m.pairs = ranked[:PAIRS]
    m.pair_tables = [np.zeros((len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, ab in enumerate(m.pairs):
            cell, g, h = grids(*ab)
            t = RATE * _quadrants(g, h)[1]
            m.pair_tables[i] += t
            z += t.ravel()[cell]
    return m


def _held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(True))


def _rows(batches):
    """Arrow batches of (key, text bytes) with features."""
    for batch in batches:
        x = np.array([features(v.as_py() or b"") for v in batch.column(1)], float).reshape(batch.num_rows, len(FEATURES))
        yield batch.column(0), x


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on labelled rows that are not held out.

    A document with several labels counts as 1 if at least half of them are 1; labels that are null, or of documents
    that are not there, are ignored. No more than ``sample`` labels, those whose id hashes least, are joined with the
    texts (broadcast: 16 bytes each) and only their features reach the driver.
    """
    ids = labels.where(F.col(label_col).isNotNull() & ~_held_out(id_col)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("_y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(sample)

    def run(batches):
        for y, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([y, pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    some = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(ids), id_col).select("_y", "_text")
    got = some.mapInArrow(run, "y double, x array<double>").toArrow().combine_chunks()
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y)) if len(y) else []  # whatever the order in which tasks end
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row; null and empty texts are scored as empty, null ids count as held out.

    One map over whole texts; repeated rows and ties are scored alike and each kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for key, x in _rows(batches):
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([key, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    out = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, _held_out(id_col).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns unchanged and of any names, whose score reaches the threshold; null texts are scored as empty."""
    names, schema = docs.columns, docs.schema
    text = names.index(text_col)

    def run(batches):
        for batch in batches:
            said = batch.column(text)  # texts go to Python once: their bytes are looked at as they lie there
            said = said.cast(pa.large_binary() if pa.types.is_large_string(said.type) else pa.binary())
            (_, x), = _rows([pa.RecordBatch.from_arrays([batch.column(0), said], names=["k", "t"])])
            keep = pa.array(model.score(x) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names=names).filter(keep)

    return docs.mapInArrow(lean(run), schema)
