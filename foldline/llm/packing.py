"""Best-two-fit packing of token sequences.

Lengths are integers from 1 to the capacity, so whatever the corpus, a plan needs only how many pieces there are of each
length. The plan is made on that histogram; pieces then find their places by their rank among those of equal length.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldline.llm.common import scratch

CAPACITY, END = 1024, 2

#: Ranks are counted within groups of about this many pieces.
RANKED = 100_000


class _Tokens:
    """Ids of a tokenizer JSON file as the tokenizers library gives them, without special tokens added.

    Where the file is a plain byte-level BPE, whose merges are ranked as its ids are, tiktoken gives the same ids from the
    file's vocabulary in a fraction of the time (the tests compare all of a corpus). Any other file is left to the library.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = _plain(spec)
        self.library = None if self.fast else Tokenizer.from_file(path)

    def __call__(self, text: str) -> list[int]:
        if self.fast:
            return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids


def _plain(spec: dict) -> tiktoken.Encoding | None:
    """The encoding of a JSON file that holds nothing but bytes, merges and tokens of its own, or None."""
    model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    special = {t["content"]: t["id"] for t in added}
    ok = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("byte_fallback") and not model.get("ignore_merges")
    ok = ok and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not spec.get("normalizer")
    ok = ok and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    ok = ok and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"].get(m, -1) for m in merged]
    if not ok or ids != sorted(set(ids)) or len(merged) + 256 != len(set(model["vocab"]) - set(special)):
        return None
    # Byte-level files spell bytes as printable characters: printable bytes as themselves, the others from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(2)
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


def tokenize(text: str, vocabulary: str = "byte_bpe_50k.json") -> list[int]:
    """Ids as the tokenizers library gives them with add_special_tokens=False; it reads a special token's spelling as that token."""
    return _tokens(public_tokenizers.path(vocabulary))(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many full ones as there are, what is over comes first."""
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (how often, lengths): best-two-fit on a histogram of lengths.

    A bin takes the longest piece there is, then again and again the longest that still fits. Where a gap is left, its
    smallest piece gives way to the two unpacked pieces that together fill the widened gap most tightly, if those fill
    it better. A pattern is repeated as often as its pieces last, so the work follows the number of distinct lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        used: dict[int, int] = {}

        def longest(room: int, used=used, besides: tuple = ()) -> int:
            i = bisect_right(lengths, room) - 1
            while i >= 0 and left[lengths[i]] - used.get(lengths[i], 0) - besides.count(lengths[i]) <= 0:
                i -= 1
            return lengths[i] if i >= 0 else 0

        gap, bin_ = capacity, []
        while gap > 0 and (n := longest(gap)):
            bin_.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap > 0 and len(bin_) > 1:
            small = min(bin_)
            room, best = gap + small, (small, ())
            a = longest(room)
            while a and 2 * a > best[0]:  # the longer of two is at least half of their sum
                b = longest(min(room - a, a), besides=(a,))
                if b and a + b > best[0]:
                    best = (a + b, (a, b))
                    if a + b == room:
                        break
                a = longest(a - 1)
            if best[1]:
                bin_.remove(small)
                bin_ += best[1]
        need = {n: bin_.count(n) for n in set(bin_)}
        times = min(left[n] // k for n, k in need.items())
        out.append((times, sorted(bin_, reverse=True)))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset), by rank: pieces from that rank on go to consecutive sequences."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for times, bin_ in patterns:
        at = 0
        for n in bin_:
            rows.setdefault(n, []).append((rank.get(n, 0), first, at))
            rank[n] = rank.get(n, 0) + times
            at += n
        first += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every row's ids and the end id, cut where they exceed the capacity.

    A null text is empty. Repeated rows and ties are cut alike, each of them; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*tokenize(text.as_py() or "", vocabulary), end], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i), piece.append(k), start.append(s), length.append(n), crc.append(crc32(ids[s : s + n].tobytes()))  # noqa: B018
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    if id_col in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        raise ValueError(f"the id column may not be called {id_col}, as a column of the result is")
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place.

    A null or empty text is the end id alone. Rows with the same or a null id are packed each. The driver sees the
    histogram (at most ``capacity`` counts); texts are read once and not shuffled. Ranks are counted within salted
    groups of a length, so a length that a third of all pieces have is spread over tasks.
    """
    cut_up = scratch(pieces(docs, id_col, text_col, capacity, end, vocabulary))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(counts, capacity))
    salts = 1 + sum(counts.values()) // RANKED
    salted = cut_up.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "start", "ids_crc32"), F.lit(salts)))
    own = Window.partitionBy("length", "_salt").orderBy(F.col(id_col).asc_nulls_first(), "piece", "ids_crc32", "start")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(base.select("length", "_salt", "_base"), ["length", "_salt"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_base")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(batches):
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n):
                at, rows = n == x, table[int(x)]
                i = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = rows[i, 1] + rank[at] - rows[i, 0], rows[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=batch.schema.names)

    return ranked.mapInArrow(place, ranked.schema)
