"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a worker remembers, and the longest of them in characters; others are encoded each time.
CACHED, CACHED_CHARS = 1_000_000, 64


class RankQueue:
    """Positions waiting by merge rank.

    A bucket per rank holds positions, leftmost first. Three levels of 64-bit words tell which buckets hold any, so
    the least rank is three find-first-set steps away whatever the length of the pre-token.
    """

    def __init__(self, ranks: int) -> None:
        self.bucket: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        b = self.bucket[rank]
        if not b:
            i, j = rank >> 6, rank >> 12
            self.low[i] |= 1 << (rank & 63)
            self.mid[j] |= 1 << (i & 63)
            self.top |= 1 << j
        heappush(b, at)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the least rank."""
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        w = self.mid[j]
        i = (j << 6) + (w & -w).bit_length() - 1
        w = self.low[i]
        rank = (i << 6) + (w & -w).bit_length() - 1
        b = self.bucket[rank]
        at = heappop(b)
        if not b:
            self.low[i] &= w - 1
            if not self.low[i]:
                self.mid[j] &= self.mid[j] - 1
                if not self.mid[j]:
                    self.top &= self.top - 1
        return rank, at


class Codec:
    """Encodes pre-tokens by the ranks of a ``.tiktoken`` file and decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.queue = RankQueue(size)
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.known = _Known(self)

    def _pair(self, a: int, b: int) -> int:
        """The rank of two adjacent tokens joined, or -1."""
        key = a << 20 | b
        r = self.pairs.get(key)
        if r is None:
            r = self.ranks.get(self.token[a] + self.token[b], -1)
            if len(self.pairs) < CACHED:
                self.pairs[key] = r
        return r

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pair = self.queue.push, self._pair
        for i in range(n - 1):
            r = pair(ids[i], ids[i + 1])
            if r >= 0:
                push(r, i)
        while (got := self.queue.pop()) is not None:
            rank, i = got
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pair(ids[i], ids[j]) != rank:
                continue  # stale: one side has been merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pair(rank, ids[k])
                if r >= 0:
                    push(r, i)
            k = before[i]
            if k >= 0:
                r = pair(ids[k], rank)
                if r >= 0:
                    push(r, k)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode())
        out = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, ids, decoded): token ids as an array of long, and the bytes that they decode to.

    One row for each row, repeated rows included; ids may be null. A null or empty text has no ids. No special tokens:
    their spelling is ordinary text. Other columns are not looked at. Nothing is shuffled; long pre-tokens cost
    n log n, for the queue and not a scan finds each merge.
    """
    kind = df.schema[id_col].dataType
    pattern = public_tokenizers.PATTERN

    def run(batches):
        c = codec(public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            ids = [c.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([c.decode(x) for x in ids], pa.binary())],
                names=["id", "ids", "decoded"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, ids array<bigint>, decoded binary")


def bpe_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """As encode_decode, with counts and SHA-256 digests in place of ids and bytes, which then never leave the worker."""
    kind = df.schema[id_col].dataType
    pattern = public_tokenizers.PATTERN

    def run(batches):
        c = codec(public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids = c.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
