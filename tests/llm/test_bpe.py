import hashlib
import heapq
import random

import numpy as np
import public_tokenizers
import tiktoken

from foldline.llm import bpe
from tests.llm.util import documents


def test_same_ids_as_the_library(spark):
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab '!\n stheré1 　中🙂<|endoftext|>") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "a" * 3000, "the" * 2000, " " * 999 + "x", "ab" * 1500 + "!" * 500, "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.bpe_digest(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for r in bpe.encode_decode(documents(spark, texts)).collect():
        assert bytes(r.decoded).decode() == (texts[r.id] or "") and r.ids == library.encode_ordinary(texts[r.id] or "")
    assert bpe.bpe_digest(documents(spark, [])).count() == 0
    assert [r.doc_id for r in bpe.bpe_digest(documents(spark, ["x", "x"], [None, None])).collect()] == [None, None]


def by_heap(ranks, piece):
    """Merges in order of rank, then place, off a heap."""
    token, after, before = [piece[i : i + 1] for i in range(len(piece))], list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    n = len(piece)
    heap = [(ranks[piece[i : i + 2]], i, piece[i : i + 1], piece[i + 1 : i + 2]) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if token[i] != a or j >= n or token[j] != b:
            continue
        token[i], token[j], after[i] = a + b, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get(token[x] + token[y])) is not None:
                heapq.heappush(heap, (r, x, token[x], token[y]))
    return [ranks[t] for t in token if t is not None]


def test_a_megabyte_without_a_break(spark):
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeiostr") for _ in range(1_000_000)), "a" * 200_000]
    for r in bpe.bpe_digest(documents(spark, texts)).collect():
        ids = by_heap(c.ranks, texts[r.doc_id].encode())
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
