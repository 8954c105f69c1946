import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from foldline.llm import packing
from tests.llm.util import documents, words


def least(counts, capacity):
    """A lower bound on sequences (Martello and Toth's second): for each length x, pieces longer than capacity - x stand
    alone but for shorter ones than x, pieces over a half don't meet, and what room they leave must hold the rest."""
    n = np.zeros(capacity + 1, np.int64)
    for k, c in counts.items():
        n[k] += c
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for x in range(capacity // 2 + 1):
        alone, half = n[size > capacity - x].sum(), (size <= capacity - x) & (2 * size > capacity)
        rest = (size >= x) & (2 * size <= capacity)
        room = int(n[half].sum()) * capacity - int((n * size)[half].sum())
        best = max(best, int(alone + n[half].sum()) + max(0, -(-(int((n * size)[rest].sum()) - room) // capacity)))
    return best


def test_plan_places_every_piece_once_and_is_tight():
    rng = random.Random(3)
    for capacity, kinds in ((1024, 300), (10, 10), (7, 2)):
        counts = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(kinds)}
        patterns = packing.plan(counts, capacity)
        assert all(sum(b) <= capacity for _, b in patterns)
        assert {n: sum(t * b.count(n) for t, b in patterns) for n in counts} == counts
        if kinds == 300:
            assert least(counts, capacity) <= sum(t for t, _ in patterns) <= 1.005 * least(counts, capacity) + 1
    assert packing.plan({}, 5) == []
    # 6 takes 3 first; two of 2 fit its gap of 4 better
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_rows_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(1500)) for _ in range(60)] + [None, "", "<|endoftext|>", "é🙂 <|endoftext|>!", "a" * 30_000] + ["same"] * 50
    ids = [*range(len(texts) - 2), None, 5]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in zip(ids, texts, strict=True):
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(x) % 1024
        starts = [0] * (first > 0) + list(range(first, len(x), 1024))
        want += [(i, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(starts) for p in [x[s : (first if s == 0 and first else s + 1024)]]]
    got = packing.pack(documents(spark, texts, ids)).collect()
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 1024 + 1
    assert packing.pack(documents(spark, [])).count() == 0


def test_same_ids_as_the_library_on_a_whole_corpus():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r or "" for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert packing._tokens(public_tokenizers.path("byte_bpe_50k.json")).fast
    for i in range(0, len(texts), 500):
        for text, e in zip(texts[i : i + 500], t.encode_batch(texts[i : i + 500], add_special_tokens=False), strict=True):
            assert packing.tokenize(text) == e.ids


def test_other_files_are_left_to_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.tokenize("Some Words, and é!", "word_bpe_49k.json") == t.encode("Some Words, and é!", add_special_tokens=False).ids


def test_names_of_the_result_are_no_ids(spark):
    with pytest.raises(ValueError):
        packing.pack(documents(spark, ["a"]).withColumnRenamed("doc_id", "piece"), "piece")
