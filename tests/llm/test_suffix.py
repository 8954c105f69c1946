import hashlib
import random

import numpy as np
import pytest

from foldline.llm import common, suffix
from tests.llm.util import documents, words


def brute(texts, window):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for s in range(len(b) - window + 1):
            seen[b[s : s + window]] = seen.get(b[s : s + window], 0) + 1
    out = []
    for b in data:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                edge[s] += 1
                edge[s + window] -= 1
        gone = edge.cumsum()[:-1] > 0
        out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def corpus(rng, window):
    passages = [words(rng, 200, 4000)[: rng.choice([window - 1, window, window + 1, 2 * window, 3 * window])] for _ in range(10)]
    texts = []
    for _ in range(100):
        a, b, c = (words(rng, rng.randrange(40), 5000) for _ in range(3))
        texts.append(a + rng.choice(passages) + b + rng.choice(passages) + c)
    texts += ["ab" * window, "z" * (window + 1), "z" * window, "", None, "é🙂" * window, texts[0], texts[0], "x" + texts[1], texts[2][:-1], words(rng, 300, 5000) * 2]
    return texts + [texts[3][: len(texts[3]) // 2] + "Q" + texts[3][len(texts[3]) // 2 :]]


@pytest.mark.parametrize(("window", "gram", "gathered", "indexed"), [(400, 64, suffix.GATHERED, suffix.INDEXED), (40, 8, 30, suffix.INDEXED), (40, 8, suffix.GATHERED, 1)])
def test_against_brute_force(spark, monkeypatch, window, gram, gathered, indexed):
    monkeypatch.setattr(suffix, "GATHERED", gathered)
    monkeypatch.setattr(suffix, "INDEXED", indexed)
    texts = corpus(random.Random(window), window)
    want = brute(texts, window)
    got = suffix.deduplicate(documents(spark, texts).repartition(5), window=window, gram=gram).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], (r.doc_id, r.n_removed, want[r.doc_id][:3])


def test_ids_that_repeat_or_are_null(spark):
    t = "abc " * 200
    got = suffix.suffix_digest(documents(spark, [t, t, "only one", None, "q" * 399], [5, 5, None, None, 5])).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in got) == [("5", 399, 0, 0), ("5", 800, 800, 1), ("5", 800, 800, 1), ("None", 0, 0, 0), ("None", 8, 0, 0)]
    assert {r.kept_sha256 for r in got if r.n_removed} == {hashlib.sha256(b"").hexdigest()}
    assert suffix.deduplicate(documents(spark, [])).count() == 0


def test_long_texts_are_looked_at_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = np.concatenate(list(suffix.minimizers(text, 400, 64)), axis=1)
    monkeypatch.setattr(suffix, "STRETCH", 700)
    parts = list(suffix.minimizers(text, 400, 64))
    assert len(parts) == 7
    # every window has the same minimizer either way
    of = lambda m: np.repeat(m[3].astype(int), (m[5] - m[4] + 1).astype(int)).tolist()
    assert of(np.concatenate(parts, axis=1)) == of(whole) and len(of(whole)) == 5000 - 399


def test_run_index_against_all_suffixes():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 1), (200, 2), (400, 4)):
        piece = rng.integers(0, k, n).astype(np.uint16)
        gap = np.full(1, suffix.GAP, np.uint16)
        text = np.concatenate([piece, piece[: n // 2], gap, piece, gap, piece[n // 3 :], gap])
        index = suffix.RunIndex(text, 1 << 30)
        x = text.tolist()
        order = sorted(range(len(x)), key=lambda i: [-1 if c == suffix.GAP else c for c in x[i:]])
        assert suffix._suffix_order(text).tolist() == order
        before = [x[i - 1] if i else -1 for i in order]
        assert np.repeat(index.symbol, index.length).tolist() == before
        longest = [[0] * (len(x) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(x) - 1, -1, -1):
                longest[i][j] = 1 + longest[i + 1][j + 1] if x[i] == x[j] and x[i] != suffix.GAP else 0
        assert index.statistics().tolist() == [max(longest[i][j] for j in range(len(x)) if j != i) for i in range(len(x))]


def test_runs_and_not_text_bound_the_index():
    rng = np.random.default_rng(2)
    piece = rng.integers(0, 20, 2_000).astype(np.uint16)
    sizes = []
    for times in (4, 40):
        parts = []
        for _ in range(times):
            p = piece.copy()
            p[rng.integers(0, 2_000, 2)] = rng.integers(0, 20, 2)
            parts += [p, np.full(1, suffix.GAP, np.uint16)]
        index = suffix.RunIndex(np.concatenate(parts), 400)
        kept = [v for v in vars(index).values() if isinstance(v, np.ndarray)]
        sizes.append(sum(len(v) for v in kept))
        assert max(map(len, kept)) == len(index.symbol) < len(np.concatenate(parts)) / times * 2
    assert sizes[1] < 3 * sizes[0]  # for ten times the text


def test_texts_that_confuse_sums_modulo_a_power_of_two():
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    x, y = (np.frombuffer(t, np.uint8) for t in (a, b))
    s, e = np.array([0]), np.array([len(x)])
    assert suffix.Checked(x)(s, e) != suffix.Checked(y)(s, e)
    whole = np.concatenate([y[:77], x])
    assert suffix.Checked(x)(s, e) == suffix.Checked(whole)(s + 77, e + 77) and suffix.Rolling(x)(s, e) == suffix.Rolling(whole)(s + 77, e + 77)


def test_known_items_spread_over_buckets():
    """What a task knows already passes through buckets evenly, though it shares a text or a minimizer."""
    u, s = np.zeros(10_000, np.int64), np.arange(10_000)
    n = np.bincount(common.anywhere(16, u, s), minlength=16)
    assert n.max() < 1.2 * n.mean()
    some = common.dealt(np.array([3, 1, 3]), [np.arange(3)], common.anywhere(16, u, s), [u, s]).to_pydict()
    assert sorted(some["bucket"]) == list(range(16)) and max(map(len, some["o1"])) < 2 * 8 * 10_000 / 16
    assert dict(zip(some["bucket"], some["c0"], strict=True))[3] == np.array([0, 2]).tobytes()
