import hashlib
import random

import pytest

from foldline.llm import substring
from tests.llm.util import documents, words


def brute(docs, window=20):
    """docs in order; what stays of each."""
    seen, out = set(), []
    for text in docs:
        w = (text or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(rng):
    passages = [words(rng, rng.choice([19, 20, 21, 25, 32, 33, 60])) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [words(rng, rng.randrange(40), 5000) for _ in range(3)]
        texts.append("  \n".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]]))
    texts += ["loop " * 100, "a b " * 60, "", None, "few words", "few words", texts[3], texts[3], "x" * 100_000, " ".join(["é ü"] * 30), words(rng, 30_000)]
    texts += [texts[5]] * 40 + [" ".join(texts[7].split()) + " end"]
    return texts


@pytest.mark.parametrize("gathered", [substring.GATHERED, 50])
def test_against_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(substring, "GATHERED", gathered)
    texts = corpus(random.Random(gathered))
    want = brute(texts)
    got = substring.deduplicate(documents(spark, texts).repartition(7)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
    for r in substring.substring_digest(documents(spark, texts[:20])).collect():
        assert r.kept_sha256 == hashlib.sha256(brute(texts[:20])[r.doc_id][2].encode()).hexdigest()


def test_ids_that_repeat_or_are_null(spark):
    rng = random.Random(1)
    p, q = words(rng, 30), words(rng, 30)
    got = substring.deduplicate(documents(spark, [p, p, p + " x", q, q, None], [5, 5, None, None, 9, 2])).collect()
    said = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got)
    assert said == sorted([("None", 31, 0), ("None", 30, 0), ("5", 30, 30), ("5", 30, 30), ("9", 30, 30), ("2", 0, 0)])
    assert substring.deduplicate(documents(spark, [])).count() == 0


def test_the_cover_is_checked(spark):
    with pytest.raises(ValueError):
        substring.deduplicate(documents(spark, []), cover=(0, 1, 2))
