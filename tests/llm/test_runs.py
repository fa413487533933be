"""Periodic runs against comparing all words with all others."""

import random

import numpy as np
import pytest

from netloom.llm import runs


def brute(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed, count):
    rng = random.Random(seed)
    texts = ["", "a", "a a", " ".join("a" * 300), "\n a\x0bb\tA ", " ".join("ab" * 40) + " c " + " ".join("ab" * 9), "x " * 6 + "y " * 6]
    for _ in range(count):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 6])
        w = [f"é{rng.randrange(k)}" for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, n)
            w = [w[i] if i < a or a + (i - a) % p >= n else w[a + (i - a) % p] for i in range(n)]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("least", [2, 12])
@pytest.mark.parametrize("jumps,batch", [(0, 50), (48, 400_000)])
def test_runs_equal_brute_force(least, jumps, batch, monkeypatch):
    monkeypatch.setattr(runs, "JUMPS", jumps)
    monkeypatch.setattr(runs, "BATCH_WORDS", batch)
    texts = made(least, 600)
    for text, (n, found, rest) in zip(texts, runs.judge([t.encode() for t in texts], least), strict=True):
        words = [w.decode() for w in text.encode().split()]
        want = brute(words, least)
        assert (n, [(x["start"], x["length"], x["period"]) for x in found]) == (len(words), want)
        assert rest.decode() == collapsed(words, want)


def test_smaller_values_of_staircases():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = np.concatenate([[0], rng.integers(0, rng.integers(1, 9) + 1, 60), np.arange(90), np.arange(90, 0, -1), [1, 1]])
        got = runs.previous_smaller(x.astype(np.int32))
        for j in np.flatnonzero(x):
            assert got[j] == np.flatnonzero(x[:j] < x[j])[-1]


def test_rows_of_a_table(spark):
    texts = made(3, 30)
    long = " ".join(["b c"] * 30_000)
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(2, texts[5], 5), (None, texts[5], 5), (900, None, 5), (901, long, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    got = runs.runs(df).collect()
    assert len(got) == len(rows)
    want = []
    for doc, text, _ in rows[:-1]:
        words = [w.decode() for w in (text or "").encode().split()]
        found = brute(words, 12)
        want.append((str(doc), len(words), str(found), collapsed(words, found)))
    want.append(("901", 60_000, str([(0, 60_000, 2)]), "b c"))
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs]), r.collapsed) for r in got) == sorted(want)
    assert runs.runs(df.limit(0)).count() == 0 and runs.runs(df.select("text")).count() == len(rows)
