"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from netloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, words = len(held), sum(len(t) for _, t in held)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in held) + 1))) for t in own}
        scores = []
        for d, x in held:
            m = 10 + 90 * len(x) * n_docs // words
            score = sum(weight[t] * (10**9 * x.count(t) // (1000 * x.count(t) + 8 * m)) for t in own)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def made(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["été", "x_y", "a-b", "日本", "1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(200)]
    docs += [(300, docs[7][1]), (7, docs[7][1]), (None, docs[7][1]), (301, None), (302, ""), (303, "?! \n"), (304, "w9 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(15)]
    items += [(20, docs[7][1]), (20, "w1"), (None, "w3 w4"), (21, None), (22, ""), (23, "nowhere"), (24, "w9 w9 W9")]
    return docs, items


@pytest.mark.parametrize("passes,shard,k", [(500_000, 1_000_000, 10), (20, 100, 3)])
def test_search_equals_scoring_all(spark, passes, shard, k, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_PAIRS", passes)
    monkeypatch.setattr(lexical, "SHARD", shard)
    docs, items = made(k)
    left = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, score int").repartition(5)
    right = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    got = lexical.search(left, right, k).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == brute(docs, items, k)
    assert lexical.search(left.limit(0), right, k).count() == 0 and lexical.search(left, right.limit(0), k).count() == 0


def test_accumulators_end_early():
    """A rare term decides, so documents that hold only the common ones get no accumulator, and blocks
    after the first know the best scores."""
    rng = np.random.default_rng(5)
    size = 5_000
    rare = np.zeros((size, 4), np.int64)
    rare[:30] = rng.integers(1, 4, (30, 4))
    tf = np.concatenate([rare, rng.integers(0, 3, (size, 6))], axis=1)
    df = (tf > 0).sum(0)
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * x + 1))) for x in df.tolist()])
    order = np.lexsort((np.arange(10), df))
    doc, term = np.nonzero(tf)
    n = tf.sum(1) + 5
    bounds = np.searchsorted(doc, np.arange(size + 1))
    block = lexical.Block(n, bounds, term, tf[doc, term], 10, size, int(n.sum()))
    counters = {}
    at, value = block.best(order, weights[order], 10, np.zeros(0, np.int64), counters)
    m = 10 + 90 * n * size // n.sum()
    exact = (weights * ((10**9 * tf) // (1000 * tf + 8 * m[:, None]))).sum(1)
    assert counters["accumulators"] == 30 and (value == exact[at]).all()
    assert sorted(value)[-10:] == sorted(exact)[-10:]
    again = {}
    at, value = block.best(order, weights[order], 10, np.sort(exact)[::-1][:10] * 3, again)
    assert again["accumulators"] == 0 and not len(at)
