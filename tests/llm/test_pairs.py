"""Similar texts, vectors and repeated strings against brute force on small tables."""

import hashlib
import re
import time

import numpy as np
import pandas as pd
import pytest

from netloom.llm import jaccard, near_vectors, nearest, shingles, store, suffixes
from netloom.llm.components import components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def shingle_set(text, k):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return words


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 100)])
def test_similar_equals_all_pairs(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)  # many blocks even here
    rng = np.random.default_rng(words)
    base = [[f"w{x}" for x in rng.integers(0, 40, n)] for n in (3, 8, 30, 80, 200)]
    texts = [" ".join(b) for b in base for _ in range(2)]
    texts += [" ".join(edited(rng, b, rng.integers(1, 4))) for b in base for _ in range(14)]
    texts += [None, "", "  \n\t ", "one", "ONE", "One\x0btwo", "one two", "Été é", "é", "x" * 400, "x" * 400 + " y"]
    rng.shuffle(texts)
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[0], 1), rows[3]], "doc_id bigint, text string, component_id int")
    sets = [shingle_set(t, words) for t in texts]
    links = [
        (i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = roots(len(texts), links)
    got = jaccard.similar(docs, words, percent).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert jaccard.similar(docs.limit(0), words, percent).count() == 0


def test_similar_ids_with_several_texts(spark, monkeypatch):
    """An id stands for all its texts: links of each of them count, in whatever block they lie."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        for side in (0, 1):
            words = [f"w{x}" for x in rng.integers(0, 500, 60)]
            rows.append((10 * i, " ".join(words)))
            rows += [(10 * i + 1 + 2 * j + side, " ".join(edited(rng, words, 1))) for j in range(2)]
    rows += [rows[0], rows[7], (10, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    sets = [shingle_set(t, 3) for _, t in rows]
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    want = roots(1000, links)
    got = jaccard.similar(docs, 3, 90).collect()
    assert len(got) == len(rows) and len({r.component_id for r in got}) == 59
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    for k in range(300):
        n = int(rng.integers(1, 200 if k % 2 else 5000))
        common = rng.integers(0, 2**63, n)
        extra = rng.integers(0, 2**63, n * 100 // 80 - n)
        cut = int(rng.integers(0, len(extra) + 1))
        union = np.concatenate([common, extra])
        places = np.concatenate([np.arange(n + cut), np.arange(n), np.arange(n + cut, len(union))])
        sizes = np.array([n + cut, len(union) - cut])
        both, at = jaccard.sketches(union, places, sizes), int(jaccard.sketch_words(sizes)[0])
        assert jaccard.could_link(both[:at], int(sizes[0]), both[at:], sizes[1:], 80)
        assert jaccard.could_link(both[at:], int(sizes[1]), both[:at], sizes[:1], 80)


def test_sketches_rule_out_large_sets_that_share_half():
    rng = np.random.default_rng(7)
    for n in (600, 3_000, 40_000, 300_000):
        union = rng.integers(0, 2**63, 3 * n // 2)
        places, sizes = np.concatenate([np.arange(n), np.arange(n // 2, 3 * n // 2)]), np.array([n, n])
        both, at = jaccard.sketches(union, places, sizes), int(jaccard.sketch_words(sizes)[0])
        assert not jaccard.could_link(both[:at], n, both[at:], sizes[1:], 80)


def test_similar_pairs_share_a_signature():
    """Any two sets whose similarity just suffices have a signature in common."""
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        levels = jaccard.Levels(percent)
        for n in (1, 5, 9, 10, 19, 57, 300):
            for _ in range(20):
                common = rng.integers(0, 2**63, n, dtype=np.uint64)
                extra = n * 100 // percent - n
                a = rng.integers(0, extra + 1)
                x = np.concatenate([common, rng.integers(0, 2**63, a, dtype=np.uint64)])
                y = np.concatenate([common, rng.integers(0, 2**63, extra - a, dtype=np.uint64)])
                h, bounds = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
                m = jaccard.measures(h, bounds, levels)
                sig, owner = jaccard.signatures(h, bounds, m, levels)
                assert set(sig[owner == 0]) & set(sig[owner == 1])


def test_similar_pairs_share_a_signature_that_both_keep():
    """Whatever signatures count as frequent, similar sets that leave out the most frequent of theirs keep one in common."""
    rng = np.random.default_rng(10)
    left_out = 0
    for percent in (80, 90):
        levels = jaccard.Levels(percent)
        for n in (1, 5, 9, 10, 19, 57, 300, 2_000):
            for k in range(20):
                common = rng.integers(0, 2**63, n, dtype=np.uint64)
                extra = n * 100 // percent - n
                a = rng.integers(0, extra + 1)
                x = np.concatenate([common, rng.integers(0, 2**63, a, dtype=np.uint64)])
                y = np.concatenate([common, rng.integers(0, 2**63, extra - a, dtype=np.uint64)])
                h, bounds = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
                m = jaccard.measures(h, bounds, levels)
                every, owner = jaccard.signatures(h, bounds, m, levels)
                both = np.intersect1d(every[owner == 0], every[owner == 1])
                known = np.unique(both[: (0, 3, len(both))[k % 3]] & jaccard.KNOWN)
                sig, owner = jaccard.signatures(h, bounds, m, levels, (known, rng.integers(3, 6, len(known))))
                assert set(sig[owner == 0]) & set(sig[owner == 1])
                left_out += len(every) - len(sig)
    assert left_out > 1_000


def test_passages_in_many_texts_make_few_candidates(spark, monkeypatch):
    """Texts that share passages but are not similar don't meet one another under the passages' signatures."""
    rng = np.random.default_rng(11)
    passages = [[f"p{x}" for x in rng.integers(0, 10**6, 25)] for _ in range(4)]
    texts = []
    for _ in range(150):
        parts = [[f"w{x}" for x in rng.integers(0, 10**6, 100)] for _ in range(5)]
        texts.append([w for k, p in enumerate(parts) for w in p + (passages[k] if k < 4 else [])])
    texts += [edited(rng, t, 2) for t in texts[:10]]
    made = {}
    monkeypatch.setattr(jaccard, "written", lambda df, label: made.setdefault((label, len(made)), store.written(df, label)))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.similar(docs, 5, 80).collect()}
    assert got == {k: k - 150 if k >= 150 else k for k in range(160)}
    shared = next(df for (label, _), df in made.items() if label == "shared")
    pairs = shared.groupBy("key").count().selectExpr("sum(count * count)").first()[0]
    assert pairs < 2_000


def test_shingles_are_stored_of_sets_that_sketches_leave(spark, monkeypatch):
    """Texts that share a passage with one other meet it, but no shingles of theirs are written; shuffle files go with their job."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for _ in range(60):
        passage = words(120)
        texts += [words(80) + passage, passage + words(80)]
    texts += [edited(rng, t, 2) for t in texts[:10]]
    made, plans = [], []

    def written(df, label):
        if label == "members":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        made.append((label, store.written(df, label)))
        return made[-1][1]

    monkeypatch.setattr(jaccard, "written", written)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in str(disk.getAllFiles().mkString(",")).split(",") if "/shuffle_" in f}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    before = shuffled()
    found = jaccard.similar(docs, 5, 80)
    for _ in range(50):  # they are removed without waiting
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert {r.doc_id: r.component_id for r in found.collect()} == {k: k - 120 if k >= 120 else k for k in range(130)}
    placed = next(df for label, df in made if label == "placed")
    assert placed.count() > 100  # they share signatures
    assert {r.node for label, df in made if label == "members" for r in df.collect()} == {*range(10), *range(120, 130)}
    for plan in plans:  # the filter of texts and the shingles lie in different tasks, whatever the join
        assert plan.index("MapInArrow") < plan.index("RepartitionByExpression [node") < plan.rindex("ArrowEvalPython")


def test_frequent_signatures_are_found_in_any_number_of_texts(spark):
    """The sample grows with the texts: a passage of hundreds is seen however many shingles there are in all."""
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{x}" for x in rng.integers(0, 10**6, 60))
    rows = [(k, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for k in range(800)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "cast(text as binary) text")
    for total in (10**4, 10**12):
        known, times = jaccard.frequent_signatures(texts, 5, 80, 6, total)
        assert len(known) and times.max() > 10


def test_single_sets_are_tested_together_as_one_by_one():
    rng = np.random.default_rng(14)
    rows = []
    for _ in range(400):
        n = int(rng.choice([3, 30, 500, 700, 3_000]))
        common, a, b = (rng.integers(0, 2**63, k) for k in (n, rng.integers(0, n // 3 + 1), rng.integers(0, n // 3 + 1)))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        told = [jaccard.sketches(z, slice(None), np.array([len(z)])) for z in (x, y)]
        rows.append((1, 2, None, [7], [len(x)], [told[0].tobytes()], [8], [len(y)], [told[1].tobytes()]))
    batch = pd.DataFrame(rows, columns=["qb", "b", "only", "nodes", "sizes", "sketch", "t_nodes", "t_sizes", "t_sketch"])
    want = [
        jaccard.could_link(np.frombuffer(r.sketch[0], np.uint64), r.sizes[0], np.frombuffer(r.t_sketch[0], np.uint64), np.array(r.t_sizes), 80)
        for r in batch.itertuples()
    ]
    assert 50 < sum(want) < 350
    assert jaccard._singles(batch, 80).tolist() == want
    assert jaccard._singles(batch[:0], 80).tolist() == []


def test_shingle_sizes_on_random_bytes():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "c "], rng.integers(0, 30))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for k in (1, 3, 5):
        _, bounds = shingles.sets(data, offsets, k)
        assert np.diff(bounds).tolist() == [len(shingle_set(t, k)) for t in texts]


@pytest.mark.parametrize("cell,block", [(10**6, 10**6), (7, 5)])
def test_near_vectors_equal_all_pairs(spark, cell, block):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.12 * rng.normal(size=(12, 8)) for c in centre] + [rng.normal(size=(20, 8))])
    x[5] = x[6]
    x = x.astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, v.tolist(), int(a), "x") for i, (v, a) in enumerate(zip(x, label, strict=True))]
    n = len(rows)
    odd = [(n, None, 0, ""), (n + 1, [0.0] * 8, 0, ""), (n + 2, [float("nan")] * 8, 0, ""), (n + 3, x[0].tolist(), None, ""),
           (None, x[0].tolist(), int(label[0]), ""), (n + 4, [1.0, None], 0, ""), (n + 5, [1.0, 2.0], 0, ""), (n + 6, [], 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int, kept string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(n, dtype=bool)
    want = roots(n, list(zip(*np.nonzero(near), strict=True)))
    got = near_vectors.near_vectors(df, 0.93, cell, block).collect()
    assert len(got) == n + len(odd) and near.sum() > 100
    for r in got:
        if r.vec_id is not None and r.vec_id < n:
            assert (r.n_links, r.component_id) == (near[r.vec_id].sum(), want[r.vec_id])
            assert r.kept == (r.vec_id == r.component_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, r.vec_id is not None)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("block,per_task", [(10**6, 10**6), (150, 7)])
def test_nearest_recall_and_scores(spark, block, per_task):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(500, 16)), np.repeat(rng.normal(size=(1, 16)), 60, axis=0)]).astype(np.float32)
    x[::3] *= 2
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(None, x[0].tolist(), ""), (2000, None, ""), (2020, [0.0] * 16, ""), (2040, [1.0, float("inf")], "")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, rank string")
    got = nearest.nearest(df, k=20, every=20, block=block, per_task=per_task).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    exact = x.astype(float) @ x.astype(float).T
    assert set(by) == set(range(0, len(x), 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r.vec_id != q for r in found)
        assert found == sorted(found, key=lambda r: (-r.score, r.vec_id))
        assert all(abs(r.score - exact[q, r.vec_id]) < 1e-9 for r in found)
        other = np.delete(exact[q], q)
        hits += sum(r.score >= np.sort(other)[-20] - 1e-9 for r in found)
    assert hits >= 0.9 * 20 * len(by)
    few = nearest.nearest(df.where("vec_id < 6"), k=20, every=5).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(q, i) for q in (0, 5) for i in range(6) if i != q]
    assert nearest.nearest(df.limit(0)).count() == 0


def brute_repeats(rows, length):
    seen, marks = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        mark = marks.setdefault(doc, np.zeros(len(raw), bool))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p:p + length], (doc, p)) != (doc, p):
                mark[p:p + length] = True
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        mark = marks[doc] if doc is not None else np.zeros(len(raw), bool)
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark])
        spans = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        out.append((str(doc), len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,gram", [(12, 5), (100, 40)])
def test_repeats_equal_brute_force(spark, length, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", 30)
    monkeypatch.setattr(suffixes, "MERGE", 20)
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("abé \x00z"), 3 * length)) for _ in range(6)] + ["q" * length, "ab" * length]
    rows = []
    for doc in range(60):
        pieces = [
            p[rng.integers(len(p)):][:rng.integers(1, 3 * length)] if rng.random() < 0.7 else f"{rng.integers(10**9)}"
            for p in (parts[rng.integers(len(parts))] for _ in range(rng.integers(0, 6)))
        ]
        rows.append((doc, "".join(pieces)))
    rows += [(60, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (61, None), (62, ""), (63, "q" * 20 * length)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, n_bytes int")
    got = suffixes.remove_repeats(docs, length, gram).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:5]) for r in got) == brute_repeats(rows, length)
    assert suffixes.remove_repeats(docs.limit(0), length, gram).count() == 0
    assert suffixes.remove_repeats(docs.where("doc_id in (61, 62)"), length, gram).count() == 2


def test_loser_tree_merges_any_runs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        runs, strings = [], []
        for _ in range(rng.integers(1, 8)):
            m = rng.integers(0, 3, (rng.integers(1, 30), 6)).astype(np.uint8)
            m = m[suffixes._sorted_windows(m)]
            shared, rest = suffixes.front_coded(m)
            runs.append((shared.tobytes(), rest))
            strings.append([x.tobytes() for x in m])
        out = list(suffixes.merged(runs, 6))
        order = [strings[r][k] for r, k, _ in out]
        assert order == sorted(x for s in strings for x in s)
        common = [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(order, order[1:], strict=False)]
        assert [n for _, _, n in out] == [0, *common]


def test_components_on_random_graphs(spark):
    rng = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(60)]
    pairs = [(int(a), int(b)) for a, b in rng.integers(100, 400, (200, 2))]
    links = chain + pairs + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots(400, links)
    assert all(got.get(x, x) == want[x] for x in range(400))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_only_blocks_that_can_hold_a_link_meet(spark):
    """Many single sets under one key that are far apart make no pairs; close ones meet once, known ones not again."""
    rng = np.random.default_rng(8)
    sketch = [[int(x) for x in rng.integers(-2**63, 2**63, 4)] for _ in range(60)]
    near = [sketch[0][0] ^ 1, *sketch[0][1:]]
    row = lambda b, top, s, n=40, parts=1, count=1: (1, b, 999, top, parts, count, n, n, *s)
    rows = [row(b, b, s) for b, s in enumerate(sketch)]
    rows += [row(100, 100, near), row(101, 0, near), row(102, 102, near, n=400), row(103, 999, near), row(104, 104, sketch[5], parts=2, count=2)]
    held = spark.createDataFrame(rows, "key int, b long, ref long, top long, parts long, sets long, low long, high long, ts0 long, ts1 long, ts2 long, ts3 long")
    got = {(r.qb, r.b) for r in jaccard._meetings(held, 90).collect()}
    singles = {p for p in got if 104 not in p}
    assert singles == {(0, 100), (100, 101), (0, 103), (100, 103), (101, 103)}
    others = {r[1] for r in rows} - {102, 104}
    assert got - singles == {(104, b) for b in others} | {(b, 104) for b in others - {103}}


def test_sets_of_a_family_meet_blocks_as_one_row(spark):
    """Which sets ask is as told set by set, and the join makes a row a pair of blocks, not one for each set and block."""
    rng = np.random.default_rng(9)
    state = [(k, int(rng.integers(90, 111)), k % 5, int(rng.integers(0, 6)), *[int(x) for x in rng.integers(0, 4, 4)]) for k in range(200)]
    met = [
        (int(rng.integers(0, 6)), qb, 100 + b, int(rng.integers(0, 6)), 1 + b % 2, 1 + b % 3, 95, 105, *[int(x) for x in rng.integers(0, 4, 4)])
        for qb in range(5) for b in range(30)
    ]
    want = {}
    for ref, qb, b, top, parts, sets, low, high, *far in met:
        for node, n, own, component, *near in state:
            if own != qb or component == ref or (parts == 1 and top == component):
                continue
            turned = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(near, far, strict=True))
            if 100 * n >= 90 * low and 100 * high >= 90 * n and (sets > 1 or turned * 190 <= (n + high) * 10):
                want.setdefault((qb, b), set()).add(node)
    state = spark.createDataFrame(state, "node long, n long, b long, component long, s0 long, s1 long, s2 long, s3 long")
    met = spark.createDataFrame(met, "ref long, qb long, b long, top long, parts long, sets long, low long, high long, ts0 long, ts1 long, ts2 long, ts3 long")
    far = jaccard._still_apart(met.unionAll(met.limit(20)), state, 90)
    got = {(r.qb, r.b): r.only for r in far.collect()}
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(node" in plan[plan.index("Join"):]  # the sets are one row a block before they are joined
