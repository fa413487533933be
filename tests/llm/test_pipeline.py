"""The pipeline against plain versions of its stages on a small table, and its stages' odd rows."""

import re

import numpy as np
import pytest

import corpus_pipeline as P
from netloom.llm import secrets, toxicity
from test_packing import PATH, check_places, expected

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def test_stages_one_by_one(spark):
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "secrets", "mixture", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    find = lexicon.finder()
    rows = {r.doc_id: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    assert clean.columns == docs.columns
    want = {i for i, r in rows.items() if lexicon.score(toxicity.fold(r.text or ""), find) < 0.5}
    assert {r.doc_id for r in clean.collect()} == want

    single = stages["near_copies"](spark, clean, FOLDER).cache()
    sets = {i: shingles(rows[i].text) for i in want}
    parent = {i: i for i in want}

    def find_root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(want)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find_root(a), find_root(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in ids if find_root(i) == i}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want

    redacted = stages["secrets"](spark, single, FOLDER).cache()
    field = secrets.learn(single)
    assert redacted.columns == docs.columns
    for r in redacted.collect():
        base, every = secrets.spans_of(rows[r.doc_id].text or "", field.spans(rows[r.doc_id].text or ""))
        assert r.n_chars == len(r.text)
        assert (r.text == rows[r.doc_id].text) == (not every)
        assert r.text.count("[secret]") >= (len(base) > 0)

    mixed = stages["mixture"](spark, redacted, FOLDER).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= want
    packed = stages["packing"](spark, mixed, FOLDER).collect()
    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    assert {tuple(r)[:5] for r in packed} == expected(texts, 4096)
    total = sum(r.length for r in packed)
    assert check_places(packed, 4096) <= -(-total // 4096) + 2


@pytest.mark.parametrize("rows", [[], [(1, None, "a", None, 1), (1, None, "a", None, 1), (None, "x", None, None, 2), (2, "", "a", "b", 3)]])
def test_odd_tables_pass_every_stage(spark, rows):
    schema = "doc_id bigint, text string, source string, lang string, score int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    packed = P.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(packed) == docs.count()
    if rows:
        assert np.isin([r.doc_id for r in docs.collect() if r.doc_id is not None], [1, 2]).all()


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Also in a plan that is run after its stage has returned."""
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score_texts", lambda docs, lexicon, name: docs.selectExpr("*", f"0.0 as {name}"))
    monkeypatch.setattr(secrets, "learn", lambda docs: None)
    monkeypatch.setattr(secrets, "scan", lambda docs, field, redact: docs)
    monkeypatch.setattr(P.packing, "pack", lambda docs, tokenizer: docs)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 30, 1, 1).selectExpr("id as doc_id", "repeat('word ', 200000) as text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    try:
        for stage in (P.drop_toxic, P.redact_secrets, P.pack_sequences):
            spark.conf.set(name, before)
            stage(spark, docs.limit(2), FOLDER)
            assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) < 8 << 20, stage
    finally:
        spark.conf.set(name, before)
