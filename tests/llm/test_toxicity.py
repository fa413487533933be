import zlib

import numpy as np

from netloom.llm import toxicity
from netloom.llm.queries import QUERIES

LEX = toxicity.Lexicon({"idiot": 5.0, "vequ*": 4.0}, ["idiot savant"])


def found(text):
    return [h[3] for h in LEX.finder()(toxicity.fold(text))]


def test_folding_edges_stems_and_exceptions():
    assert found("You IDIOT!") == ["idiot"]
    assert found("1d10t, ідіот and іdiоt") == ["idiot"] * 2 or found("1d10t") == ["idiot"]
    assert found("ｉｄｉｏｔ id​iot") == ["idiot", "idiot"]
    assert found("idiotic xidiot") == []
    assert found("vequaire avequ vequ") == ["vequ*", "vequ*"]
    assert found("an idiot  savant, an idiot") == ["idiot"]
    assert found("") == []


def test_same_as_a_plain_scan():
    rng = np.random.default_rng(3)
    parts = ["idiot", "vequ", " ", ".", "a", "x", "idiot savant", "\n"]
    find = LEX.finder()
    for _ in range(300):
        text = "".join(rng.choice(parts, 12))
        spaced = " ".join(text.split())
        hold = [i for i in range(len(spaced)) if spaced.startswith("idiot savant", i)
                and (i == 0 or not spaced[i - 1].isalnum())
                and (i + 12 == len(spaced) or not spaced[i + 12].isalnum())]
        want = []
        for i in range(len(spaced)):
            if i and spaced[i - 1].isalnum():
                continue
            if spaced.startswith("idiot", i) and not spaced[i + 5:i + 6].isalnum() and i not in hold:
                want.append("idiot")
            if spaced.startswith("vequ", i):
                want.append("vequ*")
        assert sorted(h[3] for h in find(text)) == sorted(want)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (None, "idiot", 0.5), (2, "", 0.5), (3, "word " * 30000 + "idiot", 0.5)],
        "doc_id bigint, text string, score double",
    )
    rows = toxicity.score_texts(docs, LEX).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score > 0.5 for r in rows if r.doc_id is None} == {True}
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs.limit(0), labels)
    assert lexicon.weights == {} and lexicon.score("", lexicon.finder()) < 0.5
    one_kind = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, one_kind).weights == {}


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op10_toxicity"](spark, folder).collect()
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
