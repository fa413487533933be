import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, piece string, bin int"


def expected(texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    rows = set()
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], dtype="<u4")
            rows.add((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    return rows


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("per_packer", [10**9, 300])
def test_pieces_and_places(spark, per_packer):
    odd = [
        "", None, "   ", "a", "Don't STOP. Now, please..", "a\x1cb \x01 c\x01d", "<|endoftext|>x", "ΑΣ. İ é",
        "word " * 500, "x" * 3000, "one, two. " * 40,
    ]
    texts = [(i, t) for i, t in enumerate(odd)] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA)
    rows = packing.pack(docs, PATH, capacity=64, tokens_per_packer=per_packer).collect()
    assert {tuple(r)[:5] for r in rows} == expected(texts, 64)
    total = sum(r.length for r in rows)
    assert check_places(rows, 64) <= -(-total // 64) + 3


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same words here", "", 1)] * 40, SCHEMA)
    rows = packing.pack(docs, PATH, capacity=16).collect()
    assert len(rows) == 40 and check_places(rows, 16) == 10
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_rule_takes_the_least_sum_of_squares():
    rng, packer, n = np.random.default_rng(1), packing.Packer(20, 0), [0] * 21
    for length in rng.integers(1, 21, 300).tolist():
        def after(gap):
            m = list(n)
            m[gap] -= 1
            m[gap - length] += 1
            return sum(x * x for x in m[1:])
        fits = [g for g in range(length, 21) if n[g]]
        _, offset = packer.place(length)
        if fits:
            best = min(fits, key=lambda g: (after(g), g))
            assert 20 - offset == best
            n[best] -= 1
            n[best - length] += 1
        else:
            assert offset == 0
            n[20 - length] += 1
        n[0] = 0
    assert n == packer.n.tolist()
