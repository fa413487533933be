"""Windows of conversations: exact round trip, budget, history and mask."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int"
ODD = ["", None, "\\### Assistant: </turn> ok", "\\", "\\\\</turn>\n### user: x", "</tu", "rn>", "#", "####", "é 日本 \U0001f600", "a\nb", ": "]


def made(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        turns = rng.sample(range(0, 900, rng.choice([1, 3])), rng.choice([1, 2, 5, 30, 280]))
        for j, turn in enumerate(sorted(turns)):
            role = "system" if j == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "a: b", "tool:", "#x", None])
            text = rng.choice(ODD) if rng.random() < 0.3 else " ".join(rng.choices(["one", "two,", "three!"], k=rng.randint(0, 30)))
            rows.append((conv, turn, role, text, 1))
    rows += [rows[0], rows[0], (50, None, "user", "n", 1), (50, 3, "system", "late", 1), (50, 3, "system", "late", 1), (51, 0, "system", "only", 1),
             (None, 0, "user", "no id", 1), (None, 1, "assistant", "yes", 1), (52, 0, "assistant", "w " * 5_000, 1), (52, 1, "assistant", "x", 1)]
    return rows


def ordered(rows):
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "") != "system", role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("budget,history", [(120, 24), (1024, 128), (60, 0)])
def test_round_trip_budget_and_mask(spark, budget, history):
    rows = made(budget)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = chat.windows(df, budget, history).persist()
    want = ordered(rows)
    back = {r.conv_id: r for r in chat.read_back(found).collect()}
    assert set(back) == set(want)
    for conv, turns in want.items():
        assert [tuple(x) for x in back[conv].turns] == turns
        assert back[conv].loss == "".join(t for r, t in turns if r == "assistant")
    read = found.withColumn("turns", chat.read_turns(F.col("text"))).withColumn("told", chat.loss_text(F.col("text"), F.col("loss")))
    by = {}
    for r in read.collect():
        by.setdefault(r.conv_id, []).append(r)
    several = repeats = 0
    for conv, parts in by.items():
        parts.sort(key=lambda r: (r.block, r.start_token))
        turns, at = want[conv], 0
        system = turns[0] if turns[0][0] == "system" else None
        for k, r in enumerate(parts):
            seen = [tuple(x) for x in r.turns]
            assert len(seen) == r.n_turns
            old, fresh = seen[:r.n_context], seen[r.n_context:]
            assert fresh == turns[at:at + len(fresh)] and fresh
            if system and k:
                assert old[0] == system
                old = old[1:]
            assert old == turns[at - len(old):at]
            repeats += len(old)
            size = r.n_tokens
            assert size <= budget or len(fresh) == 1 or (system and not k and len(fresh) == 2)
            assert r.told == "".join(t for role, t in fresh if role == "assistant")
            at += len(fresh)
        assert at == len(turns)
        several += len(parts) > 1
    assert several > 5 and (repeats > 20 or not history)
    found.unpersist()


def test_history_reaches_over_blocks(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", "w", 1) for t in (0, 1, 255, 256, 257, 700, 5000)]
    found = chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 20).orderBy("block").collect()
    assert [(r.n_context, r.n_turns) for r in found] == [(0, 3), (3, 5), (3, 4), (3, 4)]
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native(spark):
    df = spark.createDataFrame(made(1), SCHEMA)
    plan = chat.read_back(chat.windows(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapElements", "DeserializeToObject"))
