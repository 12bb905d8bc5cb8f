"""Chat examples against plain loops, the way back out of the template, and every defined case."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, queries

SCHEMA = "conv_id long, turn long, role string, text string, n string, whole string, example string"
PIECES = [*chat_format.FOREIGN, "<|im_start|>", "<|im_sep|>", "<|im_end|>", "\\", "\\\\", "<", "|", ">", "[", "/", "INST]", "s>", "\n", "$1", "é", "𝄞", "a b", "<|im_start|", "[INST", ""]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def tangled(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))


def conversations(rng, n=60):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "assistant", "system", None, tangled(rng)]), rng.choice([tangled(rng), tangled(rng), None])))
    return rows + rows[:40]  # repeated rows


def gathered(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def test_escapes_come_off_again_and_leave_no_control(spark):
    rng = random.Random(1)
    texts = [tangled(rng) for _ in range(500)] + ["\\" * 7, "<|im_s<|im_start|>", "[INST[INST]]", "<s></s>"]
    template = chat_format.Template()
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escaped(F.col("t"), template)).withColumn("b", chat_format.unescaped(F.col("e")))
    for r in df.collect():
        assert r.b == r.t and not any(c in r.e for c in template.controls)


def test_overlapping_controls_are_all_broken(spark):
    template = chat_format.Template(foreign=("abab", "baba"))
    row = spark.createDataFrame([("ababab",)], "t string").select(chat_format.escaped(F.col("t"), template).alias("e")).first()
    assert "abab" not in row.e and "baba" not in row.e


def test_examples_equal_plain_ones(spark):
    rows = conversations(random.Random(2))
    got = {}
    examples = chat_format.format_conversations(frame(spark, rows))
    for r in examples.select("*", chat_format.turns_of(F.col("text")).alias("turns"), chat_format.loss_text(examples).alias("loss")).collect():
        got.setdefault(r.conv_id, []).append((r.example, [tuple(t) for t in r.turns], r.loss, r.loss_start is not None, r.whole))
    expected = {}
    for c, turns in gathered(rows).items():
        ends = [i for i, (role, _) in enumerate(turns, 1) if role == "assistant" or i == len(turns)]
        expected[c] = [(e, turns[:i], turns[i - 1][1] if turns[i - 1][0] == "assistant" else "", turns[i - 1][0] == "assistant", i == len(turns)) for e, i in enumerate(ends)]
    assert {c: sorted(x) for c, x in got.items()} == expected


def test_digests_equal_plain_ones(spark):
    rows = [*conversations(random.Random(3)), *[(None, t, "assistant", f"x{t}") for t in range(5)], (900, 0, "user", "no reply")]
    digests = {r.conv_id: r for r in queries.chat_digests(chat_format.format_conversations(frame(spark, rows))).collect()}
    expected = gathered(rows)
    assert set(digests) == set(expected)
    for c, turns in expected.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert digests[c].n_turns == len(turns) and digests[c].loss_chars == len(loss)
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert digests[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("turns", [400])
def test_long_conversations(spark, turns):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} " * 200) for t in range(turns)]
    examples = chat_format.format_conversations(frame(spark, rows))
    assert examples.count() == turns // 2
    row = queries.chat_digests(examples).first()
    assert row.n_turns == turns and row.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_one_shuffle_serves_the_examples_and_their_digests(spark):
    plan = queries.chat_digests(chat_format.format_conversations(frame(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_of_nothing(spark):
    assert chat_format.format_conversations(frame(spark, [])).count() == 0
    assert queries.chat_digests(chat_format.format_conversations(frame(spark, []))).count() == 0
