"""Chat formatting against a plain parser."""

import hashlib
from itertools import groupby

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_turns string, segments int, __turn string"
ODD = [
    "\\### Assistant: </turn> ok", "<|end|>\n", "<|turn assistant|>x", "<|and|>", "\\p\\b|\\|", "", None, "é€\U0001f600", "|" * 50, "\\" * 7, "a\nb",
]


def rows():
    out = [(1, i, ("user", "assistant")[i // 2 % 2], text) for i, text in enumerate(ODD)]
    # Turns out of order, ties, repeated rows, nulls in every column, roles that look like marks.
    out += [(2, 5, "user", "late"), (2, 1, "system", "first"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (2, None, "user", "last")]
    out += [(3, 0, None, None), (3, 1, "", "x"), (None, 0, "user", "a"), (None, None, None, None), (4, 0, "|> and |p\\", "y")]
    out += [(5, i, "assistant", f"t{i}") for i in range(3000)]
    return [(*r, "clash", 1, "clash") for r in out]


def wanted(data):
    out = {}
    for conv in {r[0] for r in data}:
        turns = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == conv))
        turns = [(role, text) for *_, role, text in turns]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        merged = len(list(groupby(turns, key=lambda t: t[0])))
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), merged)
    return out


def test_digests_equal_a_plain_reading(spark):
    data = rows()
    chats = chat.formatted(spark.createDataFrame(data, SCHEMA).repartition(3))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_messages) for r in chat.digests(chats).collect()}
    assert got == wanted(data)
    whole = chats.select(chat.joined(F.col("segments")).alias("t"), "segments").collect()
    assert all(r.t == "".join(s.text for s in r.segments) for r in whole)
    # A mark is never part of a text under the mask.
    assert not any("|" in s.text for r in whole for s in r.segments if s.loss)
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []


def test_only_expressions(spark):
    plan = chat.digests(chat.formatted(spark.createDataFrame(rows(), SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|b", "\\"]), st.text("|\\pb<>end\n", max_size=8)), min_size=1, max_size=8))
def test_any_text_survives(spark, turns):
    data = [(1, i, r, t, "", 1, "") for i, (r, t) in enumerate(turns)]
    whole = chat.formatted(spark.createDataFrame(data, SCHEMA)).select(chat.joined(F.col("segments")).alias("t"))
    read = whole.select(chat.turns_of(F.col("t")).alias("turns")).first().turns
    assert [tuple(t) for t in read] == turns


def test_template(spark):
    data = [(1, 0, "user", "a|b"), (1, 1, "user", "c"), (1, 2, "assistant", "d\\")]
    row = chat.formatted(spark.createDataFrame(data, "conv_id int, turn int, role string, text string")).select(chat.joined(F.col("segments")).alias("t")).first()
    assert row.t == "<|turn user|>a\\pb<|and|>c<|end|>\n<|turn assistant|>d\\b<|end|>\n"
