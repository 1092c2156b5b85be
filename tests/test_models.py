"""Model hooks, the classifier and streams."""

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.operators import classify, inference
from pairloom.streaming import incremental, levels


def test_judge_records_failures(spark, rows):
    df = spark.createDataFrame([(i, [("user", f"{i}a")], [("user", f"{i}b")]) for i in range(4)],
                               "k long, messages_first array<struct<role:string,content:string>>, messages_second array<struct<role:string,content:string>>")

    def fn(messages):
        text = messages[-1]["content"]
        if text == "2b":
            raise RuntimeError("no")
        if text == "3a":
            return "unsure"
        return "Prediction of user preference: " + ("1" if text in ("0a", "1b") else "2")

    out = inference.judge(df, fn, ["k"])
    assert rows(out, "k", "score") == [(0, 1), (1, 0), (2, -3), (3, -2)]
    assert out.filter("k = 2").first()["text_pref_first"] == "Inference failed"
    assert rows(inference.judge(df, fn, ["k"], fold_unparsed=True), "k", "score")[3] == (3, -3)


def test_embed_keeps_columns(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "k long, prompt string")
    out = inference.embed(df, lambda ps: [(p.upper(), [[1.0, 2.0]] * int(p[1:])) for p in ps], batch_size=2)
    got = {r["k"]: (r["prompt"], r["text"], len(r["emb"])) for r in out.collect()}
    assert got == {i: (f"p{i}", f"P{i}", i) for i in range(5)}


def test_encode_marks_a_failed_batch(spark):
    df = spark.createDataFrame([(f"u{i}", bytes([i])) for i in range(6)], "uid string, payload binary").coalesce(1)

    def fn(payloads):
        if any(p[0] == 3 for p in payloads):
            raise ValueError("broken image")
        return [[[[float(p[0])] * 2] * 2] for p in payloads]

    got = {r["uid"]: (r["shape"], r["vals"], r["error"]) for r in inference.encode(df, fn, batch_size=2).collect()}
    assert got["u0"] == ([1, 2, 2], [0.0] * 4, None)
    assert got["u2"] == got["u3"] == (None, None, "broken image")
    assert got["u5"][2] is None


def test_classifier_learns(spark):
    df = spark.range(400).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("class_id"),
        F.array(*[F.when(F.col("id") % 3 == c, 1.0).otherwise(0.0) + F.rand(c) * 0.1 for c in range(3)]).alias("vals"),
    )
    train, test = classify.split_rows(classify.with_features(df), "id")
    assert train.count() + test.count() == 400 and test.count() > 40
    model = classify.train_classifier(train, 3, 3, hidden=[(4,), (6,)], max_iter=[40])
    scored = classify.predict_logits(model, test)
    best = F.array_position("logits", F.array_max("logits")) - 1
    assert scored.filter(best == F.col("class_id")).count() > 0.9 * scored.count()


@pytest.mark.parametrize("late", [False, True])
def test_streams_pick_up_new_files_once(spark, tmp_path, late):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log = spark.range(1, 41).select(F.col("id").alias("micro_step"), (F.col("id") / 10).alias("loss"))
    log.filter("micro_step <= 20").coalesce(1).write.parquet(source)
    start = lambda: incremental.metric_rollup(spark.readStream.schema(log.schema).parquet(source), 8, ["loss"], sink, state)
    start().awaitTermination()
    if late:
        log.filter("micro_step > 20").coalesce(1).write.mode("append").parquet(source)
        start().awaitTermination()
    start().awaitTermination()
    from pairloom.operators.metrics import step_windows

    part = log if late else log.filter("micro_step <= 20")
    want = sorted(tuple(r) for r in step_windows(part, 8, ["loss"]).collect())
    got = sorted(tuple(r) for r in incremental.latest(spark, sink, ["optimizer_step"]).select("optimizer_step", "accumulation_count", "loss").collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_failing_embedding_batches_are_marked(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no answer")
        return [(p, [[1.0]]) for p in prompts if p != "short"]

    df = spark.createDataFrame([("ok",), ("bad",), ("short",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.text, r.error) for r in inference.embed(df, model, batch_size=1).collect()}
    assert got["ok"] == ("ok", None) and got["bad"] == (None, "no answer") and "different number" in got["short"][1]


def test_a_sink_of_updates_stays_small(spark, tmp_path):
    """After many batches a reader opens few folders; a repeated batch counts once, one cut off before its pointer is made up for."""
    sink, merge, count = f"file:{tmp_path}/sink", levels.newest(["k"]), 40
    for n in range(count):
        batch = spark.createDataFrame([(n % 3, n), (100 + n, n)], "k int, v int").coalesce(1)
        if n in (7, 20):
            levels.add(batch, n, sink, merge, 3, stop_before_pointer=True)
            assert {r.k: r.v for r in levels.current(spark, sink, merge).collect()}.get(100 + n) is None
        levels.add(batch, n, sink, merge, 3)
        if n in (5, 8, 26):
            levels.add(spark.createDataFrame([(0, -1)], "k int, v int"), n, sink, merge, 3)
    got = {r.k: r.v for r in levels.current(spark, sink, merge).collect()}
    assert got == {100 + n: n for n in range(count)} | {k: max(n for n in range(count) if n % 3 == k) for k in range(3)}
    folders = levels.live(sink)
    assert len(folders) <= 2 * 4 + 1 and sum(f["last"] - f["first"] + 1 for f in folders) == count
    # What was replaced is gone, but for the state before the last pointer.
    assert len(os.listdir(tmp_path / "sink" / "data")) <= len(folders) + 4


def test_sketches_of_batches_merge_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.standard_normal(20_000), rng.exponential(3, 20_000)])
    parts = np.array_split(rng.permutation(values), 11)
    for order, sink in ((range(11), "a"), (reversed(range(11)), "b")):
        for batch_id, n in enumerate(order):
            flat = spark.createDataFrame([(float(v),) for v in parts[n]], "v double")
            sketch = flat.agg(
                F.kll_sketch_agg_double("v", incremental.SKETCH_K).alias("sketch"), F.count("v").alias("finite_count"),
                F.lit(0).cast("bigint").alias("nan_count"), F.lit(1).cast("bigint").alias("inf_count"),
            )
            levels.add(sketch, batch_id, f"file:{tmp_path}/{sink}", incremental._merged_sketches, 4)
        row = incremental.latest_quantiles(spark, f"file:{tmp_path}/{sink}").first()
        assert row.finite_count == len(values) and row.inf_count == 11
        for name, q in C.QUANTILES.items():
            rank = (values < row[name]).mean()
            assert abs(rank - q) <= incremental.RANK_ERROR


def test_calls_overlap_in_order_with_limits():
    def slow(n):
        time.sleep(0.2 if n == 5 else 0.02)
        if n == 7:
            raise RuntimeError("always")
        return n * n

    began = time.time()
    got = list(inference.overlapped(((n,) for n in range(60)), slow, 20, 2, 5))
    assert time.time() - began < 0.9 < 60 * 0.02
    assert got == [(n != 7, n * n if n != 7 else None) for n in range(60)]
    tries = []

    def flaky(n):
        tries.append(n)
        if len(tries) % 3:
            raise RuntimeError("not yet")
        return n

    assert list(inference.overlapped([(1,), (2,)], flaky, 1, 3, None)) == [(True, 1), (True, 2)] and len(tries) == 6
    assert list(inference.overlapped([(5,), (1,)], slow, 1, 1, 0.05))[0] == (False, None)


def test_a_second_run_asks_only_what_is_open(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    calls = str(tmp_path / "calls")

    def fn(messages):
        number = messages[-1]["content"]
        open(f"{calls}/{number}-{uuid.uuid4().hex}", "w").close()
        return "Prediction of user preference: 1"

    schema = "k long, messages_first array<struct<role:string,content:string>>, messages_second array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(i, [("user", str(i))], [("user", str(i))]) for i in range(40)], schema)
    ask = lambda rows: inference.judge(rows, fn, ["k"], in_flight=4)
    some = inference.stored_answers(df.where("k < 25"), ask, ["k"], str(tmp_path / "store"), 4)
    assert some.count() == 25 and len(os.listdir(calls)) == 50
    every = inference.stored_answers(df, ask, ["k"], str(tmp_path / "store"), 4)
    assert sorted(r.k for r in every.collect()) == list(range(40)) and len(os.listdir(calls)) == 80
