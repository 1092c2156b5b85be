"""Batch inference with a caller's model: Spark partitions, batches and records failures."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from pairloom import constants as C
from pairloom.functions.keys import null_safe_join
from pairloom.operators import judging


def overlapped(calls: Iterable[tuple], fn: Callable, in_flight: int, tries: int, seconds: float | None) -> Iterator[tuple[bool, object]]:
    """(ok, result) of fn over argument tuples, in their order, with at most `in_flight` running and as many waiting.

    A call that raises is repeated up to `tries` times.  One whose result is
    waited for longer than `seconds` counts as failed; what it still does is ignored.
    """

    def tried(args: tuple):
        for left in reversed(range(tries)):
            try:
                return fn(*args)
            except Exception:
                if not left:
                    raise

    pool = ThreadPoolExecutor(in_flight)
    waiting: deque = deque()

    def taken() -> tuple[bool, object]:
        try:
            return True, waiting.popleft().result(seconds)
        except Exception:
            return False, None

    try:
        for args in calls:
            if len(waiting) >= 2 * in_flight:
                yield taken()
            waiting.append(pool.submit(tried, args))
        while waiting:
            yield taken()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def judge(
    df: DataFrame,
    fn: Callable[[list], str],
    keys: Sequence[str],
    first: str = "messages_first",
    second: str = "messages_second",
    fold_unparsed: bool = False,
    in_flight: int = 1,
    tries: int = 1,
    seconds: float | None = None,
) -> DataFrame:
    """Calls fn on both message lists of each row and scores the two answers.

    A task has up to `in_flight` calls running at a time, both of a row among
    them; rows keep their order.  A row of which a call fails (after `tries`
    attempts, or `seconds` of waiting) keeps a fixed text and the failed score,
    and is never left out.
    """
    failed_text = C.CALL_FAILED_TEXT
    rows = df.select(*keys, first, second)
    out = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("text_pref_first", T.StringType()),
            T.StructField("text_pref_second", T.StringType()),
            T.StructField("call_failed", T.BooleanType()),
        ]
    )
    key_names = list(keys)

    def ask(batches):
        for batch in batches:
            calls = ((messages,) for pair in zip(batch[first], batch[second]) for messages in pair)
            said = overlapped(calls, fn, in_flight, tries, seconds)
            answers = [
                (a, b, False) if ok and too else (failed_text, failed_text, True) for (ok, a), (too, b) in zip(said, said)
            ]
            result = batch[key_names].copy()
            for place, name in enumerate(("text_pref_first", "text_pref_second", "call_failed")):
                result[name] = [x[place] for x in answers]
            yield result

    answered = rows.mapInPandas(ask, out)
    return judging.score_answers(
        answered, "text_pref_first", "text_pref_second", F.col("call_failed"), fold_unparsed
    )


def stored_answers(df: DataFrame, ask: Callable[[DataFrame], DataFrame], keys: Sequence[str], store: str, parts: int = 16) -> DataFrame:
    """ask(df), in parts that are stored as they are done: a second run asks only for rows that have no answer yet.

    `keys` tell the rows apart, nulls included, and are columns of what `ask`
    returns.  A part looks only into its own folder for what is there.
    """
    spark, keys = df.sparkSession, list(keys)
    place = F.pmod(F.xxhash64(*keys), F.lit(parts))
    for n in range(parts):
        path, part = f"{store}/part={n}", df.where(place == n)
        try:
            known = spark.read.parquet(path).select(*keys)
        except AnalysisException:  # nothing is stored for this part
            known = None
        todo = part if known is None else null_safe_join(part, known, keys, "left_anti")
        if known is None or not todo.isEmpty():
            ask(todo).write.mode("append").parquet(path)
    return spark.read.parquet(store).drop("part")


def embed(
    df: DataFrame,
    fn: Callable[[list], list],
    prompt: str = "prompt",
    batch_size: int = 16,
) -> DataFrame:
    """Adds text, emb (2-D) and error to each group of shots; fn maps prompts to (text, emb) pairs.

    A failing batch, or one with another number of results, marks each of its
    rows with the error and the run goes on.
    """
    out = T.StructType(
        list(df.schema.fields)
        + [
            T.StructField("text", T.StringType()),
            T.StructField("emb", T.ArrayType(T.ArrayType(T.FloatType()))),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            found = []
            for start in range(0, len(batch), batch_size):
                part = list(batch[prompt].iloc[start : start + batch_size])
                try:
                    rows = [(text, [list(map(float, row)) for row in emb], None) for text, emb in fn(part)]
                    if len(rows) != len(part):
                        raise ValueError("the model returned a different number of embeddings")
                except Exception as problem:
                    rows = [(None, None, str(problem))] * len(part)
                found.extend(rows)
            result = batch.copy()
            result["text"], result["emb"], result["error"] = (list(c) for c in zip(*found)) if found else ([], [], [])
            yield result

    return df.mapInPandas(run, out)


def encode(
    df: DataFrame,
    fn: Callable[[list], list],
    keys: Sequence[str] = ("uid",),
    payload: str = "payload",
    batch_size: int = 8,
) -> DataFrame:
    """Adds shape, vals and error to each image; fn maps payloads to arrays.

    A failing batch marks each of its rows with the error and the run goes on.
    """
    rows = df.select(*keys, payload)
    key_names = list(keys)
    out = T.StructType(
        [rows.schema[k] for k in keys]
        + [
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("vals", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches):
        import numpy as np

        for batch in batches:
            shapes, values, errors = [], [], []
            for start in range(0, len(batch), batch_size):
                part = list(batch[payload].iloc[start : start + batch_size])
                try:
                    tensors = [np.asarray(t, dtype="float32") for t in fn(part)]
                    if len(tensors) != len(part):
                        raise ValueError("encoder returned a different number of tensors")
                    shapes += [list(t.shape) for t in tensors]
                    values += [t.ravel() for t in tensors]
                    errors += [None] * len(part)
                except Exception as problem:
                    shapes += [None] * len(part)
                    values += [None] * len(part)
                    errors += [str(problem)] * len(part)
            result = batch[key_names].copy()
            result["shape"], result["vals"], result["error"] = shapes, values, errors
            yield result

    return rows.mapInPandas(run, out)
