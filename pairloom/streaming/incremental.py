"""Incremental forms: new shards, latents and log lines as they arrive."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.operators import assign, distribution
from pairloom.streaming import levels


def _start(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _updates(sink: str, keys: Sequence[str] = ()):
    """Adds each micro-batch to a levelled sink, in which a repeated batch counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        levels.add(batch, batch_id, sink, levels.newest(keys))

    return write


def incremental_assignments(
    embeddings: DataFrame, pool: DataFrame, sink: str, checkpoint: str, k: int = 1, seed: int = 0
) -> StreamingQuery:
    """Assigns held-out pairs to embedding rows of newly arrived shards; finished shards are not read again.

    The pool is ranked once, before the first micro-batch.
    """
    ranked = assign.rank_pool(pool, seed)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = assign.build_assignments(batch, ranked, k=k, seed=seed, on_empty="skip")
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return _start(embeddings, write, checkpoint, "append")


def running_tensor_stats(latents: DataFrame, sink: str, checkpoint: str, values: str = "vals") -> StreamingQuery:
    """Keeps the mergeable tensor statistics up as latents arrive."""
    part = F.col(values)
    sums = latents.groupBy().agg(
        F.sum(F.size(part).cast("bigint")).alias("n"),
        F.sum(X.total(part)).alias("s"),
        F.sum(X.total(part, lambda x: x * x)).alias("q"),
        F.min(F.array_min(X.doubles(part))).alias("lo"),
        F.max(F.array_max(X.doubles(part))).alias("hi"),
    )
    return _start(sums, _updates(sink), checkpoint, "update")


def metric_rollup(log: DataFrame, every: int, columns: Sequence[str], sink: str, checkpoint: str, step: str = "micro_step") -> StreamingQuery:
    """Averages an appended metrics log over accumulation windows."""
    number = F.floor((F.col(step) - 1) / every).cast("bigint") + 1
    windows = log.groupBy(number.alias("optimizer_step")).agg(
        F.count(F.lit(1)).alias("accumulation_count"), *[F.avg(c).alias(c) for c in columns]
    )
    return _start(windows, _updates(sink, ["optimizer_step"]), checkpoint, "update")


# Rank error of a KLL sketch of 2^12 levels' width is below 0.1 %; merging keeps it.
SKETCH_K = 4096
RANK_ERROR = 0.005


def _merged_sketches(rows: DataFrame) -> DataFrame:
    """Sketches and counts of any batches as one row; the order of merging doesn't matter."""
    return rows.agg(
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"),
        *[F.sum(c).alias(c) for c in ("finite_count", "nan_count", "inf_count")],
        F.max(levels.BATCH).alias(levels.BATCH),
    )


def running_quantiles(latents: DataFrame, sink: str, checkpoint: str, values: str = "vals") -> StreamingQuery:
    """Keeps a quantile sketch of all finite values up as latents arrive; NaN and infinite values are counted apart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.explode(X.doubles(F.col(values))).alias("v"))
        finite = F.when(X.is_finite(F.col("v")), F.col("v") + 0.0)
        sketch = flat.agg(
            F.kll_sketch_agg_double(finite, SKETCH_K).alias("sketch"), F.count(finite).alias("finite_count"),
            F.count_if(F.isnan("v")).alias("nan_count"), F.count_if(F.abs("v") == F.lit(X.INF)).alias("inf_count"),
        )
        levels.add(sketch, batch_id, sink, _merged_sketches)

    return _start(latents, write, checkpoint, "append")


def latest_quantiles(spark: SparkSession, sink: str, points: Mapping[str, float] = C.QUANTILES) -> DataFrame:
    """One row: a value for each point whose rank is within RANK_ERROR of it, and the counts."""
    now = levels.current(spark, sink, _merged_sketches)
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return now.select(*[at(q).alias(name) for name, q in points.items()], "finite_count", "nan_count", "inf_count")


def latest(spark: SparkSession, sink: str, keys: Sequence[str] = ()) -> DataFrame:
    """Newest row per key of a sink that received updates."""
    return levels.current(spark, sink, levels.newest(keys))


def latest_tensor_stats(spark: SparkSession, sink: str) -> DataFrame:
    """Current mean, std and range from the running sums."""
    return distribution.finish_running(latest(spark, sink))
