"""Classifier, preference-loss and training-log metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.operators.ranking import WIDTH, position_by_ordinal, running


def classifier_metrics(df: DataFrame, logits: str = "logits", label: str = "class_id", top_k: Sequence[int] = C.TOP_K) -> DataFrame:
    """Adds cross-entropy, probability of the true class and top-k hits to each row."""
    own = F.element_at(X.doubles(F.col(logits)), (F.col(label) + 1).cast("int"))
    loss = X.log_sum_exp(F.col(logits)) - own
    rank = X.true_class_rank(F.col(logits), F.col(label))
    rows = df.withColumn("loss", loss).withColumn("desired_prob", F.exp(-F.col("loss"))).withColumn("__rank", rank)
    return rows.withColumns(
        {f"top{k}": F.when(F.col("__rank") <= k, 1.0).otherwise(0.0) for k in top_k}
    ).drop("__rank")


def mean_of_batch_means(
    rows: DataFrame, columns: Sequence[str], batch: str = "batch_id", max_batches: int | None = None
) -> DataFrame:
    """Metrics averaged in each batch, then over the batches (the first max_batches of them)."""
    per_batch = rows.groupBy(batch).agg(*[F.avg(c).alias(c) for c in columns])
    if max_batches is not None:
        per_batch = per_batch.orderBy(batch).limit(max_batches)
    return per_batch.agg(F.count(F.lit(1)).alias("num_batches"), *[F.avg(c).alias(c) for c in columns])


def preference_errors(df: DataFrame, target: str = "target") -> DataFrame:
    """Mean squared error of the four predictions against the target."""
    return df.withColumns(
        {
            f"{name}_err": X.mean_squared_error(F.col(name), F.col(target))
            for name in ("train_pref", "train_dispref", "ref_pref", "ref_dispref")
        }
    )


def preference_score() -> Column:
    """How much more training helped the preferred than the dispreferred side."""
    return (F.col("ref_pref_err") - F.col("train_pref_err")) - (F.col("ref_dispref_err") - F.col("train_dispref_err"))


def with_preference_loss(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds score and loss to rows that carry the four errors."""
    return df.withColumn("score", preference_score()).withColumn(
        "loss", X.neg_log_sigmoid(F.lit(float(beta)) * F.col("score"))
    )


def preference_loss(df: DataFrame, keys: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Mean errors, score and loss."""
    names = ["train_pref_err", "train_dispref_err", "ref_pref_err", "ref_dispref_err", "score", "loss"]
    return with_preference_loss(df, beta).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), *[F.avg(n).alias(n) for n in names]
    )


def step_windows(log: DataFrame, every: int, columns: Sequence[str] = C.STEP_METRICS, step: str = "micro_step") -> DataFrame:
    """Metrics averaged over each accumulation window of `every` micro steps; the last may be short."""
    number = F.floor((F.col(step) - 1) / every).cast("bigint") + 1
    return log.groupBy(number.alias("optimizer_step")).agg(
        F.count(F.lit(1)).alias("accumulation_count"), *[F.avg(c).alias(c) for c in columns]
    )


def validation_summary(
    batches: DataFrame, columns: Sequence[str], order: str, max_batches: int | None = None, keys: Sequence[str] = (), width: int = WIDTH
) -> DataFrame:
    """Mean over the first max_batches validation batches of each run, or over all of them."""
    ranked = batches
    if max_batches is not None:
        ranked = position_by_ordinal(batches, list(keys), order, "__p", width).filter(F.col("__p") < max(1, max_batches))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("val_batches"), *[F.avg(c).alias(f"val_{c}") for c in columns]
    )


def running_best(log: DataFrame, order: str, value: str = "val_loss", width: int = WIDTH) -> DataFrame:
    """Best value before each row, and whether the row improves on it."""
    rows = running(log, order, {"best_before": ("min", value)}, inclusive=False, width=width)
    better = F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))
    return rows.withColumn("improved", better)


def running_totals(
    log: DataFrame,
    order: str,
    batch_size: str = "batch_size",
    grad_norm: str = "grad_norm",
    memory: str = "reserved_mb",
    width: int = WIDTH,
) -> DataFrame:
    """Samples seen, largest gradient norm and largest memory up to each step."""
    return running(
        log,
        order,
        {
            "samples_seen": ("sum", batch_size),
            "max_grad_norm_observed": ("max", grad_norm),
            "max_mem_reserved_mb": ("max", memory),
        },
        width=width,
    )
