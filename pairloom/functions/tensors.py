"""Column expressions over tensors held as flat arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

INF = float("inf")


def let(value: Column, body) -> Column:
    """The body over a value that is computed once per row.

    A column used inside an array lambda is evaluated again for every element;
    what costs more than a field access is bound here first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def total(values: Column, term=lambda x: x) -> Column:
    """Sum of a term over an array."""
    return F.aggregate(doubles(values), F.lit(0.0), lambda acc, x: acc + term(x))


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values), F.lit(0))


def l2_norm(values: Column) -> Column:
    return F.sqrt(total(values, lambda x: x * x))


def population_std(values: Column, centre: Column) -> Column:
    """Std around a given mean."""
    return let(
        centre,
        lambda c: F.sqrt(total(values, lambda x: (x - c) * (x - c)) / F.nullif(F.size(values), F.lit(0))),
    )


def moments(values: Column) -> Column:
    """Mergeable state (n, mean, m2, rest) of an array; no values give (0, null, 0, 0).

    m2 and rest are the sums of squared and of plain distances from `mean`; rest
    is what rounding the mean leaves.
    """

    def around(v: Column) -> Column:
        return let(
            mean(v),
            lambda m: F.struct(
                F.size(v).cast("bigint").alias("n"), m.alias("mean"), total(v, lambda x: (x - m) * (x - m)).alias("m2"), total(v, lambda x: x - m).alias("rest")
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, around(v)).otherwise(
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("m2"), F.lit(0.0).alias("rest"))
    ))


def finite_only(values: Column) -> Column:
    return F.filter(doubles(values), is_finite)


def zero_bad(values: Column) -> Column:
    """Non-finite values replaced by 0."""
    return F.transform(doubles(values), lambda x: F.when(is_finite(x), x).otherwise(F.lit(0.0)))


def has_nan(values: Column) -> Column:
    return F.exists(doubles(values), F.isnan)


def has_inf(values: Column) -> Column:
    return F.exists(doubles(values), lambda x: F.abs(x) == F.lit(INF))


def all_finite(values: Column) -> Column:
    return F.forall(doubles(values), is_finite)


def shape_equals(shape: Column, expected: Sequence[int]) -> Column:
    return F.coalesce(shape.cast("array<bigint>") == F.array(*[F.lit(d).cast("bigint") for d in expected]), F.lit(False))


def channel_of(position: Column, height: Column, width: Column) -> Column:
    """Channel of a flat position in a channel-first tensor."""
    return F.floor(position / (height * width)).cast("bigint")


def add_one_div_42(values: Column) -> Column:
    """The optional scaling of stored latents."""
    return F.transform(doubles(values), lambda x: (x + 1) / 42)


# Ways a scaled tensor is varied.
VARIANTS = {
    "scaled": lambda x: x,
    "unscaled": lambda x: x * 42 - 1,
    "x42": lambda x: x * 42,
    "x10": lambda x: x * 10,
    "x2": lambda x: x * 2,
    "div2": lambda x: x / 2,
}


def variant(values: Column, name: str) -> Column:
    if name not in VARIANTS:
        raise ValueError(f"unknown variant {name}")
    return F.transform(doubles(values), VARIANTS[name])


def differences(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def pair_metrics(a: Column, b: Column, shape_a: Column | None = None, shape_b: Column | None = None) -> Column:
    """Struct of distances between two tensors; null with same_shape=false on a mismatch.

    Without shapes only the lengths are compared.
    """
    same = F.size(a) == F.size(b)
    if shape_a is not None and shape_b is not None:
        same &= F.coalesce(shape_a.cast("array<int>") == shape_b.cast("array<int>"), F.lit(False))
    gap = differences(a, b)
    dot = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    parts = F.struct(
        F.sqrt(total(gap, lambda x: x * x)).alias("l2"),
        total(gap, F.abs).alias("abs_sum"),
        F.array_max(F.transform(gap, F.abs)).alias("abs_max"),
        dot.alias("dot"),
        l2_norm(a).alias("a"),
        l2_norm(b).alias("b"),
        F.nullif(F.size(a), F.lit(0)).alias("n"),
    )
    return let(
        F.when(same, parts),
        lambda p: F.struct(
            p.isNotNull().alias("same_shape"),
            p["l2"].alias("l2_norm"),
            (p["l2"] / (p["a"] + 1e-12)).alias("relative_delta_norm"),
            (p["abs_sum"] / p["n"]).alias("mean_abs_diff"),
            p["abs_max"].alias("max_abs_diff"),
            (p["l2"] / F.sqrt(p["n"])).alias("rmse"),
            (p["dot"] / F.greatest(p["a"] * p["b"], F.lit(1e-8))).alias("cosine_similarity"),
        ),
    )


def mean_squared_error(prediction: Column, target: Column) -> Column:
    gap = differences(prediction, target)
    return F.when(F.size(prediction) == F.size(target), total(gap, lambda x: x * x) / F.size(target))


def neg_log_sigmoid(z: Column) -> Column:
    """-log(sigmoid(z)) without overflow."""
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_sum_exp(logits: Column) -> Column:
    return let(
        F.array_max(doubles(logits)),
        lambda top: top + F.log(total(logits, lambda x: F.exp(x - top))),
    )


def softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda norm: F.transform(doubles(logits), lambda x: F.exp(x - norm)))


def true_class_rank(logits: Column, label: Column) -> Column:
    """1-based rank of the true class; equal logits rank by index."""

    def rank(own: Column) -> Column:
        ahead = F.transform(
            doubles(logits), lambda x, i: F.when((x > own) | ((x == own) & (i < label)), 1).otherwise(0)
        )
        return F.aggregate(ahead, F.lit(1), lambda acc, x: acc + x)

    return let(F.element_at(doubles(logits), (label + 1).cast("int")), rank)


def top_classes(logits: Column, k: int) -> Column:
    """Indices of the k largest logits; equal ones by index."""
    marked = F.transform(doubles(logits), lambda x, i: F.struct((-x).alias("neg"), i.alias("class_id")))
    return F.transform(F.slice(F.array_sort(marked), 1, k), lambda s: s["class_id"])
