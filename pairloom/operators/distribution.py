"""Summaries of latent tensors, per tensor and over whole groups of tensors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.functions.keys import null_safe_join
from pairloom.functions.tensors import let
from pairloom.session import materialise


def full_stats(values: Column) -> Column:
    """Struct of counts and finite-value statistics of one tensor."""
    count = lambda test: F.size(F.filter(X.doubles(values), test)).cast("bigint")

    def over_finite(finite: Column) -> Column:
        n = F.nullif(F.size(finite), F.lit(0))
        sums = F.struct(
            n.alias("n"), X.mean(finite).alias("mean"), X.total(finite, lambda x: x * x).alias("squares"), X.total(finite, F.abs).alias("abs")
        )
        return X.let(
            sums,
            lambda s: F.struct(
                F.size(values).cast("bigint").alias("numel"),
                F.size(finite).cast("bigint").alias("finite_count"),
                F.coalesce(F.size(finite) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0)).alias("finite_fraction"),
                count(F.isnan).alias("nan_count"),
                count(lambda x: x == F.lit(X.INF)).alias("posinf_count"),
                count(lambda x: x == F.lit(-X.INF)).alias("neginf_count"),
                s["mean"].alias("mean"),
                X.population_std(finite, s["mean"]).alias("std"),
                F.array_min(finite).alias("min"),
                F.array_max(finite).alias("max"),
                (s["abs"] / s["n"]).alias("abs_mean"),
                F.sqrt(s["squares"] / s["n"]).alias("rms"),
                F.sqrt(s["squares"]).alias("l2_norm"),
            ),
        )

    return X.let(X.finite_only(values), over_finite)


def with_full_stats(df: DataFrame, values: str = "vals") -> DataFrame:
    """Adds the full statistics of each tensor as columns."""
    rows = df.withColumn("__s", full_stats(F.col(values)))
    return rows.select(*df.columns, "__s.*")


def merge_moments(states: DataFrame, keys: Sequence[str] = (), state: str = "m") -> DataFrame:
    """keys, n, mean, m2, rest: the states of each group merged into one (see tensors.moments).

    Means are merged first; then each state moves its sums to the merged mean,
    so nothing large is subtracted from something as large.  The result may be
    merged again.  `states` should be stored: it is read twice.  Null keys are
    keys.
    """
    keys = list(keys)
    part = states.select(*keys, f"{state}.*")
    weight = F.sum("n")
    means = part.groupBy(*keys).agg(weight.alias("__n"), (F.sum(F.col("mean") * F.col("n")) / F.nullif(weight, F.lit(0))).alias("__mean"))
    joined = null_safe_join(part, means, keys) if keys else part.withColumns({c: means.select(c).scalar() for c in ("__n", "__mean")})
    apart = F.coalesce(F.col("mean") - F.col("__mean"), F.lit(0.0))
    out = joined.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.max("__mean").alias("mean"),
        F.sum(F.col("m2") + 2 * apart * F.col("rest") + F.col("n") * apart * apart).alias("m2"),
        F.sum(F.col("rest") + F.col("n") * apart).alias("rest"),
    )
    return out if keys else out.where("n IS NOT NULL")


def merged_mean() -> Column:
    """Mean of a merged state; null without values."""
    return F.col("mean") + F.col("rest") / F.nullif(F.col("n"), F.lit(0))


def merged_std() -> Column:
    """Population std of a merged state; null without values."""
    n = F.nullif(F.col("n"), F.lit(0))
    return F.sqrt(F.greatest(F.col("m2") - F.col("rest") * F.col("rest") / n, F.lit(0.0)) / n)


def group_stats(df: DataFrame, keys: Sequence[str] = (), values: str = "vals") -> DataFrame:
    """Statistics of all tensors of a group together, over their finite values, with counts of the others.

    Each tensor becomes a few numbers before any shuffle; mean and spread are
    merged as moments, so values far from zero lose no digits.
    """
    keys = list(keys)
    part = X.doubles(F.col(values))
    finite = F.filter(part, X.is_finite)
    rows = materialise(df.select(
        *keys,
        F.size(part).cast("bigint").alias("total"),
        F.size(F.filter(part, F.isnan)).cast("bigint").alias("nan"),
        let(finite, lambda x: F.struct(
            X.moments(x).alias("m"), X.total(x, lambda v: v * v).alias("q"), X.total(x, F.abs).alias("a"),
            F.array_min(x).alias("lo"), F.array_max(x).alias("hi"),
        )).alias("f"),
    ))
    sums = rows.groupBy(*keys).agg(
        F.sum("total").alias("total_count"), F.sum("nan").alias("nan_count"), F.sum("f.q").alias("q"), F.sum("f.a").alias("a"),
        F.min("f.lo").alias("min_value"), F.max("f.hi").alias("max_value"),
    )
    merged = merge_moments(rows.select(*keys, "f.m"), keys)
    both = null_safe_join(sums, merged, keys) if keys else sums.withColumns({c: merged.select(c).scalar() for c in ("n", "mean", "m2", "rest")})
    n = F.nullif(F.col("n"), F.lit(0))
    return both.select(
        *keys, "total_count", "nan_count", (F.col("total_count") - F.col("nan_count") - F.col("n")).alias("inf_count"),
        F.col("n").alias("finite_count"), "min_value", "max_value", merged_mean().alias("mean_value"),
        merged_std().alias("std_value"), (F.col("a") / n).alias("mean_abs"), F.sqrt("q").alias("l2_norm"),
    )


def finite_flags(values: Column) -> Column:
    """has_nan, has_inf and all_finite of one tensor."""
    return F.struct(
        X.has_nan(values).alias("has_nan"), X.has_inf(values).alias("has_inf"), X.all_finite(values).alias("all_finite")
    )


def flat_values(df: DataFrame, keys: Sequence[str], values: str = "vals") -> DataFrame:
    """One row per tensor element, produced and consumed inside one stage."""
    return df.select(*keys, F.posexplode(X.doubles(F.col(values))).alias("pos", "v"))


def running_stats(df: DataFrame, keys: Sequence[str] = (), values: str = "vals") -> DataFrame:
    """Mergeable statistics: counts and sums per tensor, folded over the group.

    Each tensor becomes five numbers before any shuffle.  The variance is that
    of the sums, q / n - mean^2, as the format of the running numbers has it: it
    loses as many digits as the mean's square is larger than the variance.
    `group_stats` has no such loss.
    """
    part = F.col(values)
    rows = df.select(
        *keys,
        F.size(part).cast("bigint").alias("n"),
        X.total(part).alias("s"),
        X.total(part, lambda x: x * x).alias("q"),
        F.array_min(X.doubles(part)).alias("lo"),
        F.array_max(X.doubles(part)).alias("hi"),
    )
    return finish_running(
        rows.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        )
    )


def finish_running(sums: DataFrame) -> DataFrame:
    """Mean and std from the five running numbers; the variance is floored at 0."""
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    kept = [c for c in sums.columns if c not in ("n", "s", "q", "lo", "hi")]
    return sums.select(
        *kept,
        F.col("n").alias("total_count"),
        F.col("lo").alias("min_value"),
        F.col("hi").alias("max_value"),
        mean.alias("mean_value"),
        F.sqrt(variance).alias("std_value"),
    )


def quantiles(
    df: DataFrame, keys: Sequence[str] = (), values: str = "vals", points: Mapping[str, float] = C.QUANTILES
) -> DataFrame:
    """Exact quantiles with linear interpolation over the finite values of each group.

    Equal values are folded first.  A value's order-preserving bucket follows
    from its size on a logarithmic scale, 32 buckets to an octave, so a bucket
    holds at most 2^18 distinct single-precision values however large the group
    is.  Counts below a value are a total over buckets plus one inside its own.
    """
    keys = list(keys)
    flat = df.select(*keys, F.explode(X.doubles(F.col(values))).alias("v")).filter(X.is_finite(F.col("v")))
    # Adding zero folds -0.0 into 0.0.
    counted = flat.select(*keys, (F.col("v") + 0.0).alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    level = F.floor(F.log2(F.abs(F.col("v"))) * 32).cast("bigint") + 40000
    bucket = F.when(F.col("v") > 0, level).when(F.col("v") < 0, -level).otherwise(F.lit(0).cast("bigint"))
    # Read twice below; it holds one row per distinct value.
    counted = materialise(counted.withColumn("__b", bucket))
    spot = [*keys, "__b"]
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = (
        counted.groupBy(*spot)
        .agg(F.sum("n").alias("__m"))
        .withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__m").over(whole))
        .drop("__m")
    )
    inside = Window.partitionBy(*spot).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__lo", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sizes, spot)
    low = F.col("__before") + F.col("__lo")
    ranked = ranked.withColumn("__lo", low).withColumn("__hi", low + F.col("n"))
    at = lambda q: (F.col("__total") - 1) * F.lit(q)
    holds = lambda place: (F.col("__lo") <= place) & (place < F.col("__hi"))
    cells = []
    for name, q in points.items():
        cells.append(F.max(F.when(holds(F.floor(at(q))), F.col("v"))).alias(f"__f_{name}"))
        cells.append(F.max(F.when(holds(F.ceil(at(q))), F.col("v"))).alias(f"__c_{name}"))
    found = ranked.groupBy(*keys).agg(*cells, F.max("__total").alias("__total"))
    blend = [
        (F.col(f"__f_{name}") + (F.col(f"__c_{name}") - F.col(f"__f_{name}")) * (at(q) - F.floor(at(q)))).alias(name)
        for name, q in points.items()
    ]
    return found.select(*keys, *blend)


def with_quantiles(df: DataFrame, values: str = "vals", points: Mapping[str, float] = C.QUANTILES) -> DataFrame:
    """Adds the exact quantiles of each tensor's finite values, sorted inside the row; null where it has none."""

    def at(ordered: Column, q: float) -> Column:
        place = (F.size(ordered) - 1) * F.lit(q)
        low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    # Adding zero folds -0.0 into 0.0.
    finite = F.transform(F.filter(X.doubles(F.col(values)), X.is_finite), lambda v: v + 0.0)
    found = let(F.array_sort(finite), lambda ordered: F.struct(*[at(ordered, q).alias(n) for n, q in points.items()]))
    return df.withColumn("__q", found).select(*df.columns, "__q.*")


def _part_summary(rows: DataFrame, keys: Sequence[str], parts: Column, name: str, prefix: str) -> DataFrame:
    """Mean and std over the states that `parts` (an array) has at each place."""
    states = materialise(rows.select(*keys, F.posexplode(parts).alias("__at", "m")).withColumn(name, F.col("__at").cast("bigint")).drop("__at"))
    merged = merge_moments(states, [*keys, name])
    return merged.select(*keys, name, merged_mean().alias(f"{prefix}_mean"), merged_std().alias(f"{prefix}_std"))


def channel_summary(df: DataFrame, keys: Sequence[str] = (), values: str = "vals", shape: str = "shape") -> DataFrame:
    """Mean and std of every channel over samples and space; non-finite counts as 0.

    A tensor gives one state per channel, whatever its size.
    """
    size = F.element_at(shape, 2) * F.element_at(shape, 3)
    rows = df.where((F.size(values) > 0) & (size > 0)).select(*keys, size.cast("int").alias("__hw"), X.zero_bad(F.col(values)).alias("__v"))
    starts = F.sequence(F.lit(1), F.size("__v"), F.col("__hw"))
    states = F.transform(starts, lambda at: X.moments(F.slice("__v", at, F.col("__hw"))))
    return _part_summary(rows, keys, states, "channel", "channel")


def spatial_summary(df: DataFrame, keys: Sequence[str] = (), values: str = "vals", shape: str = "shape") -> DataFrame:
    """Mean and std of every spatial position over samples and channels; non-finite counts as 0.

    A tensor gives one state per position, whatever its number of channels.
    """
    size = F.element_at(shape, 2) * F.element_at(shape, 3)
    rows = df.where((F.size(values) > 0) & (size > 0)).select(*keys, size.cast("int").alias("__hw"), X.zero_bad(F.col(values)).alias("__v"))
    places = F.sequence(F.lit(0), F.least(F.col("__hw"), F.size("__v")) - 1)
    column = lambda p: F.transform(F.sequence(p, F.size("__v") - 1, F.col("__hw")), lambda i: F.get("__v", i))
    return _part_summary(rows, keys, F.transform(places, lambda p: X.moments(column(p))), "position", "spatial")


def summary_of(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """mean, std, min and max of summary columns."""
    out = []
    for c in columns:
        out += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.groupBy(*keys).agg(*out)


def shared_histogram(df: DataFrame, group: str, groups: tuple[str, str], bins: int = 80, values: str = "vals") -> DataFrame:
    """Counts of two groups over bins of their joint range, one row per bin.

    Equal ends are widened by a half each way; the top edge belongs to the last bin.
    """
    part = X.finite_only(F.col(values))
    ends = df.filter(F.col(group).isin(*groups)).agg(
        F.min(F.array_min(part)).alias("lo"), F.max(F.array_max(part)).alias("hi")
    )
    close = F.abs(F.col("hi") - F.col("lo")) <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo"))
    ends = ends.select(
        F.when(close, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(close, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    flat = df.filter(F.col(group).isin(*groups)).select(group, F.explode(part).alias("v"))
    bin_of = F.least(F.width_bucket(F.col("v"), lo, hi, F.lit(bins)), F.lit(bins)) - 1
    counts = (
        flat.groupBy(bin_of.cast("bigint").alias("bin"))
        .agg(*[F.count_if(F.col(group) == g).alias(f"count_{i}") for i, g in enumerate(groups)])
    )
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    step = (hi - lo) / bins
    return (
        every.join(counts, "bin", "left")
        .fillna(0)
        .select(
            "bin",
            (lo + step * F.col("bin")).alias("bin_left"),
            (lo + step * (F.col("bin") + 1)).alias("bin_right"),
            F.col("count_0").alias("prior_count"),
            F.col("count_1").alias("precomputed_count"),
        )
    )


def calibrate_channels(
    df: DataFrame, source: DataFrame, target: DataFrame, eps: float = 1e-6, values: str = "vals", shape: str = "shape"
) -> DataFrame:
    """Moves each channel from the source's mean and std to the target's.

    Both statistics have one row per channel, so together they are one small
    map, and the tensors are rewritten in place without a shuffle.  A tensor with
    a channel that one of them lacks is an error.
    """
    at_least = lambda c: F.greatest(F.col(c), F.lit(eps))
    moves = source.select("channel", F.col("channel_mean").alias("m"), at_least("channel_std").alias("s")).join(
        target.select("channel", F.col("channel_mean").alias("tm"), at_least("channel_std").alias("ts")), "channel"
    )
    # x -> scale * x + shift
    scale = F.col("ts") / F.col("s")
    move_type = "struct<scale:double,shift:double>"
    row = F.struct(F.col("channel").cast("bigint"), F.struct(scale.alias("scale"), (F.col("tm") - F.col("m") * scale).alias("shift")).cast(move_type))
    listed = moves.agg(F.map_from_entries(F.collect_list(row)).alias("a")).scalar()
    size = F.element_at(shape, 2) * F.element_at(shape, 3)

    def moved(x: Column, i: Column) -> Column:
        move = F.try_element_at(F.col("__moves"), F.floor(i / size).cast("bigint"))
        missing = F.raise_error(F.lit("a channel has no statistics on one of the sides")).cast("double")
        return F.when(move.isNull(), missing).otherwise(x * move["scale"] + move["shift"])

    rows = df.withColumn("__moves", listed)
    return rows.withColumn(values, F.transform(X.doubles(F.col(values)), moved)).drop("__moves")


def residual_summary(rows: DataFrame, block: str = "module_path", order: str = "ord") -> DataFrame:
    """Calls, max and mean ratio per block and overall ('all'), with each block's last scales."""
    return (
        rows.rollup(block)
        .agg(
            F.grouping(block).alias("__all"),
            F.count(F.lit(1)).alias("num_calls"),
            F.max("residual_ratio").alias("max_residual_ratio"),
            F.avg("residual_ratio").alias("mean_residual_ratio"),
            F.max_by("checkpoint_user_scale", order).alias("checkpoint_user_scale"),
            F.max_by("inference_user_scale", order).alias("inference_user_scale"),
        )
        .select(
            F.when(F.col("__all") == 1, "all").otherwise(F.col(block)).alias(block),
            "num_calls",
            "max_residual_ratio",
            "mean_residual_ratio",
            F.when(F.col("__all") == 0, F.col("checkpoint_user_scale")).alias("checkpoint_user_scale"),
            F.when(F.col("__all") == 0, F.col("inference_user_scale")).alias("inference_user_scale"),
        )
    )
