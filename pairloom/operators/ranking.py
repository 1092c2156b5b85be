"""Dense positions and running totals without a one-task group.

A plain ranking window sends every row of a key to one task, so a key with a
third of all rows stalls the job.  Here each key is cut into ordered buckets:
rows are ranked inside (key, bucket), bucket sizes are pre-aggregated, and a
running total over the few buckets of a key supplies the offset.  The result is
exactly the rank the plain window would give.  Where keys are counted first, only
heavy ones are cut; the others, however many, take the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pairloom.functions import keys as K
from pairloom.functions.keys import null_safe_join
from pairloom.session import materialise

BUCKET = "__bucket"
BEFORE = "__before"
SPOT = "__spot__bucket"
KEY = "__key"
WIDTH = 1 << 20
# Leading hex digits of a digest that name a bucket: 65,536 of them per key.
DIGITS = 4
# A key with more rows than this is heavy.
HEAVY = 1 << 16


def _offset_ranks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None
) -> DataFrame:
    # Keys and bucket in one value, which is never null and equals itself where a key is null: the
    # join then finds the rows dealt out and sorted as the window left them.
    spot = F.struct(*[F.col(c) for c in (*keys, BUCKET)]).alias(SPOT)
    rest = [c for c in df.columns if c not in (*keys, BUCKET)]
    sizes = df.groupBy(spot).agg(F.count(F.lit(1)).alias("__size"))
    # Columns of their own, so that both windows share one exchange.
    same = [f"__key_{n}" for n in range(len(keys))]
    sizes = sizes.withColumns({name: F.col(SPOT)[c] for name, c in zip(same, keys)})
    earlier = Window.partitionBy(*same).orderBy(F.col(SPOT)[BUCKET]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(BEFORE, F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__size").over(Window.partitionBy(*same)))
    offsets = offsets.drop("__size", *same)
    inside = Window.partitionBy(SPOT).orderBy(*order)
    return (
        df.select(spot, *rest)
        .withColumn(name, F.row_number().over(inside).cast("bigint") - 1)
        .join(offsets, SPOT)
        .withColumn(name, F.col(name) + F.col(BEFORE))
        .select(*[F.col(SPOT)[c].alias(c) if c in keys else c for c in df.columns if c != BUCKET], name, *([total] if total else []))
    )


def apart(rows: DataFrame, keys: Sequence[str], counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of light keys, rows of heavy keys or None if there are none); null keys are a key.

    `counts` may be any (keys, __rows) that are not below the numbers of rows.
    Heavy keys are few and stored, so the planner knows how few.
    """
    key = F.struct(*[F.col(k) for k in keys]).alias(KEY)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    heavy = materialise(counts.filter(F.col("__rows") > HEAVY).select(key))
    if heavy.isEmpty():
        return rows, None
    marked = rows.select("*", key)
    return marked.join(heavy, KEY, "left_anti").drop(KEY), marked.join(heavy, KEY, "left_semi").drop(KEY)


def plain_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """0-based place of each row among its key's rows, for light keys: a key is ranked in one task."""
    own = Window.partitionBy(*keys)
    placed = df.withColumn(name, F.row_number().over(own.orderBy(*order)).cast("bigint") - 1)
    return placed.withColumn(total, F.count(F.lit(1)).over(own)) if total else placed


def light_window(keys: Sequence[str]) -> WindowSpec:
    """The window of a light key over rows that have its prefix, where what follows isn't grouped by the key itself."""
    return Window.partitionBy(K.PREFIX, *keys)


def bucket_positions(
    df: DataFrame, keys: Sequence[str], digest: str, tie: Sequence[str], name: str, digits: int = DIGITS, total: str | None = None
) -> DataFrame:
    """0-based place of each row among its key's rows in digest order, for keys of any size.

    The leading hex digits of the digest are the bucket: they are uniform, so a
    key spreads over 16^digits groups.
    """
    bucketed = df.withColumn(BUCKET, F.substring(F.col(digest), 1, digits))
    return _offset_ranks(bucketed, keys, [F.col(digest), *[F.col(t) for t in tie]], name, total)


def position_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    tie: Sequence[str],
    name: str,
    digits: int = DIGITS,
    total: str | None = None,
) -> DataFrame:
    """0-based place of each row among its key's rows in digest order; null keys are a key.

    Keys are counted first: light ones take the plain window, heavy ones buckets.
    `total` names a column for the key's row count, which comes along for free.
    """
    light, heavy = apart(df, keys)
    placed = plain_positions(light, keys, [F.col(digest), *[F.col(t) for t in tie]], name, total)
    return placed if heavy is None else placed.unionByName(bucket_positions(heavy, keys, digest, tie, name, digits, total))


def position_by_ordinal(
    df: DataFrame, keys: Sequence[str], ordinal: str, name: str, width: int = WIDTH, tie: Sequence[str] = ()
) -> DataFrame:
    """0-based place of each row among its key's rows in ordinal order; null keys are a key, null ordinals come first.

    The ordinal is an integer that is unique up to the tie columns, so a bucket
    of `width` consecutive ordinals bounds the rows of one group.
    """
    bucketed = df.withColumn(BUCKET, F.floor(F.col(ordinal) / F.lit(width)).cast("bigint"))
    return _offset_ranks(bucketed, keys, [F.col(ordinal), *[F.col(t) for t in tie]], name)


def position_by_sort(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based place of each row in a total order of any type.

    A range-partitioned sort does the work; the sorted rows are materialised
    once, so that partition sizes and rows come from the same sort.
    """
    marked = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    marked = marked.withColumn(BUCKET, F.shiftright("__at", 33)).withColumn(
        "__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = marked.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(BEFORE, F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        marked.join(offsets, BUCKET)
        .withColumn(name, F.col("__at") + F.col(BEFORE))
        .drop("__at", BUCKET, BEFORE)
    )


_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    ordinal: str,
    specs: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    inclusive: bool = True,
    width: int = WIDTH,
) -> DataFrame:
    """Running sum, min or max in ordinal order; `specs` maps name -> (kind, column).

    Exclusive running values are null on the first row.
    """
    keys = list(keys)
    spot = [*keys, BUCKET]
    bucketed = df.withColumn(BUCKET, F.floor(F.col(ordinal) / F.lit(width)).cast("bigint"))
    partial = bucketed.groupBy(*spot).agg(
        *[_COMBINE[kind](column).alias(f"__{name}") for name, (kind, column) in specs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = partial.select(
        *spot, *[_COMBINE[kind](f"__{name}").over(earlier).alias(f"__{name}") for name, (kind, _) in specs.items()]
    )
    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*spot).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, end)
    out = bucketed.withColumns(
        {name: _COMBINE[kind](column).over(inside) for name, (kind, column) in specs.items()}
    ).transform(null_safe_join, carried, spot)
    merged = {}
    for name, (kind, _) in specs.items():
        here, before = F.col(name), F.col(f"__{name}")
        if kind == "sum":
            merged[name] = F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
        elif kind == "min":
            merged[name] = F.least(here, before)
        else:
            merged[name] = F.greatest(here, before)
    return out.withColumns(merged).drop(BUCKET, *[f"__{name}" for name in specs])
