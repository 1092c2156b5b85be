"""From raw preference rows to a pool of resolved pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from pairloom.functions import keys as K

# One row's checks run in this order and the first failure is its reason.
REASONS = (
    "has_label_false",
    "are_different_false",
    "missing_user_id",
    "missing_caption",
    "missing_image_0_uid",
    "missing_image_1_uid",
    "missing_best_image_uid",
    "best_uid_mismatch",
)
TEXT = "__text_"


def flag_reason(
    df: DataFrame,
    require_has_label: bool = True,
    require_are_different: bool = True,
    has_label: str = "has_label",
    are_different: str = "are_different",
) -> Column:
    """Reason code of the label tests; a test whose column is absent is skipped."""
    tests = []
    for wanted, column, reason in (
        (require_has_label, has_label, REASONS[0]),
        (require_are_different, are_different, REASONS[1]),
    ):
        if wanted and column in df.columns:
            truth = K.bool_like(F.col(column), df.schema[column].dataType)
            tests.append(F.when(~truth, F.lit(reason)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def label_filter(
    df: DataFrame,
    require_has_label: bool = True,
    require_are_different: bool = True,
    has_label: str = "has_label",
    are_different: str = "are_different",
) -> DataFrame:
    """Rows whose label flags hold; a boolean flag is a bare predicate the scan can apply."""
    for wanted, column in ((require_has_label, has_label), (require_are_different, are_different)):
        if wanted and column in df.columns:
            dtype = df.schema[column].dataType
            df = df.filter(F.col(column) if isinstance(dtype, T.BooleanType) else K.bool_like(F.col(column), dtype))
    return df


def resolve_strict(best: Column, first: Column, second: Column) -> Column:
    """(preferred, dispreferred) by the best uid; null when it matches neither."""
    side = lambda p, d: F.struct(p.alias("preferred_uid"), d.alias("dispreferred_uid"))
    return F.when(best == first, side(first, second)).when(best == second, side(second, first))


def resolve_lenient(best: Column, first: Column, second: Column) -> Column:
    """(preferred, dispreferred): whatever is not the first image counts as the second."""
    hit = F.coalesce(best == first, F.lit(False))
    return F.struct(
        F.when(hit, first).otherwise(second).alias("preferred_uid"),
        F.when(hit, second).otherwise(first).alias("dispreferred_uid"),
    )


def with_reason(
    df: DataFrame,
    user_id: str = "user_id",
    caption: str = "caption",
    image_0_uid: str = "image_0_uid",
    image_1_uid: str = "image_1_uid",
    best_image_uid: str = "best_image_uid",
    **flag_options,
) -> DataFrame:
    """Adds `reason`: null for a usable row, else its first failed check."""
    checks = [flag_reason(df, **flag_options)]
    fields = (user_id, caption, image_0_uid, image_1_uid, best_image_uid)
    for column, reason in zip(fields, REASONS[2:7]):
        checks.append(F.when(K.is_missing(F.col(column)), F.lit(reason)))
    best, first, second = (K.strip(F.col(c)) for c in (best_image_uid, image_0_uid, image_1_uid))
    checks.append(F.when(~best.isin(first, second), F.lit(REASONS[7])))
    return df.withColumn("reason", F.coalesce(*checks))


def pool_records(
    df: DataFrame,
    include_fields: Sequence[str] = (),
    user_id: str = "user_id",
    caption: str = "caption",
    image_0_uid: str = "image_0_uid",
    image_1_uid: str = "image_1_uid",
    best_image_uid: str = "best_image_uid",
) -> DataFrame:
    """Pool rows of already checked preference rows; extra fields become `field__<name>`."""
    names = (user_id, best_image_uid, image_0_uid, image_1_uid)
    return _records(df, caption, include_fields, *[K.strip(F.col(c)) for c in names])


def _records(
    df: DataFrame, caption: str, include_fields: Sequence[str], user: Column, best: Column, first: Column, second: Column
) -> DataFrame:
    # The best uid is known to be one of the two here, so it is the preferred one.
    return df.select(
        user.alias("user_id"),
        best.alias("preferred_uid"),
        F.when(best == first, second).otherwise(first).alias("dispreferred_uid"),
        F.col(caption).cast("string").alias("caption"),
        F.col("row_idx").alias("pair_idx"),
        F.concat_ws(":", F.col("split"), F.col("row_idx").cast("string")).alias("pair_key"),
        F.col("row_idx").alias("source_row_idx"),
        F.col("split").alias("source_split"),
        best.alias("best_image_uid"),
        first.alias("image_0_uid"),
        second.alias("image_1_uid"),
        *[F.col(f).alias(f"field__{f}") for f in include_fields if f in df.columns],
    )


def build_pool(
    df: DataFrame, include_fields: Sequence[str] = (), strict: bool = False, flag_options: dict | None = None, **columns
) -> DataFrame:
    """Filter, check and resolve; strict fails on a malformed row instead of dropping it.

    Rows dropped by the label flags are never an error.
    """
    labelled = label_filter(df, **(flag_options or {}))
    if strict:
        marked = with_reason(labelled, **columns, require_has_label=False, require_are_different=False)
        message = F.concat(F.lit("malformed row: "), F.col("reason"))
        kept = marked.filter(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
        return pool_records(kept, include_fields, **columns)
    # Without reasons to report, the checks are separate predicates, null tests reach the scan,
    # and the cheap ones are tried first.
    name = lambda c: columns.get(c, c)
    fields = ("user_id", "caption", "image_0_uid", "image_1_uid", "best_image_uid")
    for c in fields:
        labelled = labelled.filter(F.col(name(c)).isNotNull())
    # Each text is stripped once: a filter over a generator's columns is not turned back into one
    # that strips again for every test, as a filter over a projection is.
    texts = F.struct(*[K.strip(F.col(name(c))).alias(f"{TEXT}{c}") for c in fields])
    kept = labelled.select("*", F.inline(F.array(texts)))
    user, caption, first, second, best = (F.col(f"{TEXT}{c}") for c in fields)
    kept = kept.filter(best.isin(first, second))
    # The best uid equals one of the image uids by now, so it needs no test of its own.
    for text in (user, caption, first, second):
        kept = kept.filter(~K.stands_for_nothing(text))
    return _records(kept, name("caption"), include_fields, user, best, first, second)


def reason_counts(marked: DataFrame) -> DataFrame:
    """Rows per reason code."""
    return marked.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def pool_summary(marked: DataFrame) -> DataFrame:
    """Rows scanned and written, users and rows per split, one row per split plus 'all'."""
    kept = F.col("reason").isNull()
    measures = [
        F.count(F.lit(1)).alias("rows_scanned"),
        F.count_if(kept).alias("rows_written"),
        F.count_distinct(F.when(kept, K.strip(F.col("user_id")))).alias("unique_users_written"),
    ]
    return marked.rollup("split").agg(F.grouping("split").alias("__all"), *measures).select(
        F.when(F.col("__all") == 1, "all").otherwise(F.col("split")).alias("split"),
        "rows_scanned",
        "rows_written",
        "unique_users_written",
    )


def validate_pool(df: DataFrame, strict: bool = False) -> DataFrame:
    """Adds the reason a pool row cannot be used as a candidate (narrow missing test)."""
    required = ("user_id", "preferred_uid", "dispreferred_uid", "caption")
    absent = [
        K.is_blank(F.col(c)) if c in df.columns else F.lit(True) for c in required
    ]
    reason = F.coalesce(*[F.when(a, F.lit(f"missing_{c}")) for a, c in zip(absent, required)])
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    return df.withColumn("reason", reason)
