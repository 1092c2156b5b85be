"""Cutting each user's pairs into few-shot groups, and users into chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pairloom.functions import keys as K
from pairloom.operators.ranking import apart, bucket_positions, light_window, position_by_hash, position_by_sort

USER = ("split", "user_id")


def eligible_users(rows: DataFrame, num_shots: int = 4, keys: Sequence[str] = USER) -> DataFrame:
    """Users with at least num_shots usable rows, with their row count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= num_shots)


def chunk_shots(
    rows: DataFrame,
    num_shots: int = 4,
    per_user: int = -1,
    seed: int = 0,
    keys: Sequence[str] = USER,
    row_id: str = "row_idx",
    digits: int = 2,
) -> DataFrame:
    """Adds `chunk` and `pos`: a seeded shuffle per user, cut into full groups.

    The short last group is dropped, then at most per_user groups are kept
    (-1 keeps all).  A user's rows are never gathered in one task.
    """
    placed = position_by_hash(
        rows.withColumn("__h", K.seeded_hash(seed, F.col(row_id))), keys, "__h", [row_id], "__p", digits, total="__n"
    ).drop("__h")
    return _full_groups(placed, num_shots, per_user).withColumn("pos", (F.col("__p") % num_shots).cast("int")).drop("__p", "__n")


def _full_groups(placed: DataFrame, num_shots: int, per_user: int) -> DataFrame:
    """Adds `chunk` to rows at place __p of __n, and drops what is no part of a group that counts."""
    full = F.floor(F.col("__n") / num_shots)
    if per_user > 0:
        full = F.least(full, F.lit(per_user))
    return placed.withColumn("chunk", F.floor(F.col("__p") / num_shots).cast("bigint")).filter(F.col("chunk") < full)


def shot_groups(
    rows: DataFrame,
    fields: Sequence[str],
    num_shots: int = 4,
    per_user: int = -1,
    seed: int = 0,
    keys: Sequence[str] = USER,
    row_id: str = "row_idx",
    digits: int = 2,
) -> DataFrame:
    """What gather_shots makes of chunk_shots, for callers that need the groups only.

    A light user's rows are sorted once, and the first row of a group takes the
    ones that follow it; heavy users' rows are ranked in buckets and gathered.
    """
    light, heavy = apart(rows.select(*dict.fromkeys([*keys, row_id, *fields])), keys)
    hashed = lambda some: some.withColumn("__h", K.seeded_hash(seed, F.col(row_id)))
    own, pair = light_window(keys), F.struct(*fields)
    ordered = own.orderBy("__h", row_id)
    # Hashed where they are sorted, so that the digests are not moved.
    placed = hashed(light.withColumn(K.PREFIX, K.prefix(*keys)).repartition(K.PREFIX, *keys)).select(
        *keys,
        (F.row_number().over(ordered).cast("bigint") - 1).alias("__p"),
        F.count(F.lit(1)).over(own).alias("__n"),
        F.array(pair, *[F.lead(pair, n).over(ordered) for n in range(1, num_shots)]).alias("pairs"),
    )
    groups = _full_groups(placed.filter(F.col("__p") % num_shots == 0), num_shots, per_user).select(*keys, "chunk", "pairs")
    if heavy is None:
        return groups
    cut = bucket_positions(hashed(heavy), keys, "__h", [row_id], "__p", digits, total="__n")
    cut = _full_groups(cut, num_shots, per_user).withColumn("pos", (F.col("__p") % num_shots).cast("int"))
    return groups.unionByName(gather_shots(cut, keys, fields))


def gather_shots(chunked: DataFrame, keys: Sequence[str] = USER, fields: Sequence[str] = ()) -> DataFrame:
    """One row per group with `pairs` in shot order; a group holds num_shots rows."""
    fields = list(fields) or ["preferred_uid", "dispreferred_uid", "caption", "row_idx"]
    return (
        chunked.groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("pairs"))
        .withColumn("pairs", F.transform("pairs", lambda p: p.dropFields("pos")))
    )


def pivot_shots(chunked: DataFrame, num_shots: int = 4, keys: Sequence[str] = USER) -> DataFrame:
    """One row per group with numbered columns, the layout embedding shards use."""
    names = {
        "preferred_uid": "preferred_image_uid",
        "dispreferred_uid": "dispreferred_image_uid",
        "caption": "caption",
        "row_idx": "source_row_idx",
    }
    cells = [
        F.max(F.when(F.col("pos") == k, F.col(column))).alias(f"{name}_{k}")
        for k in range(num_shots)
        for column, name in names.items()
        if column in chunked.columns
    ]
    return chunked.groupBy(*keys, "chunk").agg(*cells)


def user_chunks(users: DataFrame, num_chunks: int = 8, mode: str = "ceil", user: str = "user_id") -> DataFrame:
    """Sorted distinct users cut into num_chunks ranges.

    `ceil` keeps everyone; `floor` leaves the remainder out.
    """
    distinct = users.select(user).distinct()
    ranked = position_by_sort(distinct, [F.col(user)], "__p")
    round_up = F.ceil if mode == "ceil" else F.floor
    # A size of 0 becomes null and leaves every chunk empty.
    size = ranked.agg(F.nullif(round_up(F.count(F.lit(1)) / num_chunks), F.lit(0)).alias("n")).scalar()
    placed = ranked.withColumn("user_chunk", F.floor(F.col("__p") / size).cast("bigint")).drop("__p")
    return placed.filter(F.col("user_chunk") < num_chunks)


def restrict_to_users(rows: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of the listed users."""
    return rows.join(users.select(user).distinct(), user, "left_semi")


def first_per_key(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row with the smallest ordinal of each key, by a combining aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("__r"))
    return best.select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest])
