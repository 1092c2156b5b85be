"""Held-out query pairs for user-embedding rows.

The straightforward plan joins every embedding row of a user with every pool
pair of that user, which grows with the square of a heavy user.  Nothing here
does that.  A user's distinct pairs get a random position each; the support
pairs of an embedding row are looked up by value and become a short list of
excluded positions; drawing k pairs is then arithmetic on positions, and the
drawn ones are fetched by an equi-join on (user, position).  All joins are on
keys that spread a heavy user over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.functions.tensors import let
from pairloom.operators.ranking import DIGITS, apart, bucket_positions, light_window
from pairloom.operators.shots import USER, first_per_key
from pairloom.session import materialise

# Name pattern of numbered pair columns, and aliases of the source row number.
NUMBERED = re.compile(r"^(preferred_image_uid|dispreferred_image_uid|caption)_(\d+)$")
SOURCE_ALIASES = ("source_row_idx", "source_row_index", "source_idx", "pair_source_row_idx")

SIGNATURE = ("preferred_uid", "dispreferred_uid", "caption")
ROW = "__row_identity"


def numbered_pairs(columns: Sequence[str]) -> list[int]:
    """Pair numbers present among the column names, ascending."""
    return sorted({int(m.group(2)) for m in map(NUMBERED.match, columns) if m})


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def source_index(df: DataFrame, k: int) -> Column:
    """Source row number of pair k under the first of its four names that holds one."""
    present = [F.col(f"{a}_{k}") for a in SOURCE_ALIASES if f"{a}_{k}" in df.columns]
    usable = [F.when(~K.is_blank(c), c.try_cast("bigint")) for c in present]
    return F.coalesce(*usable) if usable else F.lit(None).cast("bigint")


def fold_pairs(df: DataFrame, name: str = "pairs") -> DataFrame:
    """Numbered columns folded into one array of pairs, each with a `valid` flag.

    A pair number whose three columns are all null belongs to no pair of this
    row (shards of different width may be read together) and is left out.
    """
    pairs = []
    for k in numbered_pairs(df.columns):
        parts = [_column_or_null(df, f"{c}_{k}") for c in ("preferred_image_uid", "dispreferred_image_uid", "caption")]
        missing = K.is_blank(parts[0]) | K.is_blank(parts[1]) | K.is_blank(parts[2])
        pairs.append(
            F.when(
                F.coalesce(*[p.cast("string") for p in parts]).isNotNull(),
                F.struct(
                    F.lit(k).alias("pair_idx"),
                    F.lit(f"support_{k}").alias("pair_key"),
                    *[p.cast("string").alias(n) for p, n in zip(parts, SIGNATURE)],
                    source_index(df, k).alias("source_row_idx"),
                    (~missing).alias("valid"),
                ),
            )
        )
    return df.withColumn(name, F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def explode_pairs(df: DataFrame, pairs: str = "pairs", strict: bool = False) -> DataFrame:
    """One row per valid pair; invalid ones are dropped, or fail the job when strict."""
    rest = [c for c in df.columns if c != pairs]
    rows = df.select(*rest, F.inline(pairs))
    ok = F.col("valid")
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error("malformed pair").cast("boolean"))
    return rows.filter(ok).drop("valid")


def embedding_id(df: DataFrame, user: str = "user_id", row_idx: str = "source_embedding_row_idx") -> Column:
    """Given id, else the alternative name, else one made of user and row number."""
    given = [
        F.when(~K.is_blank(F.col(c)), F.col(c).cast("string"))
        for c in ("user_embedding_id", "embedding_id")
        if c in df.columns
    ]
    return F.coalesce(*given, F.format_string("%s_emb_%06d", F.col(user), F.col(row_idx)))


def profile_text(df: DataFrame) -> Column:
    """Text of a user profile under either name, else empty."""
    named = [F.col(c).cast("string") for c in ("text", "user_profile_text") if c in df.columns]
    return F.coalesce(*named, F.lit(""))


def embedding_reason(df: DataFrame, pairs: str = "pairs", expected: int = C.SUPPORT_PAIRS) -> Column:
    """First reason an embedding row cannot be assigned pairs, null if it can."""
    return F.coalesce(
        F.when(K.is_blank(F.col("user_id")), F.lit("missing_user_id")),
        F.when(F.col("emb").isNull(), F.lit("missing_emb")) if "emb" in df.columns else F.lit(None).cast("string"),
        F.when(F.exists(pairs, lambda p: ~p.getField("valid")), F.lit("malformed_support_pair")),
        F.when(F.size(pairs) != expected, F.lit("support_pair_count")),
    )


def has_support_count(pairs: Column, expected: int = C.SUPPORT_PAIRS) -> Column:
    """True where exactly the expected number of support pairs is present."""
    return F.size(pairs) == expected


def normalise_pairs(pairs: Column, prefix: str) -> Column:
    """Pair objects with default number and key by position."""
    return F.transform(
        pairs,
        lambda p, i: F.struct(
            *[p.getField(c).cast("string").alias(c) for c in SIGNATURE],
            F.coalesce(p.getField("pair_idx").cast("bigint"), i.cast("bigint")).alias("pair_idx"),
            F.coalesce(
                F.when(~K.is_blank(p.getField("pair_key")), p.getField("pair_key")),
                F.concat(F.lit(f"{prefix}_"), i.cast("string")),
            ).alias("pair_key"),
            p.getField("source_row_idx").cast("bigint").alias("source_row_idx"),
        ),
    )


def distinct_candidates(pool: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    """First pool row of each (user, preferred, dispreferred, caption).

    A missing caption counts as the empty one.
    """
    return first_per_key(
        _candidate_rows(pool, keys).withColumn("__o", F.col("source_row_idx")), [*keys, *SIGNATURE], "__o"
    ).drop("__o")


def _candidate_rows(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    cleaned = pool.withColumn("caption", F.when(K.is_blank(F.col("caption")), "").otherwise(F.col("caption")))
    return cleaned.select(*keys, *SIGNATURE, *[c for c in ("pair_idx", "pair_key") if c in pool.columns], "source_row_idx")


def candidate_counts(rows: DataFrame, pool: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    """Embedding rows with the number of pool pairs their user has (0 where none)."""
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_candidate_pairs_before_filter"))
    return rows.join(sizes, list(keys), "left").fillna(0, ["num_candidate_pairs_before_filter"])


def support_matches(
    rows: DataFrame,
    candidates: DataFrame,
    row_key: str,
    pairs: str = "support_pairs",
    keys: Sequence[str] = USER,
    captions_checked: bool = True,
) -> DataFrame:
    """(row, candidate) for candidates that equal one of the row's support pairs.

    Uids must agree; captions must agree unless one side has none.  Captions that
    were checked on both sides need one equi-join on the full signature.  For
    unchecked ones, two more on the uids cover a missing caption on either side,
    so that no either-or condition defeats hash partitioning.
    """
    listed = F.array_distinct(
        F.transform(
            pairs,
            lambda p: F.struct(
                p["preferred_uid"].alias("preferred_uid"),
                p["dispreferred_uid"].alias("dispreferred_uid"),
                F.when(K.is_blank(p["caption"]), "").otherwise(p["caption"]).alias("caption"),
            ),
        )
    )
    side = rows.select(*keys, row_key, F.inline(listed))
    exact = prefixed_join(side, candidates, [*keys, *SIGNATURE])
    if captions_checked:
        return exact
    uids = [*keys, *SIGNATURE[:2]]
    no_caption = F.col("caption") == ""
    open_side = side.filter(no_caption).drop("caption").join(candidates.filter(~no_caption), uids)
    open_pool = side.filter(~no_caption).drop("caption").distinct().join(candidates.filter(no_caption), uids)
    return exact.unionByName(open_side).unionByName(open_pool)


def prefixed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on keys that would be slow to sort by themselves."""
    sides = [df.withColumn(K.PREFIX, K.prefix(*keys)) for df in (left, right)]
    return sides[0].join(sides[1], [K.PREFIX, *keys], how).drop(K.PREFIX)


def held_out_counts(
    rows: DataFrame,
    pool: DataFrame,
    row_key: str,
    pairs: str = "support_pairs",
    keys: Sequence[str] = USER,
    captions_checked: bool = True,
) -> DataFrame:
    """Embedding rows with candidate counts before and after support exclusion and dedupe."""
    candidates = distinct_candidates(pool, keys)
    rows = rows.withColumn(ROW, _row_identity(rows, row_key, keys))
    gone = (
        support_matches(rows, candidates, ROW, pairs, keys, captions_checked)
        .groupBy(ROW)
        .agg(F.count_distinct(F.struct(*SIGNATURE)).alias("__gone"))
    )
    counted = rows.join(_user_sizes(pool, candidates, keys), list(keys), "left").join(gone, ROW, "left").drop(ROW)
    left = F.coalesce(F.col("__n"), F.lit(0)) - F.coalesce(F.col("__gone"), F.lit(0))
    return (
        counted.withColumn("num_candidate_pairs_after_filter", left)
        .drop("__n", "__gone")
        .fillna(0, ["num_candidate_pairs_before_filter"])
    )


def _pooled(pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_candidate_pairs_before_filter"))


def _user_sizes(pool: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per user: pool rows, and distinct candidates as __n."""
    return _pooled(pool, keys).join(candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), list(keys))


def _identity_columns(rows: DataFrame, row_key: str, keys: Sequence[str]) -> list[str]:
    """What tells embedding rows apart: row numbers and default ids start again in every shard."""
    return [c for c in dict.fromkeys([*keys, row_key, "shard_id", "source_embedding_row_idx"]) if c in rows.columns]


def _row_identity(rows: DataFrame, row_key: str, keys: Sequence[str]) -> Column:
    """One value per row identity, never null."""
    parts = F.struct(*[F.col(c) for c in _identity_columns(rows, row_key, keys)])
    return F.unhex(F.md5(F.to_json(parts, {"ignoreNullFields": "false"})))


@dataclass(frozen=True)
class RankedPool:
    """A pool's distinct candidates at their random positions, and each user's counts; both stored."""

    placed: DataFrame
    sizes: DataFrame


def rank_pool(pool: DataFrame, seed: int = 0, keys: Sequence[str] = USER, digits: int = DIGITS) -> RankedPool:
    """Ranks a pool once, for any number of calls that draw from it."""
    keys = list(keys)
    digest = K.seeded_hash(seed, *[F.col(c) for c in (*keys, *SIGNATURE)])
    pooled = materialise(_pooled(pool, keys))
    light, heavy = apart(pool, keys, pooled.withColumnRenamed("num_candidate_pairs_before_filter", "__rows"))
    # A light user's rows are dealt out and sorted once; equal pairs stand together, the first of them counts.
    pair = F.struct(*SIGNATURE)
    ordered = light_window(keys).orderBy("__h", *SIGNATURE, F.asc_nulls_last("source_row_idx"))
    dealt = _candidate_rows(light, keys).withColumn(K.PREFIX, K.prefix(*keys)).repartition(K.PREFIX, *keys)
    same = F.lag(pair).over(ordered).eqNullSafe(pair)
    firsts = dealt.withColumn("__h", digest).withColumn("__same", same).filter("NOT __same").drop("__same")
    at = F.row_number().over(light_window(keys).orderBy("__h", *SIGNATURE)).cast("bigint") - 1
    placed = firsts.withColumn("__at", at).drop(K.PREFIX)
    if heavy is not None:
        candidates = distinct_candidates(heavy, keys).withColumn("__h", digest)
        placed = placed.unionByName(bucket_positions(candidates, keys, "__h", SIGNATURE, "__at", digits))
    placed = materialise(placed.drop("__h"))
    return RankedPool(placed, materialise(pooled.join(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys)))


def _draw(seed: int, named: Sequence[str], left: Column, k: int) -> Column:
    """k distinct places below `left`, every such set being as likely (Floyd's method); all places if there are no more than k.

    The numbers come from hashes of seed, row and step.
    """

    def step(got: Column, top: Column) -> Column:
        wish = K.hash_number(K.seeded_hash(seed, *[F.col(c) for c in named], top)) % (top + 1)
        return let(wish, lambda place: F.concat(got, F.array(F.when(F.array_contains(got, place), top).otherwise(place))))

    none = F.array().cast("array<bigint>")
    few = F.when(left > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(left, F.lit(1)) - 1)).otherwise(none)
    drawn = F.aggregate(F.sequence(F.greatest(left, F.lit(k)) - k, F.greatest(left, F.lit(k)) - 1), none, step)
    return F.when(left <= k, few).otherwise(drawn)


def sample_held_out(
    rows: DataFrame,
    pool: DataFrame | RankedPool,
    row_key: str,
    k: int = 1,
    seed: int = 0,
    pairs: str = "support_pairs",
    keys: Sequence[str] = USER,
    digits: int = DIGITS,
    captions_checked: bool = True,
) -> DataFrame:
    """Adds counts, `query_pairs` and the sampling label to each embedding row.

    With n distinct candidates of which some are excluded, the m left are those
    at the remaining positions of the user's random order.  Each row draws k of
    the m places by itself, uniformly and without replacement.  A row is told
    apart by its keys, id, shard and row number.

    Building the plan writes the ranked pool and the users' counts, heavy users
    among them, and nothing else; pass what rank_pool returns (made with the same seed) to reuse them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    keys = list(keys)
    ranked = pool if isinstance(pool, RankedPool) else rank_pool(pool, seed, keys, digits)
    placed = ranked.placed
    # The seed and these name a row's draw.
    named = [c for c in (row_key, "shard_id", "source_embedding_row_idx") if c in rows.columns]
    rows = rows.withColumn(ROW, _row_identity(rows, row_key, keys))
    # Matches go to their row before they are gathered, for those of one row seldom meet earlier.
    gone = (
        support_matches(rows, placed.select(*keys, *SIGNATURE, "__at"), ROW, pairs, keys, captions_checked)
        .select(ROW, "__at")
        .repartition(ROW)
        .groupBy(ROW)
        .agg(F.array_sort(F.collect_set("__at")).alias("__gone"))
    )

    def counted(some: DataFrame) -> DataFrame:
        known = some.join(gone, ROW, "left").join(ranked.sizes, keys, "left").fillna(0, ["num_candidate_pairs_before_filter", "__n"])
        known = known.withColumn("__gone", F.coalesce("__gone", F.array().cast("array<bigint>")))
        return known.withColumn("__left", F.col("__n") - F.size("__gone"))

    drawn_places = _draw(seed, named, F.col("__left"), k)
    spot = F.aggregate(
        F.col("__gone"), F.col("__free"), lambda at, skipped: F.when(skipped <= at, at + 1).otherwise(at)
    )
    pair_fields = [c for c in placed.columns if c not in (*keys, "__at")]
    label = F.when(F.col("__left") <= k, "all_candidates").otherwise(f"random_sample_without_replacement_k={k}")
    if k == 1:
        # A row has one draw at most, so nothing is taken apart and put together again.
        drawn = F.struct(*pair_fields)
        found = placed.select(*keys, "__at", F.array(drawn).alias("query_pairs"))
        return (
            counted(rows)
            .withColumn("__free", F.get(drawn_places, F.lit(0)))
            .withColumn("__at", spot)
            .drop("__gone", "__free", "__n", ROW)
            .transform(prefixed_join, found, [*keys, "__at"], "left")
            .select(
                *[c for c in rows.columns if c != ROW],
                "num_candidate_pairs_before_filter",
                F.col("__left").alias("num_candidate_pairs_after_filter"),
                label.alias("query_sampling_strategy"),
                F.coalesce("query_pairs", F.array().cast(found.schema["query_pairs"].dataType)).alias("query_pairs"),
            )
        )
    counts = ["num_candidate_pairs_before_filter", "__left"]
    narrow = counted(rows.select(ROW, *dict.fromkeys([*keys, *named])).dropDuplicates([ROW]))
    draws = narrow.select(*keys, ROW, *counts, "__gone", F.posexplode_outer(drawn_places).alias("__i", "__free"))
    place = F.when(F.col("__left") <= k, F.col("source_row_idx")).otherwise(F.col("__i"))
    drawn = F.when(F.col("__at").isNotNull(), F.struct(place.alias("__o"), *pair_fields))
    result = (
        draws.select(*keys, ROW, *counts, "__i", spot.alias("__at"))
        .transform(prefixed_join, placed, [*keys, "__at"], "left")
        # A row's counts are one; grouped by the row alone, the result is dealt out as the last join needs it.
        .groupBy(ROW)
        .agg(*[F.any_value(c).alias(c) for c in counts], F.array_sort(F.collect_list(drawn)).alias("query_pairs"))
        .select(
            ROW,
            counts[0],
            F.col("__left").alias("num_candidate_pairs_after_filter"),
            label.alias("query_sampling_strategy"),
            F.transform("query_pairs", lambda p: p.dropFields("__o")).alias("query_pairs"),
        )
    )
    return rows.join(result, ROW).drop(ROW)


def build_assignments(
    embeddings: DataFrame,
    pool: DataFrame | RankedPool,
    k: int = 1,
    seed: int = 0,
    on_empty: str = "fail",
    row_key: str = "user_embedding_id",
    keys: Sequence[str] = USER,
    pairs: str = "support_pairs",
    captions_checked: bool = True,
) -> DataFrame:
    """Assignment rows: supports, drawn query pairs, counts and label.

    `on_empty`: `fail` stops at a row without candidates, `skip` leaves it out,
    `keep` returns it with no query pairs so that it can be counted.  Rows and
    pool are expected to have passed embedding_reason and validate_pool; set
    captions_checked=False if captions may be missing on either side.
    """
    if on_empty not in ("fail", "skip", "keep"):
        raise ValueError("on_empty must be fail, skip or keep")
    kept = [c for c in embeddings.columns if c in (*keys, row_key, pairs, "source_embedding_row_idx", "shard_id")]
    out = sample_held_out(embeddings.select(*kept), pool, row_key, k, seed, pairs, keys, captions_checked=captions_checked)
    found = F.col("num_candidate_pairs_after_filter") > 0
    if on_empty == "skip":
        return out.filter(found)
    if on_empty == "fail":
        return out.filter(
            F.when(found, True).otherwise(
                F.raise_error(F.concat(F.lit("no held-out query pairs for "), F.col(row_key))).cast("boolean")
            )
        )
    return out


def assignment_summary(assigned: DataFrame, marked_embeddings: DataFrame, marked_pool: DataFrame) -> DataFrame:
    """One row of run counters; `assigned` comes from build_assignments(on_empty='keep')."""
    out = assigned.agg(
        F.count_if(F.col("num_candidate_pairs_after_filter") > 0).alias("num_assignment_records_written"),
        F.count_if(F.col("num_candidate_pairs_after_filter") <= 0).alias("num_skipped_no_query_pairs"),
    )
    seen = marked_embeddings.agg(
        F.count(F.lit(1)).alias("num_embedding_rows_seen"),
        F.count_if(F.col("reason").isNotNull()).alias("num_skipped_malformed_embedding_rows"),
    )
    pool = marked_pool.agg(
        F.count(F.lit(1)).alias("pair_pool_rows_seen"),
        F.count_if(F.col("reason").isNull()).alias("pair_pool_rows_indexed"),
    )
    # One-row frames side by side, as scalar subqueries.
    return out.select(
        "*",
        *[seen.select(c).scalar().alias(c) for c in seen.columns],
        *[pool.select(c).scalar().alias(c) for c in pool.columns],
    )
