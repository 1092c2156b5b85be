"""Inference grids, condition comparisons, user contexts and prompt selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.functions import tensors as X
from pairloom.operators import manifest
from pairloom.operators.shots import first_per_key


def condition_grid(
    prompts: DataFrame, seeds: Sequence[int], scales: Sequence[float], conditions: Sequence[str] = C.CONDITIONS
) -> DataFrame:
    """Every seed, scale and condition of every prompt, with a sample id per (prompt, seed, scale).

    The three lists are parameters, so each prompt row is expanded in place and
    the sample number follows from the positions.
    """
    axis = lambda items, kind: F.array(*[F.lit(i).cast(kind) for i in items])
    labels = axis([f"{float(s):.6g}".replace("-", "m").replace(".", "p") for s in scales], "string")
    rows = prompts.select("*", F.posexplode(axis(seeds, "bigint")).alias("__a", "seed"))
    rows = rows.select("*", F.posexplode(axis(scales, "double")).alias("__b", "scale"))
    rows = rows.select("*", F.explode(axis(conditions, "string")).alias("condition"))
    number = (F.col("prompt_index") * len(seeds) + F.col("__a")) * len(scales) + F.col("__b")
    label = F.format_string("sample_%02d_scale_%s", number.cast("bigint"), F.element_at(labels, F.col("__b") + 1))
    return rows.withColumn("sample_index", number.cast("bigint")).withColumn("sample_id", label).drop("__a", "__b")


def compare_conditions(
    tensors: DataFrame,
    sample: str = "sample_id",
    condition: str = "condition",
    values: str = "vals",
    pairs: Sequence[tuple[str, str]] = C.CONDITION_PAIRS,
) -> DataFrame:
    """Distances between the named condition pairs of each sample that has both.

    A sample holds one tensor per condition, so one shuffle brings its handful
    of tensors together and the pairs are formed inside the row.
    """
    names = sorted({c for pair in pairs for c in pair})
    wide = tensors.groupBy(sample).agg(
        *[F.any_value(F.when(F.col(condition) == n, F.col(values)), True).alias(f"__{n}") for n in names]
    )
    cells = [
        F.when(
            F.col(f"__{a}").isNotNull() & F.col(f"__{b}").isNotNull(),
            F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), X.pair_metrics(F.col(f"__{a}"), F.col(f"__{b}")).alias("m")),
        )
        for a, b in pairs
    ]
    rows = wide.select(sample, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c"))
    return rows.select(sample, F.col("c.pair").alias("pair"), "c.m.*")


def near_identical(compared: DataFrame, pair: str = "zero_user_vs_real_user", threshold: float = 1e-8) -> DataFrame:
    """Samples whose named pair is closer than a threshold."""
    return compared.filter((F.col("pair") == pair) & (F.col("l2_norm") <= threshold))


def select_prompts(
    assignments: DataFrame,
    row_key: str = "user_embedding_id",
    manual: Sequence[str] = (),
    max_query_prompts: int | None = None,
    defaults: Sequence[str] = (),
    extras: Sequence[str] = (),
) -> DataFrame:
    """Prompts of each assignment in order: manual or query captions (all, or the first few), then defaults, then extras.

    Blank prompts and repeats are dropped.  Everything is decided inside the row,
    as a row has few prompts.
    """
    named = lambda items, name: F.transform(items, lambda p: F.lit(name))
    listed = lambda items: F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")
    tidy = lambda items: F.filter(F.transform(items, K.strip), lambda p: p != "")
    if manual:
        first, source = F.array_distinct(tidy(listed(manual))), "manual"
    else:
        captions = F.transform("query_pairs", lambda p: F.coalesce(p["caption"], F.lit("")))
        first, source = F.array_distinct(tidy(captions)), "query"
        if max_query_prompts is not None:
            first = F.slice(first, 1, max_query_prompts)
    prompts, sources = first, named(first, source)
    for items, name in ((defaults, "default_extra"), (extras, "extra")):
        fresh = F.array_except(tidy(listed(items)), prompts)
        prompts, sources = (
            F.concat(prompts, fresh),
            F.concat(sources, named(fresh, name)),
        )
    rows = assignments.select(row_key, F.posexplode(F.arrays_zip(prompts.alias("prompt"), sources.alias("source"))).alias("prompt_index", "z"))
    return rows.select(row_key, F.col("prompt_index").cast("bigint").alias("prompt_index"), F.col("z.prompt").alias("prompt"), F.col("z.source").alias("source"))


def pick_assignment(assignments: DataFrame, embedding_id: str | None, order: str = "source_embedding_row_idx") -> DataFrame:
    """The assignment with the given id, or the first one; the first of equal ids."""
    rows = assignments if embedding_id is None else assignments.filter(F.col("user_embedding_id") == embedding_id)
    return rows.orderBy(order).limit(1)


def find_embedding_rows(assignments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embedding row of each assignment: by row number if its id agrees, else the first row with the id.

    Adds `found_by` (row_idx, id or null) and `reason` (not_found, user_mismatch).
    Row numbers start again in every shard, so where both sides have a split or
    shard these must agree too.
    """
    shard = [c for c in ("split", "shard_id") if c in assignments.columns and c in embeddings.columns]
    resolved = F.coalesce(
        F.when(~K.is_blank(F.col("user_embedding_id")), F.col("user_embedding_id")),
        F.format_string("%s_emb_%06d", F.col("user_id"), F.col("source_embedding_row_idx")),
    )
    right = embeddings.select(
        *shard, F.col("source_embedding_row_idx").alias("row_idx"), resolved.alias("row_id"), F.col("user_id").alias("row_user")
    )
    by_idx = right.select(
        *shard, F.col("row_idx").alias("source_embedding_row_idx"), F.col("row_id").alias("idx_id"), F.col("row_user").alias("idx_user")
    )
    by_id = first_per_key(right.withColumn("__o", F.col("row_idx")), [*shard, "row_id"], "__o").select(
        *shard, F.col("row_id").alias("user_embedding_id"), F.col("row_idx").alias("id_row"), F.col("row_user").alias("id_user")
    )
    joined = assignments.join(by_idx, [*shard, "source_embedding_row_idx"], "left").join(by_id, [*shard, "user_embedding_id"], "left")
    agrees = F.coalesce(F.col("idx_id") == F.col("user_embedding_id"), F.lit(False))
    row = F.when(agrees, F.col("source_embedding_row_idx")).otherwise(F.col("id_row"))
    user = F.when(agrees, F.col("idx_user")).otherwise(F.col("id_user"))
    found = F.when(agrees, "row_idx").when(F.col("id_row").isNotNull(), "id")
    reason = F.when(found.isNull(), "not_found").when(user != F.col("user_id"), "user_mismatch")
    return (
        joined.withColumn("found_row_idx", row)
        .withColumn("found_by", found)
        .withColumn("reason", reason)
        .drop("idx_id", "idx_user", "id_row", "id_user")
    )


def support_with_paths(assignments: DataFrame, paths: DataFrame, row_key: str = "user_embedding_id") -> DataFrame:
    """One row per support pair with the paths of both images."""
    rows = assignments.select(row_key, F.inline("support_pairs"))
    return manifest.attach_paths(rows, paths)


def inspect_user(
    embeddings: DataFrame,
    paths: DataFrame,
    meta: DataFrame,
    user_id: str | None = None,
    row_idx: int | None = None,
    max_pairs: int | None = None,
    order: str = "source_embedding_row_idx",
) -> DataFrame:
    """Pairs of one embedding row with paths and short metadata.

    The row is chosen by number, by user (its first row), or is the first of all.
    """
    rows = embeddings
    if row_idx is not None:
        rows = rows.filter(F.col(order) == row_idx)
    elif user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    pairs = rows.orderBy(order).limit(1).select("user_id", F.col(order).alias("row_idx"), F.inline("support_pairs"))
    if max_pairs is not None:
        pairs = pairs.filter(F.col("pair_idx") < max_pairs)
    pairs = manifest.attach_paths(pairs, paths)
    return manifest.attach_meta(pairs, meta, ["num_occurrences", "best_count", "non_best_count", "split_counts"])


def report_rows(records: DataFrame, images: DataFrame, key: str = "sample_id", order: str = "place") -> DataFrame:
    """Inference records with their image record, kept where there is none; of an id's images the last in `order` counts."""
    rest = [c for c in images.columns if c != key]
    last = images.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return records.join(last, key, "left").select(*records.columns, *[F.col("__last")[c].alias(c) for c in rest])
