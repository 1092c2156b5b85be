"""Training samples: assignments joined with embeddings, paths, metadata and latents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.functions import tensors as X
from pairloom.operators import assign, manifest
from pairloom.operators.ranking import WIDTH, position_by_ordinal

SHARD = ("split", "shard_id")


def embedding_ok(emb: Column, width: int = C.EMBEDDING_WIDTH, strict_width: bool = True) -> Column:
    """First problem of a 2-D embedding, null if there is none."""
    first = F.size(F.try_element_at(emb, F.lit(1)))
    return F.coalesce(
        F.when(emb.isNull(), F.lit("missing_emb")),
        F.when(F.size(emb) == 0, F.lit("empty_emb")),
        F.when(F.exists(emb, lambda v: v.isNull() | (F.size(v) != first)), F.lit("ragged_emb")),
        F.when(first != width, F.lit("emb_width")) if strict_width else F.lit(None).cast("string"),
        F.when(F.exists(emb, lambda v: ~X.all_finite(v)), F.lit("not_finite")),
    )


def last_token(emb: Column) -> Column:
    """Last row of a 2-D embedding, the classifier's feature."""
    return F.try_element_at(emb, F.lit(-1))


def signatures(pairs: Column) -> Column:
    """Ordered (preferred, dispreferred, caption) list of a pair array."""
    return F.transform(pairs, lambda p: F.struct(*[p[c].cast("string").alias(c) for c in assign.SIGNATURE]))


def match_embeddings(
    assignments: DataFrame, embeddings: DataFrame, keys: Sequence[str] = SHARD, check_support: bool = True
) -> DataFrame:
    """Assignments with the embedding row they point at and a reason code.

    Rows meet on (shard, row number).  Reasons: missing_row_idx, missing_user_id,
    row_out_of_range, user_mismatch, embedding_id_mismatch, support_mismatch.
    """
    right = embeddings.select(
        *keys,
        F.col("source_embedding_row_idx"),
        F.lit(True).alias("__present"),
        F.col("user_id").cast("string").alias("__user"),
        F.coalesce(
            F.col("user_embedding_id"),
            F.format_string("%s_emb_%06d", F.col("user_id"), F.col("source_embedding_row_idx")),
        ).alias("__id"),
        F.col("support_pairs").alias("__support"),
        *[F.col(c) for c in ("user_profile_text",) if c in embeddings.columns],
    )
    joined = assignments.join(right, [*keys, "source_embedding_row_idx"], "left")
    given_id = F.coalesce(F.col("user_embedding_id").cast("string"), F.col("__id"))
    reason = F.coalesce(
        F.when(F.col("source_embedding_row_idx").isNull(), F.lit("missing_row_idx")),
        F.when(F.col("__present").isNull(), F.lit("row_out_of_range")),
        F.when(K.is_blank(F.col("user_id")), F.lit("missing_user_id")),
        F.when(~F.col("user_id").cast("string").eqNullSafe(F.col("__user")), F.lit("user_mismatch")),
        F.when(given_id != F.col("__id"), F.lit("embedding_id_mismatch")),
        F.when(F.col("support_pairs").isNull(), F.lit("support_mismatch")),
        F.when(signatures(F.col("support_pairs")) != signatures(F.col("__support")), F.lit("support_mismatch"))
        if check_support
        else F.lit(None).cast("string"),
        F.when(F.col("query_pairs").isNull(), F.lit("missing_query_pairs")),
    )
    return joined.withColumn("reason", reason).drop("__present", "__user", "__id", "__support")


def explode_queries(matched: DataFrame) -> DataFrame:
    """One row per query pair of the usable assignments."""
    carried = [c for c in matched.columns if c not in ("query_pairs", "reason")]
    rows = matched.filter(F.col("reason").isNull()).withColumn(
        "query_pairs", assign.normalise_pairs(F.col("query_pairs"), "query")
    )
    rows = rows.select(*carried, F.posexplode("query_pairs").alias("query_pos", "q"))
    return rows.select(
        *carried,
        "query_pos",
        F.col("q.preferred_uid").alias("preferred_uid"),
        F.col("q.dispreferred_uid").alias("dispreferred_uid"),
        F.col("q.caption").alias("caption"),
        F.col("q.pair_idx").alias("query_pair_idx"),
        F.col("q.pair_key").alias("query_pair_key"),
        F.col("q.source_row_idx").alias("query_source_row_idx"),
    )


def attach_latents(rows: DataFrame, latents: DataFrame, strict: bool = False) -> DataFrame:
    """Adds both latent paths and `missing_latent`; strict fails on a missing one."""
    usable = latents.filter(~K.is_blank(F.col("latent_path")))
    rows = manifest.attach(rows, usable, "latent_path", "latent_path")
    missing = F.col("preferred_latent_path").isNull() | F.col("dispreferred_latent_path").isNull()
    if strict:
        missing = F.when(missing, F.raise_error(F.lit("query pair without a latent")).cast("boolean")).otherwise(missing)
    return rows.withColumn("missing_latent", missing)


def training_samples(
    assignments: DataFrame,
    embeddings: DataFrame,
    latents: DataFrame | None = None,
    paths: DataFrame | None = None,
    meta: DataFrame | None = None,
    require_latents: bool = True,
    keys: Sequence[str] = SHARD,
) -> DataFrame:
    """Query-pair samples.  Narrow keys are joined first; tensors are attached by the caller last."""
    rows = explode_queries(match_embeddings(assignments, embeddings, keys))
    if paths is not None:
        rows = manifest.attach_paths(rows, paths)
    if meta is not None:
        rows = manifest.attach_meta(rows, meta)
    if latents is not None:
        rows = attach_latents(rows, latents)
        if require_latents:
            rows = rows.filter(~F.col("missing_latent"))
    return rows


def direct_samples(
    embeddings: DataFrame, pairs: str = "pairs", paths: DataFrame | None = None, meta: DataFrame | None = None
) -> DataFrame:
    """Samples straight from the pairs stored in embedding rows, without assignments."""
    rows = assign.explode_pairs(embeddings, pairs)
    if paths is not None:
        rows = manifest.attach_paths(rows, paths)
    return manifest.attach_meta(rows, meta) if meta is not None else rows


def attach_tensors(samples: DataFrame, tensors: DataFrame, values: str = "vals") -> DataFrame:
    """Adds the latent tensors of both sides, as the last join of a chain.

    Tensors must be unique by uid (latents.mark_duplicates finds those that aren't).
    """
    return manifest.attach(samples, tensors, values, "latent", unique=True)


def sample_stats(samples: DataFrame, emb_length: str = "emb_length") -> DataFrame:
    """One row: samples, users, shortest and longest embedding."""
    return samples.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count_distinct("user_id").alias("num_users"),
        F.min(emb_length).alias("embedding_length_min"),
        F.max(emb_length).alias("embedding_length_max"),
    )


def dataset_counters(
    marked_pairs: DataFrame, matched: DataFrame, exploded: DataFrame, samples: DataFrame
) -> DataFrame:
    """One row of counters of a run over embedding pairs, assignments and samples.

    `marked_pairs` has a `valid` flag per stored pair (assign.fold_pairs,
    exploded), `matched` comes from match_embeddings, `exploded` from
    explode_queries with latents attached, and `samples` are those kept.
    """
    pairs = marked_pairs.agg(
        F.count(F.lit(1)).alias("num_pairs_seen"),
        F.count_if(~F.coalesce("valid", F.lit(False))).alias("num_malformed_pairs"),
        F.count_if(K.is_blank(F.col("user_id"))).alias("num_pairs_without_user"),
    )
    assigned = matched.agg(
        F.count(F.lit(1)).alias("num_assignment_records"), F.count_if(F.col("reason").isNotNull()).alias("num_failed_validation")
    )
    queries = exploded.agg(F.count(F.lit(1)).alias("num_query_pairs"), F.count_if("missing_latent").alias("missing_latents_skipped"))
    kept = samples.agg(F.count(F.lit(1)).alias("num_samples"), F.count_distinct("user_id").alias("num_users"))
    return kept.select("*", *[one.select(c).scalar().alias(c) for one in (pairs, assigned, queries) for c in one.columns])


def pair_count_distribution(rows: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows by their number of valid pairs, rows without any included."""
    per_row = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_pairs"))
    return (
        rows.select(*keys)
        .join(per_row, list(keys), "left")
        .groupBy(F.coalesce("num_pairs", F.lit(0)).cast("bigint").alias("num_pairs"))
        .agg(F.count(F.lit(1)).alias("num_rows"))
    )


def shard_sizes(assignments: DataFrame, keys: Sequence[str] = SHARD) -> DataFrame:
    """Query pairs per shard."""
    n = F.coalesce(F.size("query_pairs"), F.lit(0))
    return assignments.groupBy(*keys).agg(F.sum(n).cast("bigint").alias("num_query_samples"))


def shard_offsets(sizes: DataFrame, order: str = "shard_id") -> DataFrame:
    """Start and end of each shard in the joint index, one row per shard."""
    upto = Window.partitionBy("split").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("num_query_samples").over(upto)
    return sizes.withColumn("end_index", end).withColumn("start_index", F.col("end_index") - F.col("num_query_samples"))


def global_index(samples: DataFrame, offsets: DataFrame, ordinal: str, width: int = WIDTH, tie: Sequence[str] = ()) -> DataFrame:
    """Adds the position in the shard and in the joint index to each sample."""
    local = position_by_ordinal(samples, list(SHARD), ordinal, "local_index", width, tie)
    return local.join(offsets.select(*SHARD, "start_index"), list(SHARD)).withColumn(
        "global_index", F.col("start_index") + F.col("local_index")
    ).drop("start_index")


def match_shards(embedding_files: DataFrame, assignment_files: DataFrame, name: str = "name") -> DataFrame:
    """(split, shard number) of both sides with a status: matched, duplicate, missing_assignment, missing_embedding.

    Names without a split or a number are counted under null.
    """
    def count(df: DataFrame, label: str, other: str) -> DataFrame:
        named = df.select(K.shard_split(F.col(name)).alias("split"), K.shard_number(F.col(name)).alias("shard_id"))
        return named.select("*", F.lit(1).alias(label), F.lit(0).alias(other))

    files = count(embedding_files, "n_embedding", "n_assignment").unionByName(count(assignment_files, "n_assignment", "n_embedding"))
    both = files.groupBy("split", "shard_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n_embedding", "n_assignment")])
    status = (
        F.when((F.col("n_embedding") > 1) | (F.col("n_assignment") > 1), "duplicate")
        .when(F.col("n_assignment") == 0, "missing_assignment")
        .when(F.col("n_embedding") == 0, "missing_embedding")
        .otherwise("matched")
    )
    return both.withColumn("status", status)


def batch_ids(
    rows: DataFrame,
    ordinal: str,
    size: int,
    start_batch: int = 0,
    keys: Sequence[str] = (),
    width: int = WIDTH,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Adds batch_id and batch_pos over the rows in order, beginning at a batch; the last one may be short."""
    size = max(1, size)
    placed = position_by_ordinal(rows, list(keys), ordinal, "__p", width, tie)
    return (
        placed.withColumn("batch_id", F.floor(F.col("__p") / size).cast("bigint"))
        .withColumn("batch_pos", F.col("__p") % size)
        .filter(F.col("batch_id") >= max(0, start_batch))
        .drop("__p")
    )


def pad_and_mask(batched: DataFrame, emb: str = "emb", batch: str = "batch_id") -> DataFrame:
    """Embeddings padded with zero rows to the longest of their batch, and a 0/1 mask.

    The window holds one batch, whose size is a parameter.
    """
    length = F.size(emb)
    longest = F.max(length).over(Window.partitionBy(batch))
    width = F.max(F.size(F.try_element_at(emb, F.lit(1)))).over(Window.partitionBy(batch))
    rows = batched.withColumn("__n", length).withColumn("__m", longest).withColumn("__w", width)
    zero_row = F.array_repeat(F.lit(0.0).cast(batched.schema[emb].dataType.elementType.elementType), F.col("__w"))
    pad = F.col("__m") - F.col("__n")
    return (
        rows.withColumn(emb, F.concat(emb, F.array_repeat(zero_row, pad)))
        .withColumn("mask", F.concat(F.array_repeat(F.lit(1), F.col("__n")), F.array_repeat(F.lit(0), pad)))
        .drop("__n", "__m", "__w")
    )


def batch_rollup(shards: DataFrame) -> DataFrame:
    """Per split: shards found, written, skipped and failed, from a status column."""
    n = lambda s, label: F.count_if(F.col("status") == s).alias(label)
    return shards.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_shards_found"),
        n("written", "num_outputs_written"),
        n("skipped", "num_skipped_existing"),
        n("failed", "num_failures"),
    )
