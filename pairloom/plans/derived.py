"""Preference tables derived from the generic test tables.

Each text is plain SQL that both engines accept; `{events}` and `{embeddings}`
stand for the source tables.  Everything here is input for the operators, no
operator is implemented in it.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.operators import assign, pool as pool_ops, shots
from pairloom.session import materialise

_IMG = "concat('img_', lpad(CAST({n} AS STRING), 10, '0'))"
_USER = "concat('user_', lpad(CAST(user_id AS STRING), 10, '0'))"
_SPLIT = "CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'validation' ELSE 'test' END"

# Distinct images grow with the events.
_UIDS = "(SELECT 20 + CAST(floor(count(*) / 2) AS BIGINT) FROM {{events}})"

SQL = {
    "prefs": f"""
        SELECT row_idx, user_id, split, caption, {_IMG.format(n="a")} AS image_0_uid, {_IMG.format(n="b")} AS image_1_uid,
               CASE WHEN row_idx % 101 = 0 THEN 'img_none'
                    ELSE {_IMG.format(n="CASE WHEN value >= 25 THEN a ELSE b END")} END AS best_image_uid,
               has_label, a <> b AS are_different
        FROM (SELECT event_id AS row_idx, {_USER} AS user_id, {_SPLIT} AS split, value,
                     CASE WHEN event_id % 97 = 0 THEN ' '
                          ELSE concat(event_type, ' ', CAST(event_id % 50 AS STRING)) END AS caption,
                     event_id % {_UIDS.format()} AS a, (event_id * 7 + user_id) % {_UIDS.format()} AS b,
                     event_type <> 'error' AS has_label
              FROM {{events}}) e""",
    "latents": """
        SELECT vec_id, concat('img_', lpad(CAST(vec_id AS STRING), 10, '0')) AS uid, embedding AS vals,
               4 AS ch, 4 AS ht, 4 AS wd, vec_id % 50 = 0 AS scaled,
               CASE WHEN vec_id % 60 = 0 THEN 'other' ELSE 'raw_latent' END AS latent_semantics,
               concat('latents/', lpad(CAST(vec_id % 256 AS STRING), 3, '0'), '/', 'img_',
                      lpad(CAST(vec_id AS STRING), 10, '0'), '.bin') AS latent_path
        FROM {embeddings}""",
    "latent_copies": """
        SELECT vec_id, concat('img_', lpad(CAST(vec_id AS STRING), 10, '0')) AS uid,
               concat('latents/', 'img_', lpad(CAST(vec_id AS STRING), 10, '0'), '.bin') AS latent_path
        FROM {embeddings}
        UNION ALL
        SELECT vec_id, concat('img_', lpad(CAST(vec_id - vec_id % 40 AS STRING), 10, '0')) AS uid,
               concat('more/', 'img_', lpad(CAST(vec_id AS STRING), 10, '0'), '.bin') AS latent_path
        FROM {embeddings}""",
    "paths": """
        SELECT concat('img_', lpad(CAST(n AS STRING), 10, '0')) AS uid,
               max(CASE WHEN n % 13 <> 0 THEN concat('images/', CAST(n AS STRING), '.jpg') END) AS path
        FROM (SELECT event_id % """ + _UIDS.format() + """ AS n FROM {events}) e GROUP BY 1""",
    "flags": """
        SELECT event_id,
               CASE event_id % 9 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN ' Yes ' WHEN 3 THEN 'n'
                    WHEN 4 THEN 'none' WHEN 5 THEN 'null' WHEN 6 THEN '' WHEN 7 THEN 'maybe' ELSE '1' END AS flag,
               CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'none' WHEN 3 THEN 'NaN'
                    WHEN 4 THEN concat('  k', CAST(event_id AS STRING)) WHEN 5 THEN NULL
                    ELSE concat('Null ', CAST(event_id AS STRING)) END AS cell
        FROM {events}""",
    "tensors": """
        SELECT vec_id, uid, pos,
               CASE WHEN pos = 0 AND vec_id % 25 = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN pos = 1 AND vec_id % 40 = 0 THEN CAST('Infinity' AS DOUBLE)
                    WHEN pos = 2 AND vec_id % 80 = 0 THEN CAST('-Infinity' AS DOUBLE)
                    ELSE CAST(v AS DOUBLE) END AS v
        FROM {cells}""",
    "judged": f"""
        SELECT event_id, {_USER} AS user_id, {_SPLIT} AS split,
               CASE WHEN k % 10 = 9 THEN NULL WHEN k % 10 = 8 THEN 'unclear'
                    ELSE concat('Because of style. Prediction of user preference: ', CAST(1 + k % 2 AS STRING), ' ')
               END AS answer_first,
               CASE WHEN k % 10 = 9 THEN NULL
                    ELSE concat('Prediction of user preference: ', CAST(1 + CAST((k - k % 2) / 2 AS BIGINT) % 2 AS STRING))
               END AS answer_second
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {{events}}) e""",
    "steps": """
        SELECT event_id + 1 AS micro_step, value / 100 AS loss, value AS grad_norm, user_id AS batch_size,
               value * 3 AS reserved_mb, event_id % 100 = 99 AS is_validation
        FROM {events}""",
    "residuals": """
        SELECT event_id, concat('block_', CAST(user_id % 4 AS STRING)) AS module_path, 1 + value AS base_norm,
               value / 10 AS scaled_residual_norm, (value / 10) / (1 + value + 0.000000000001) AS residual_ratio,
               value AS checkpoint_user_scale, value / 2 AS inference_user_scale
        FROM {events}""",
    "conditions": """
        SELECT CAST((vec_id - vec_id % 5) / 5 AS BIGINT) AS sample_id,
               CASE vec_id % 5 WHEN 0 THEN 'base' WHEN 1 THEN 'branch_off' WHEN 2 THEN 'zero_user'
                    WHEN 3 THEN 'zero_user_zero_mask' ELSE 'real_user' END AS condition,
               embedding AS vals
        FROM {embeddings}""",
    "classified": """
        SELECT vec_id, label AS class_id, CAST((vec_id - vec_id % 32) / 32 AS BIGINT) AS batch_id, embedding AS vals
        FROM {embeddings}""",
    "shard_files": """
        SELECT 'embedding' AS side, concat('train_shard', CAST(user_id % 10 AS STRING), '.json') AS name,
               count(*) AS n_rows FROM {events} GROUP BY 1, 2
        UNION ALL
        SELECT 'assignment' AS side, concat('train_shard', CAST(1 + user_id % 10 AS STRING), '.json') AS name,
               count(*) AS n_rows FROM {events} GROUP BY 1, 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs as a DataFrame."""
    sources = {f for _, f, _, _ in string.Formatter().parse(SQL[name]) if f}
    frames = {s: cells(spark, sf_dir) if s == "cells" else table(spark, sf_dir, s) for s in sources}
    return spark.sql(SQL[name], **frames)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent values, one row each."""
    rows = derive(spark, sf_dir, "latents")
    return rows.select("vec_id", "uid", F.posexplode("vals").alias("pos", "v"))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, "latents")
    return rows.withColumn("shape", F.array("ch", "ht", "wd")).drop("ch", "ht", "wd")


def bad_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latents with NaN and infinities put in, as whole arrays again."""
    rows = latents(spark, sf_dir)
    at = lambda n, step: F.col("vec_id") % step == 0
    dirty = F.transform(
        F.col("vals").cast("array<double>"),
        lambda x, i: F.when((i == 0) & at(0, 25), F.lit(float("nan")))
        .when((i == 1) & at(1, 40), F.lit(float("inf")))
        .when((i == 2) & at(2, 80), F.lit(float("-inf")))
        .otherwise(x),
    )
    return rows.withColumn("vals", dirty)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved pairs of the derived preferences."""
    built = pool_ops.build_pool(derive(spark, sf_dir, "prefs"))
    return built.withColumnRenamed("source_split", "split").withColumn("row_idx", F.col("source_row_idx"))


def stored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as a written table, for chains that read it more than once."""
    return materialise(pool(spark, sf_dir))


def chunked(spark: SparkSession, sf_dir: str, per_user: int = -1) -> DataFrame:
    return shots.chunk_shots(stored_pool(spark, sf_dir), per_user=per_user)


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(embedding rows without their tensors, pool), both stored."""
    pairs = stored_pool(spark, sf_dir)
    return materialise(_embedding_rows(pairs)), pairs


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows without their tensors: supports, ids and shard."""
    return base(spark, sf_dir)[0]


def _embedding_rows(pairs: DataFrame) -> DataFrame:
    groups = shots.shot_groups(pairs, ["preferred_uid", "dispreferred_uid", "caption", "row_idx"])
    rows = groups.withColumn("source_embedding_row_idx", F.array_min(F.transform("pairs", lambda p: p["row_idx"])))
    supports = F.transform(
        "pairs",
        lambda p, i: F.struct(
            p["preferred_uid"].alias("preferred_uid"),
            p["dispreferred_uid"].alias("dispreferred_uid"),
            p["caption"].alias("caption"),
            i.alias("pair_idx"),
            F.concat(F.lit("support_"), i.cast("string")).alias("pair_key"),
            p["row_idx"].alias("source_row_idx"),
        ),
    )
    return (
        rows.withColumn("support_pairs", supports)
        .withColumn("user_embedding_id", assign.embedding_id(rows))
        .withColumn("shard_id", F.substring("user_id", -1, 1).cast("bigint"))
        .drop("pairs")
    )


def embedding_tensors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(user_embedding_id, emb): vectors of the preferred images, in shot order."""
    rows = embeddings(spark, sf_dir) if rows is None else rows
    vectors = derive(spark, sf_dir, "latents").select("uid", "vals")
    parts = rows.select("user_embedding_id", F.posexplode("support_pairs").alias("pos", "p")).select(
        "user_embedding_id", "pos", F.col("p.preferred_uid").alias("uid")
    )
    return (
        parts.join(vectors, "uid")
        .groupBy("user_embedding_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "vals"))).alias("emb"))
        .withColumn("emb", F.transform("emb", lambda e: e["vals"]))
    )


def assignments(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    rows, pairs = base(spark, sf_dir)
    return assign.build_assignments(rows, pairs, k=k, on_empty="skip")
