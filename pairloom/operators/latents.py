"""Latent manifests: field resolution, contracts, duplicates, sidecars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.functions import tensors as X
from pairloom.session import materialise


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def resolve_uid(df: DataFrame, path: str = "latent_path", prefer_file_name: bool = False) -> Column:
    """uid of a latent: the stored one, or the file stem (always with prefer_file_name)."""
    stem = K.trimmed_key(K.file_stem(F.col(path)))
    if prefer_file_name or "uid" not in df.columns:
        return stem
    return F.when(F.col("uid").isNotNull(), K.trimmed_key(F.col("uid"))).otherwise(stem)


def resolve_scaled(df: DataFrame, strict: bool = False) -> Column:
    """Scaling flag under either name, read as strict bool-like."""
    flags = [
        F.when(F.col(n).isNotNull(), K.bool_like_strict(F.col(n), df.schema[n].dataType, strict))
        for n in ("scaled", "apply_scaling")
        if n in df.columns
    ]
    if len(flags) == 2:
        return F.when(F.col("scaled").isNotNull(), flags[0]).otherwise(flags[1])
    return flags[0] if flags else F.lit(None).cast("boolean")


def resolve_source_path(df: DataFrame) -> Column:
    named = _present(df, ("source_image_path", "original_image_path"))
    return F.coalesce(*[c.cast("string") for c in named]) if named else F.lit(None).cast("string")


def bundle_stats(df: DataFrame, stats: str = "stats", values: str | None = "vals", strict: bool = True) -> Column:
    """Stored statistics under either of their names, else computed, else null.

    A stored bundle that lacks one of the four fails when strict.
    """
    names = df.schema[stats].dataType.fieldNames() if stats in df.columns else []
    given = F.col(stats).isNotNull() if names else F.lit(False)
    computed = basic_stats(F.col(values)) if values and values in df.columns else None
    out = []
    for field in ("min", "max", "mean", "std"):
        found = [F.col(stats)[n].cast("double") for n in (field, f"{field}_value") if n in names]
        stored = F.coalesce(*found) if found else F.lit(None).cast("double")
        if strict:
            stored = F.coalesce(stored, F.raise_error(F.lit(f"stored statistics lack {field}")).cast("double"))
        fallback = computed[field] if computed is not None else F.lit(None).cast("double")
        out.append(F.when(given, stored).otherwise(fallback).alias(field))
    return F.struct(*out)


def basic_stats(values: Column) -> Column:
    """min, max, mean and population std of one tensor."""
    return X.let(
        X.mean(values),
        lambda centre: F.struct(
            F.array_min(X.doubles(values)).alias("min"),
            F.array_max(X.doubles(values)).alias("max"),
            centre.alias("mean"),
            X.population_std(values, centre).alias("std"),
        ),
    )


def build_manifest(
    latents: DataFrame,
    paths: DataFrame | None = None,
    meta: DataFrame | None = None,
    prefer_file_name: bool = False,
    compute_stats: bool = True,
) -> DataFrame:
    """Manifest rows of a latent table, duplicates included."""
    text = lambda n: F.col(n).cast("string") if n in latents.columns else F.lit(None).cast("string")
    stats = bundle_stats(latents, values="vals" if compute_stats else None)
    rows = latents.select(
        resolve_uid(latents, prefer_file_name=prefer_file_name).alias("uid"),
        "latent_path",
        F.col("shape").cast("array<int>").alias("shape"),
        F.coalesce(text("dtype"), F.lit("float32")).alias("dtype"),
        resolve_scaled(latents).alias("scaled"),
        text("latent_semantics").alias("latent_semantics"),
        resolve_source_path(latents).alias("source_image_path"),
        text("latent_format_version").alias("latent_format_version"),
        stats.alias("s"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "s"], "s.*")
    if paths is not None:
        known = K.one_per_key(paths.filter(F.col("path").isNotNull()), "uid", "path")
        rows = rows.join(known.withColumnRenamed("path", "uid_to_path_value"), "uid", "left")
    if meta is not None:
        rows = rows.join(K.one_per_key(meta, "uid", "uid_meta"), "uid", "left")
    return rows


def mark_duplicates(rows: DataFrame, key: str = "uid", order: str = "latent_path", fail: bool = False) -> DataFrame:
    """Adds `first_path` and `is_duplicate`: all but the first path of a uid, and all but one of equal paths.

    The first row comes from a combining aggregate and is joined back, so a uid
    with any number of copies is never ranked in one task.  Rows are stored with
    a number of their own, which decides among equal paths; null paths come
    last, and rows without a uid are copies of each other like any others.
    """
    stored = materialise(rows.withColumn("__row", F.monotonically_increasing_id()))
    place = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("path"), F.col("__row").alias("row"))
    firsts = stored.groupBy(key).agg(F.min(place).alias("__first"))
    marked = (
        K.null_safe_join(stored, firsts, [key])
        .withColumn("first_path", F.col("__first.path"))
        .withColumn("is_duplicate", F.col("__first.row") != F.col("__row"))
        .drop("__first", "__row")
    )
    if fail:
        marked = marked.withColumn(
            "is_duplicate",
            F.when(F.col("is_duplicate"), F.raise_error(F.concat(F.lit("duplicate uid "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
            .otherwise(F.lit(False)),
        )
    return marked


def contract_reason(
    df: DataFrame,
    shape: Sequence[int] = C.LATENT_SHAPE,
    semantics: str = C.LATENT_SEMANTICS,
    scaled: bool = C.LATENT_SCALED,
) -> Column:
    """First way a manifest row breaks the training contract, null if it does not."""
    return F.coalesce(
        F.when(K.is_blank(F.col("uid")), F.lit("missing_uid")),
        F.when(F.coalesce(F.col("scaled") != F.lit(scaled), F.lit(True)), F.lit("scaled")),
        F.when(F.coalesce(F.col("latent_semantics") != semantics, F.lit(True)), F.lit("latent_semantics")),
        F.when(~X.shape_equals(F.col("shape"), shape), F.lit("shape")),
    )


def contract_filter(df: DataFrame, strict: bool = False, **contract) -> DataFrame:
    """Rows that meet the contract; strict fails on the first that does not."""
    marked = df.withColumn("__reason", contract_reason(df, **contract))
    ok = F.col("__reason").isNull()
    if strict:
        ok = F.when(ok, True).otherwise(
            F.raise_error(F.concat(F.lit("latent contract broken: "), F.col("__reason"))).cast("boolean")
        )
    return marked.filter(ok).drop("__reason")


def shape_check(df: DataFrame, expected: Sequence[int], policy: str = "warn", shape: str = "shape") -> DataFrame:
    """Adds shape_match and, under `warn`, a warning text; `strict` fails on a mismatch."""
    if policy not in ("strict", "warn", "none"):
        raise ValueError("policy must be strict, warn or none")
    match = X.shape_equals(F.col(shape), expected)
    note = F.concat(F.lit("shape mismatch for "), F.col("uid"))
    if policy == "strict":
        match = F.when(match, True).otherwise(F.raise_error(note).cast("boolean"))
    warning = F.when(~match, note) if policy == "warn" else F.lit(None).cast("string")
    return df.withColumn("shape_match", match).withColumn("warning", warning)


def expected_spatial(height: Column, width: Column, multiple: float) -> Column:
    """Latent height and width of an image size."""
    if multiple <= 0:
        raise ValueError("multiple must be positive")
    up = lambda v: F.ceil(v / F.lit(float(multiple))).cast("bigint")
    return F.struct(up(height).alias("h"), up(width).alias("w"))


def preprocess_size(height: Column, width: Column, multiple: float, fixed: tuple[int, int] | None = None) -> Column:
    """Encoder input size: 32 times the latent size, or a fixed one."""
    if fixed:
        return F.struct(F.lit(fixed[0]).cast("bigint").alias("h"), F.lit(fixed[1]).cast("bigint").alias("w"))
    size = expected_spatial(height, width, multiple)
    return F.struct((size["h"] * 32).alias("h"), (size["w"] * 32).alias("w"))


def reconcile_sidecars(sidecars: DataFrame, latents: DataFrame) -> DataFrame:
    """Status of each sidecar against the latent with its stem in its folder.

    Inputs carry `json_path` + `latent_path`, and `path` of the latent files.
    """
    def bare(path: Column) -> Column:
        return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")

    left = sidecars.withColumn("__at", bare(F.col("json_path")))
    right = latents.select(bare(F.col("path")).alias("__at"), F.col("path").alias("next_latent_path"))
    status = (
        F.when(F.col("next_latent_path").isNull(), "missing_pt")
        .when(F.col("latent_path").eqNullSafe(F.col("next_latent_path")), "unchanged")
        .otherwise("updated")
    )
    return (
        left.join(right, "__at", "left")
        .withColumn("status", status)
        .withColumn("previous_latent_path", F.when(F.col("status") == "updated", F.col("latent_path")))
        .drop("__at")
    )


def sidecar_record(encoded: DataFrame, expected: Sequence[int], semantics: str = C.LATENT_SEMANTICS) -> DataFrame:
    """Sidecar struct of each encoded latent."""
    stats = basic_stats(F.col("vals"))
    return encoded.withColumn(
        "sidecar",
        F.struct(
            F.col("uid"),
            F.col("latent_path"),
            F.col("source_image_path"),
            F.array(*[F.lit(d) for d in expected]).alias("expected_latent_shape"),
            F.col("shape").alias("actual_latent_shape"),
            X.shape_equals(F.col("shape"), expected).alias("shape_match"),
            F.lit(False).alias("scaling_applied"),
            F.lit(semantics).alias("latent_semantics"),
            stats.alias("stats"),
        ),
    )


def reshard_plan(files: DataFrame, root: str) -> DataFrame:
    """Where each file of a flat folder goes: below the first two characters of its stem."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    shard = K.stem_shard(K.file_stem(F.col("path")))
    return files.withColumn("shard", shard).withColumn("target", F.concat_ws("/", F.lit(root), shard, name))
