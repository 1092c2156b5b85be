"""Scans of tables and folders."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.sources.file_lists import list_tree


def row_numbers(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds row_idx: the place of a Parquet row in its split, by file and row in file.

    The reader knows each row's place in its file; only the file sizes are
    aggregated to turn that into a running number, so no row is sorted or moved.
    Rows with a null key are numbered as rows of one more key.
    """
    keys = list(keys)
    located = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    sizes = located.groupBy(*keys, "__f").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(K.natural_key(F.col("__f"))).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        K.null_safe_join(located, starts, [*keys, "__f"]).withColumn("row_idx", F.col("__s") + F.col("__r")).drop("__f", "__r", "__s")
    )


def read_preferences(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Preference rows of all splits, or of one (partition pruning), with split and row_idx."""
    df = spark.read.parquet(path)
    if "split" not in df.columns:
        df = df.select("*", F.lit("unspecified").alias("split"))
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df if "row_idx" in df.columns else row_numbers(df, ["split"])


def scan_images(spark: SparkSession, root: str, extensions: Sequence[str] = C.IMAGE_EXTENSIONS) -> DataFrame:
    """uid and path of every image below a folder; file contents are not read."""
    files = list_tree(spark, root)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ending.isin(*extensions)).select(K.file_stem(F.col("path")).alias("uid"), "path", "length")


def scan_latents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Latent rows (`vals`, `shape`, ...) from Parquet files below a folder, or directly in it."""
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    path = root if recursive else f"{root.rstrip('/')}/*.parquet"
    rows = reader.parquet(path)
    return rows if "latent_path" in rows.columns else rows.select("*", F.col("_metadata.file_path").alias("latent_path"))


def list_files(spark: SparkSession, root: str, pattern: str, recursive: bool = True) -> DataFrame:
    """Paths of files whose name matches a glob."""
    return list_tree(spark, root, pattern, recursive)


def natural_sort_key(path: str) -> list:
    """Sort key of a file name in which digit runs compare as numbers."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", path) if p]


def expand_shards(spark: SparkSession, patterns: Sequence[str], required: bool = True) -> list[str]:
    """File names for globs and paths: distinct, in natural order; a glob without a match is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found: dict[str, None] = {}
    for pattern in patterns:
        path = hadoop.Path(pattern)
        matches = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not matches:
            raise FileNotFoundError(f"no file matches {pattern}")
        found.update((m.getPath().toString(), None) for m in matches)
    if required and not found:
        raise ValueError("no shard files given")
    return sorted(found, key=natural_sort_key)


def shard_files(paths: DataFrame, split: str | None = None) -> DataFrame:
    """Shard files with their split and shard number."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = paths.withColumn("name", name).withColumn("split", K.shard_split(name)).withColumn("shard_id", K.shard_number(name))
    return rows if split is None else rows.filter(F.col("split") == split)
