"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.session import materialise

def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, nulls written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_uid_map(df: DataFrame, path: str, mode: str = "error") -> None:
    """uid -> value table."""
    df.write.mode(mode).parquet(path)


def export_uid_map(df: DataFrame, path: str, key: str = "uid", value: str = "path") -> None:
    """The map as JSON objects of one entry each, one per line over the part files, in key order within each."""
    entry = F.to_json(F.map_from_entries(F.array(F.struct(F.col(key).cast("string"), F.col(value)))))
    df.filter(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key).select(entry.alias("value")).write.text(path)


def write_summary(df: DataFrame, path: str, **parameters) -> None:
    """One-row counts with the run's parameters."""
    df.select("*", *[F.lit(v).alias(k) for k, v in parameters.items()]).coalesce(1).write.json(path)


def write_uid_list(df: DataFrame, path: str, sort_by_uid: bool = False, order: str = "place") -> None:
    """One uid per line over the part files, in uid order or in the order column."""
    ordered = df.orderBy("uid" if sort_by_uid or order not in df.columns else order)
    ordered.select(F.col("uid").cast("string")).write.text(path)


def export_uid_list(df: DataFrame, path: str, field: str = "uids", order: str = "uid") -> None:
    """The list in order over the part files of path/items, and {num_field: n} as a document in path/count."""
    write_uid_list(df, f"{path}/items", order=order)
    df.agg(F.count(F.lit(1)).alias(f"num_{field}")).coalesce(1).write.json(f"{path}/count")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "error") -> None:
    """CSV with a header and a fixed column order; absent columns are empty."""
    cells = [(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in columns]
    df.select(*cells).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)


def write_sample_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Per-sample statistics; the shape is written as 1x16x24x24."""
    shaped = df.withColumn("shape", F.array_join(F.col("shape").cast("array<string>"), "x")) if "shape" in df.columns else df
    write_csv(shaped, path, C.SAMPLE_CSV_COLUMNS, mode)


def write_histogram_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Histogram bins."""
    write_csv(df.orderBy("bin_left"), path, C.HISTOGRAM_CSV_COLUMNS, mode)


def with_shard(df: DataFrame, uid: str = "uid") -> DataFrame:
    """Adds the folder a uid's files live in."""
    return df.withColumn("shard", K.stem_shard(K.path_stem(F.col(uid))))


def write_sharded(df: DataFrame, path: str, uid: str = "uid", mode: str = "error", files_per_shard: int = 0) -> None:
    """Rows in one folder per uid prefix.

    A prefix may hold a third of all rows, so rows are spread by (shard, salt)
    when a number of files per shard is given, never by shard alone.
    """
    rows = with_shard(df, uid)
    if files_per_shard > 0:
        salt: Column = F.pmod(F.xxhash64(uid), F.lit(files_per_shard))
        rows = rows.repartition(F.col("shard"), salt)
    rows.write.mode(mode).partitionBy("shard").parquet(path)


def write_missing(df: DataFrame, path: str, key: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Appends only rows whose key the target lacks, one per key; rewrites everything with overwrite.

    Returns one row: num_seen, num_written, and num_skipped because the key was
    there already or came twice.  Null keys are keys.
    """
    spark, key = df.sparkSession, list(key)
    fresh = materialise(df.dropDuplicates(key))
    there = None
    if not overwrite:
        try:
            there = spark.read.parquet(path)
        except AnalysisException:  # there is no target yet
            there = None
    if there is not None:
        fresh = materialise(K.null_safe_join(fresh, there.select(*key).distinct(), key, "left_anti"))
    fresh.write.mode("overwrite" if there is None else "append").parquet(path)
    seen, written = df.agg(F.count(F.lit(1)).alias("n")), fresh.agg(F.count(F.lit(1)).alias("num_written"))
    counts = written.select(seen.scalar().alias("num_seen"), "num_written")
    return counts.withColumn("num_skipped", F.col("num_seen") - F.col("num_written"))


def publish_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables, one partition per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Adds rows to a metrics log."""
    df.write.mode("append").json(path)
