"""Tables that take each key once.

Rows are stored below write=<id>/bucket=<n>, where the bucket is a hash of the
key: a later write reads the key columns of the buckets its own keys fall into,
nothing else.  A write counts once its entry is in the ledger.  One that stopped
before that is not seen by readers and is cleared away by the next write; one
that is in the ledger is not done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions import keys as K
from pairloom.session import materialise
from pairloom.sources.payload_files import located

BUCKETS = 64
LEDGER = "_ledger"


def bucket_of(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def finished(path: str) -> list[str]:
    """Ids of the writes that count."""
    system, root = located(f"{path}/{LEDGER}")
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)))


def _clear(path: str, done: Sequence[str]) -> None:
    """Removes the rows of writes that never finished."""
    system, root = located(path)
    for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("write=") and found.base_name.removeprefix("write=") not in done:
            system.delete_dir(found.path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all finished writes with `bucket`, or None if there are none yet."""
    done = finished(path)
    if not done:
        return None
    rows = [f"{path}/write={w}" for w in done]
    return spark.read.option("basePath", path).parquet(*rows).drop("write")


def write_new(
    df: DataFrame, path: str, key: Sequence[str], write_id: str | None = None, buckets: int = BUCKETS, stop_before_ledger: bool = False
) -> DataFrame:
    """Adds the rows whose key the table lacks, one per key; one row: num_seen, num_written, num_skipped.

    A write whose id is in the ledger adds nothing.  Null keys are keys.  One
    writer at a time.  `stop_before_ledger` ends where a killed writer would;
    for tests.
    """
    spark, key = df.sparkSession, list(key)
    write_id = write_id or uuid.uuid4().hex
    done = finished(path)
    _clear(path, done)
    names = "num_seen bigint, num_written bigint, num_skipped bigint"
    seen = df.count()
    if write_id in done:
        return spark.createDataFrame([(seen, 0, seen)], names)
    fresh = materialise(df.dropDuplicates(key).withColumn("bucket", bucket_of(key, buckets)))
    there = known_keys(fresh, path, key)
    if there is not None:
        fresh = materialise(K.null_safe_join(fresh, there, key, "left_anti"))
    fresh.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/write={write_id}")
    if not stop_before_ledger:
        system, root = located(f"{path}/{LEDGER}")
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{write_id}", compression=None) as out:
            out.write(b"")
    written = fresh.count()
    return spark.createDataFrame([(seen, written, seen - written)], names)


def known_keys(fresh: DataFrame, path: str, key: Sequence[str]) -> DataFrame | None:
    """Keys of the table in the buckets that `fresh` has; other buckets are not opened."""
    there = read_keyed(fresh.sparkSession, path)
    if there is None:
        return None
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    return there.where(F.col("bucket").isin(touched)).select(*key)
