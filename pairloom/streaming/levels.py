"""A sink of keyed updates that stays small: levelled folders and a pointer.

Each micro-batch adds a folder.  As soon as FANOUT folders of one level are
there, they are merged into one of the next, which holds the newest row of each
key; so after n batches a reader opens a number of folders that grows with the
logarithm of n.  Which folders count is said by a pointer file that is written
beside the others and put in place by a rename: readers and a restarted writer
see the state before a merge or the one after it, whatever was going on when a
writer stopped.  Folders that a pointer has replaced are kept until the next one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.sources.payload_files import located

FANOUT = 8
BATCH = "__batch"

Merge = Callable[[DataFrame], DataFrame]


def newest(keys: Sequence[str]) -> Merge:
    """Keeps the row of the latest batch for each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("__r"))
        return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).where(F.col(BATCH).isNotNull())

    return merge


def _pointers(sink: str) -> list[tuple[int, str]]:
    system, root = located(f"{sink}/_pointer")
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((int(f.base_name[:-5]), f.path) for f in found if f.base_name.endswith(".json"))


def live(sink: str) -> list[dict]:
    """The folders that count now: name, level, first and last batch."""
    there = _pointers(sink)
    if not there:
        return []
    system, _ = located(sink)
    with system.open_input_stream(there[-1][1], compression=None) as stream:
        return json.loads(stream.read())


def _point(sink: str, folders: list[dict]) -> None:
    """Puts a new pointer in place, then removes what only pointers before the last one named."""
    there = _pointers(sink)
    system, root = located(f"{sink}/_pointer")
    system.create_dir(root, recursive=True)
    name = f"{root}/{(there[-1][0] if there else 0) + 1:012}.json"
    with system.open_output_stream(f"{name}.next", compression=None) as out:
        out.write(json.dumps(folders).encode())
    system.move(f"{name}.next", name)
    for _, old in there[:-1]:
        system.delete_file(old)
    kept = {f["name"] for f in folders}
    if there:
        with system.open_input_stream(there[-1][1], compression=None) as stream:
            kept |= {f["name"] for f in json.loads(stream.read())}
    data = located(f"{sink}/data")[1]
    for folder in system.get_file_info(fs.FileSelector(data, allow_not_found=True)):
        if folder.base_name not in kept:
            system.delete_dir(folder.path)


def _read(spark: SparkSession, sink: str, folders: list[dict]) -> DataFrame:
    return spark.read.parquet(*[f"{sink}/data/{f['name']}" for f in folders])


def add(batch: DataFrame, batch_id: int, sink: str, merge: Merge, fanout: int = FANOUT, stop_before_pointer: bool = False) -> None:
    """Adds a micro-batch once, however often it is handed in, and merges levels that are full.

    `stop_before_pointer` ends after the data are written, as a writer that is
    killed there does; for tests.
    """
    spark = batch.sparkSession
    folders = live(sink)
    if any(f["first"] <= batch_id <= f["last"] for f in folders):
        return
    name = f"l0-{batch_id}"
    batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{sink}/data/{name}")
    if stop_before_pointer:
        return
    folders = [*folders, {"name": name, "level": 0, "first": batch_id, "last": batch_id}]
    _point(sink, folders)
    level = 0
    while len(full := [f for f in folders if f["level"] == level]) >= fanout:
        first, last = min(f["first"] for f in full), max(f["last"] for f in full)
        name = f"l{level + 1}-{first}-{last}"
        merge(_read(spark, sink, full)).write.mode("overwrite").parquet(f"{sink}/data/{name}")
        folders = [f for f in folders if f["level"] != level] + [{"name": name, "level": level + 1, "first": first, "last": last}]
        _point(sink, folders)
        level += 1


def current(spark: SparkSession, sink: str, merge: Merge) -> DataFrame:
    """All updates merged, from the folders that count now."""
    return merge(_read(spark, sink, live(sink))).drop(BATCH)
