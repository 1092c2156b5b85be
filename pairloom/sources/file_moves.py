"""Files moved and sidecars rewritten, by a plan that is stored before anything happens.

The plan says for every file where it goes.  Tasks look at both places before
they act, so an attempt that is repeated, or a whole run that is repeated after
one that ended half-way, finds what was done and does the rest.  A target that
exists is never overwritten.  What became of every file is stored beside the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.operators.latents import reshard_plan
from pairloom.session import map_arrow
from pairloom.sources.payload_files import located

# Files that one task sees to.
FILES = 512


def plan_moves(files: DataFrame, root: str, journal: str) -> DataFrame:
    """Stores and returns the plan: path, target, length, first (of several files with one target only one can move).

    `files` has path and length.  A journal that has a plan already keeps it.
    """
    spark = files.sparkSession
    path = f"{journal}/plan"
    system, place = located(f"{path}/_SUCCESS")
    if system.get_file_info(place).type == fs.FileType.NotFound:
        plan = reshard_plan(files.select("path", "length"), root.rstrip("/")).select("path", "target", "length")
        least = plan.groupBy("target").agg(F.min("path").alias("__least"))
        plan.join(least, "target").select("path", "target", "length", (F.col("path") == F.col("__least")).alias("first")).write.mode(
            "overwrite"
        ).parquet(path)
    return spark.read.parquet(path)


def _seen(uri: str) -> int | None:
    """Size of a file, null if there is none."""
    system, path = located(uri)
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _move(row: dict) -> str:
    """moved, kept (it is in its place), blocked (the target is another file) or lost."""
    if row["path"] == row["target"]:
        return "kept"
    source, there = _seen(row["path"]), _seen(row["target"])
    if source is None:
        # An attempt before this one has moved it.
        return "moved" if there == row["length"] else "lost"
    if there is not None or not row["first"]:
        return "blocked"
    system, path = located(row["path"])
    target = located(row["target"])[1]
    system.create_dir(target.rpartition("/")[0], recursive=True)
    system.move(path, target)
    return "moved"


def _rewrite(row: dict) -> str:
    """updated, unchanged, missing_pt (no latent) or broken (no JSON object)."""
    if row["next_latent_path"] is None:
        return "missing_pt"
    system, path = located(row["json_path"])
    with system.open_input_stream(path, compression=None) as stream:
        raw = stream.read()
    try:
        document = json.loads(raw)
    except ValueError:
        return "broken"
    if not isinstance(document, dict):
        return "broken"
    if document.get("latent_path") == row["next_latent_path"]:
        # Also what an attempt before this one has written.
        return "unchanged" if row["latent_path"] == row["next_latent_path"] else "updated"
    document["latent_path"] = row["next_latent_path"]
    # Readers see the old document or the new one; a lost attempt leaves a hidden file that the next one replaces.
    folder, _, name = path.rpartition("/")
    fresh = f"{folder}/.{name}.next"
    with system.open_output_stream(fresh, compression=None) as out:
        out.write((json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode())
    system.move(fresh, path)
    return "updated"


def _done(plan: DataFrame, act: Callable[[dict], str], journal: str, kind: str) -> DataFrame:
    """Acts on every row of a stored plan, in tasks of FILES rows, and stores the rows with their status."""
    names = plan.columns
    schema = f"{', '.join(f'{n} {t}' for n, t in plan.dtypes)}, status string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status = pa.array([act(row) for row in batch.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, status], names=[*names, "status"])

    # The number is given: rows as small as these would else be put into one task.
    tasks = max(1, -(-plan.count() // FILES))
    path = f"{journal}/{kind}"
    map_arrow(plan.repartition(tasks, names[0]), run, schema).write.mode("overwrite").parquet(path)
    return plan.sparkSession.read.parquet(path)


def move_files(spark: SparkSession, journal: str) -> DataFrame:
    """Carries out the stored plan; path, target, length, first, status of every file.

    Statuses: moved, kept, blocked, lost.  May be repeated at any time: the
    folder ends the same, and no file is moved twice.
    """
    return _done(spark.read.parquet(f"{journal}/plan"), _move, journal, "moves")


def rewrite_sidecars(statuses: DataFrame, journal: str) -> DataFrame:
    """Writes next_latent_path into every sidecar; json_path, latent_path, next_latent_path, status.

    `statuses` is what `latents.reconcile_sidecars` returns.  The plan with the
    paths found at first is stored, so a repeated run reports the same.
    """
    spark = statuses.sparkSession
    path = f"{journal}/sidecar-plan"
    system, place = located(f"{path}/_SUCCESS")
    if system.get_file_info(place).type == fs.FileType.NotFound:
        one = F.row_number().over(Window.partitionBy("json_path").orderBy("next_latent_path"))
        statuses.select("json_path", "latent_path", "next_latent_path", one.alias("nth")).where("nth = 1").drop("nth").write.mode(
            "overwrite"
        ).parquet(path)
    return _done(spark.read.parquet(path), _rewrite, journal, "sidecars")
