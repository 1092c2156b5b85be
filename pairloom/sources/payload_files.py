"""Payloads as files: a data source that writes one file per row and publishes a job's files at once.

Tasks write below a hidden folder of their job, each attempt in one of its own.
Committing removes what attempts without a message left there and renames the
folder, so readers see all files of a job or none; a failed job leaves nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pairloom.functions import keys as K
from pairloom.session import importable
from pairloom.sources.file_lists import list_tree, located, read_files


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int
    bytes: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"

    def write(self, iterator) -> Written:
        attempt = uuid.uuid4().hex
        system, root = located(f"{self.staging}/{attempt}")
        files = size = 0
        folders = set()
        for row in iterator:
            folder = f"{root}/{row['folder']}"
            if folder not in folders:
                # The job's folder is gone once it has failed; a task that still runs then must not bring it back.
                if system.get_file_info(root.rpartition("/")[0]).type == fs.FileType.NotFound:
                    raise RuntimeError("the write has been given up")
                system.create_dir(folder, recursive=True)
                folders.add(folder)
            payload = bytes(row["payload"])
            with system.open_output_stream(f"{folder}/{row['name']}", compression=None) as out:
                out.write(payload)
            files, size = files + 1, size + len(payload)
        return Written(attempt, files, size)

    def commit(self, messages) -> None:
        system, root = located(self.staging)
        done = {m.attempt for m in messages if m and m.files}
        if not done:
            self.abort(messages)
            return
        for left in system.get_file_info(fs.FileSelector(root)):
            if left.base_name not in done:
                system.delete_dir(left.path)
        system.move(root, located(f"{self.path}/part-{self.job}")[1])

    def abort(self, messages) -> None:
        system, root = located(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class PayloadFiles(DataSource):
    """Rows (folder, name, payload) become files path/part-<job>/<attempt>/<folder>/<name>."""

    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return "folder string, name string, payload binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        writer = _Writer(self.options["path"])
        system, root = located(writer.staging)
        system.create_dir(root, recursive=True)
        return writer


def file_name(uid: Column, extension: str = "bin") -> Column:
    """A name that no other uid has: the path-safe form, with a digest where that is not the uid itself."""
    stem = K.path_stem(uid)
    told_apart = F.when(stem == uid, stem).otherwise(F.concat_ws("-", stem, F.substring(F.md5(uid), 1, 12)))
    return F.concat(told_apart, F.lit(f".{extension}"))


def write_payloads(df: DataFrame, path: str, extension: str = "bin", uid: str = "uid", payload: str = "payload", tasks: int = 0) -> None:
    """One file per row with a payload, below the first two characters of its stem.

    Rows are written where they are, so a common prefix is spread over tasks; small
    payloads, of which few tasks would write very many, may be dealt out over a
    number of tasks first.  Uids must not repeat.
    """
    spark = df.sparkSession
    importable(spark)
    spark.dataSource.register(PayloadFiles)
    rows = df.where(F.col(payload).isNotNull() & F.col(uid).isNotNull()).select(
        K.stem_shard(K.path_stem(F.col(uid))).alias("folder"), file_name(F.col(uid), extension).alias("name"), F.col(payload).alias("payload")
    )
    if tasks:
        rows = rows.repartition(tasks, "name")
    rows.write.format("payload_files").mode("append").save(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, payload) of all published files; empty ones are left out."""
    files = read_files(list_tree(spark, path))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("content").alias("payload"))
