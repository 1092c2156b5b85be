"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# The folder taken where a local session names none; it goes when the process ends.
_LOCAL: list[str] = []
# Paths below the shared folder that this process has handed out.
_MADE: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "pairloom") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAIRLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    A temporary folder is only taken where the setting is missing and the
    session is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_table() -> str:
    """A fresh name for a table in the session's catalogue; release() drops it."""
    _MADE.append(f"table:t{uuid.uuid4().hex}")
    return _MADE[-1].removeprefix("table:")


def made() -> int:
    """How many paths have been handed out and not been released; a mark for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the tables and files this process has put below the shared folder; returns how many paths there were.

    Only those handed out after the mark `since` go, and none that `keep` reads.
    To be called when results are written: other DataFrames that still read such
    a table fail afterwards.
    """
    read = [] if keep is None else keep.inputFiles()
    held = [p for p in _MADE[since:] if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in read)]
    gone = 0
    for name in _MADE[since:]:
        if name.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {name.removeprefix('table:')}")
        elif name not in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[since:] = held
    return gone


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    The rows are computed once, every later reader sees the same ones, a lost
    executor costs no recomputation of what came before, and the planner gets
    real sizes to choose joins by.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets local workers import this package; on a cluster it is installed or sent by --py-files."""
    settings = spark.sparkContext.environment
    paths = settings.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package importable by the workers."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)
