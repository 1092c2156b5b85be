"""Lists of files made by tasks, and small files read by them.

Spark's own scan lists every file on the driver and keeps the list there, which
a folder of millions of small files doesn't allow.  Here a task lists a folder;
what it finds stays in a table, and folders below go on to the next round, so
the driver learns nothing but counts.  Rules are those of Spark's scans: names
that begin with a dot or an underscore are hidden, and empty files are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.session import map_arrow, materialise

# Names a task lists before it leaves the folders below to the next round; folders, files and bytes that one task sees to.
NAMES, FOLDERS, FILES, BYTES = 4096, 256, 4096, 128 << 20
# Bytes of contents, and rows, that are handed on at once.
HELD, ROWS = 4 << 20, 4096
_GLOB = re.compile(r"[*?\[\]{}]")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location as Spark names it; local names are taken as they are."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def glob_pattern(glob: str) -> re.Pattern:
    """Pattern of names that a glob with *, ?, [...] and {a,b} matches."""
    out, at, braces = "", 0, 0
    while at < len(glob):
        char = glob[at]
        close = glob.find("]", at + 2)
        if char == "[" and close > 0:
            body = glob[at + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            at = close
        elif char == "\\" and at + 1 < len(glob):
            at += 1
            out += re.escape(glob[at])
        elif char == "{" or char == "}" and braces:
            braces += 1 if char == "{" else -1
            out += "(?:" if char == "{" else ")"
        else:
            out += {"*": ".*", "?": "."}.get(char) or ("|" if char == "," and braces else re.escape(char))
        at += 1
    return re.compile(out + r"\Z", re.DOTALL)


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(uri: str) -> Iterator[tuple[str, int | None]]:
    """(name, length) of what a folder holds; folders have no length."""
    system, path = located(uri)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                try:
                    yield entry.name, None if entry.is_dir() else entry.stat().st_size
                except FileNotFoundError:
                    # It has gone in the meantime.
                    continue
        return
    for info in system.get_file_info(fs.FileSelector(path)):
        yield info.base_name, info.size if info.type == fs.FileType.File else None


def _walk(glob: str, recursive: bool):
    """mapInArrow function: folders (path, rest) become files with a length, and folders for the next round.

    `rest` holds the parts of a pattern that the names below have to match.
    """
    schema = pa.schema([("path", pa.string()), ("rest", pa.string()), ("length", pa.int64())])

    def one(uri: str, rest: str) -> Iterator[tuple[str, str | None, int | None]]:
        part, _, later = rest.partition("/")
        pattern = glob_pattern(part) if part else None
        ending = glob_pattern(glob)
        for name, length in _entries(uri):
            if _hidden(name) or pattern and not pattern.match(name):
                continue
            if length is None:
                if part or recursive or "=" in name:
                    yield f"{uri.rstrip('/')}/{name}", later, None
            elif length and not later and ending.match(name):
                yield f"{uri.rstrip('/')}/{name}", None, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows, names = [], 0
        below: list[tuple[str, str]] = []
        for batch in batches:
            given = [(r["path"], r["rest"]) for r in batch.to_pylist()]
            # Folders that were given are listed in any case, others as long as there are few names.
            while given or below and names < NAMES:
                for row in one(*(given or below).pop()):
                    names += 1
                    if row[2] is None:
                        below.append(row[:2])
                        continue
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pack(rows)
                        rows = []
        rows += [(*folder, None) for folder in below]
        if rows:
            yield pack(rows)

    return run


def _roots(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str | None, int | None]]:
    """Where the lists begin: the folder before the first name with a pattern, or a file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for given in paths:
        path = hadoop.Path(given)
        parts = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().split("/")
        at = next((n for n, part in enumerate(parts) if _GLOB.search(part)), len(parts))
        root = "/".join(parts[:at])
        system, place = located(root)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no file or folder {root}")
        out.append((root, "/".join(parts[at:]), None) if info.type == fs.FileType.Directory else (root, None, info.size))
    return out


def list_tree(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length) of the files below folders, or named by patterns, whose names match a glob; stored.

    Without `recursive` only folders named key=value are entered.  A single
    folder is the work of one task, however many names it has.
    """
    roots = _roots(spark, [paths] if isinstance(paths, str) else list(paths))
    schema = "path string, rest string, length bigint"
    named = [r for r in roots if r[2] and glob_pattern(glob).match(r[0].rpartition("/")[2])]
    files = [spark.createDataFrame(named, schema)] if named else []
    folders = [r for r in roots if r[1] is not None]
    at, count = spark.createDataFrame(folders, schema).repartition(len(folders)) if folders else None, len(folders)
    while count:
        found = materialise(map_arrow(at, _walk(glob, recursive), schema))
        files.append(found.where("length IS NOT NULL"))
        at = found.where("length IS NULL")
        count = at.count()
        # The number is given: a list of folders is small, but not the work on it.
        at = at.repartition(max(1, min(count, spark.sparkContext.defaultParallelism), -(-count // FOLDERS)))
    every = files[0] if files else spark.createDataFrame([], schema)
    for more in files[1:]:
        every = every.unionByName(more)
    if any(rest for _, rest, _ in roots) and every.isEmpty():
        raise FileNotFoundError(f"no file matches {paths}")
    return every.select("path", "length")


def dealt_out(files: DataFrame) -> DataFrame:
    """Stored (path, length) rows over as many tasks as their number and size ask for."""
    facts = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(facts[0], files.sparkSession.sparkContext.defaultParallelism), -(-facts[0] // FILES), -(-facts[1] // BYTES))
    return files.repartition(tasks, "path")


def read_files(files: DataFrame) -> DataFrame:
    """(path, content) of whole small files, for stored (path, length) rows."""
    kinds = [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "content"])
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, place = located(uri)
                with system.open_input_file(place) as file:
                    rows.append((uri, file.read()))
                held += len(rows[-1][1])
                if held > HELD or len(rows) >= ROWS:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return map_arrow(dealt_out(files), run, "path string, content binary")
