"""Helpers several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import map_arrow  # noqa: F401

# White space that ends a word: code points 32 and 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 8 << 20


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def encoded(name: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return text_or_empty(name).cast("binary")


def spare(df: DataFrame, wish: str) -> str:
    """A column name that the table doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `limit` bytes of the binary column, or one row where that is longer."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def row_key(id_column: str, text: str) -> Column:
    """A digest of a row's id and text, the same for repeated rows only."""
    shown = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    return F.sha2(F.concat(shown, F.lit("\n"), text_or_empty(text)), 256)


def surviving(docs: DataFrame, verdicts: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    `verdicts` has the row_key and `kept` of each row, in which at most one of
    repeated rows is kept.  Only what must go, or stay once, is joined; whole
    rows are moved once and never stored.
    """
    key, once, nth = spare(docs, "__key"), spare(docs, "__once"), spare(docs, "__nth")
    known = verdicts.groupBy("key").agg(F.max("kept").alias(once), F.count(F.lit(1)).alias("n"))
    decided = known.where(~F.col(once) | (F.col("n") > 1)).select(F.col("key").alias(key), once)
    joined = docs.withColumn(key, row_key(id_column, text)).join(decided, key, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    stays = F.col(once).isNull() | (F.col(once) & (F.col(nth) == 1))
    return joined.withColumn(nth, first).where(stays).drop(key, once, nth)
