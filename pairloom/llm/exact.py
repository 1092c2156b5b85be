"""Exact dedup with a heavy-hitter split.

Every partition keeps a Misra-Gries summary of its digests.  The summaries are
merged; what may be frequent is counted exactly, and the verified winners, of
which there are at most `heavy`, are broadcast: their rows find their group
without a shuffle.  All other digests are frequent in no more than one row in
`heavy` and go through an ordinary shuffled aggregation and join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import map_arrow, row_key, surviving, text_or_empty
from pairloom.session import materialise

# Digests in more than one row of HEAVY are split off, so there are at most as many.
HEAVY = 512


def misra_gries(df: DataFrame, digest: str, counters: int) -> DataFrame:
    """One summary per partition: digest, low (count less an error of at most seen / (counters + 1)), seen.

    A row without a digest carries the partition's row count.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            for pair in pc.value_counts(batch.column(0)).to_pylist():
                held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
            if len(held) > counters:
                # As mergeable summaries are cut: take the next largest count off all.
                cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
                held = {k: n - cut for k, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays(
            [pa.array([*held, None], pa.string()), pa.array([*held.values(), 0], pa.int64()), pa.array([0] * len(held) + [seen], pa.int64())],
            names=["digest", "low", "seen"],
        )

    return map_arrow(df.select(digest), summarise, "digest string, low bigint, seen bigint")


def frequent(rows: DataFrame, digest: str, heavy: int = HEAVY) -> tuple[DataFrame, int]:
    """Digests that may be in more than one row of `heavy` (twice as many at most), and the number of rows."""
    found = materialise(misra_gries(rows, digest, 2 * heavy))
    total = found.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    likely = (
        found.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.sum("low").alias("low"))
        .where(F.col("low") * 2 * heavy > F.lit(total) - 1)
        .select(F.col("digest").alias(digest))
    )
    return likely, total


def keepers(rows: DataFrame, digest: str, id_column: str, row: str, heavy: int = HEAVY) -> DataFrame:
    """The rows with keep_id, group_size and kept.

    Of rows with one digest the largest id stays (null ids are smallest); where
    that id is repeated, the row with the largest value of the unique column
    `row`.  `rows` must be stored (it is read several times) and narrow.
    """
    best = F.max(F.struct(F.col(id_column), F.col(row))).alias("__best")
    size = F.count(F.lit(1)).alias("group_size")
    likely, total = frequent(rows, digest, heavy)
    counted = rows.join(F.broadcast(likely), digest).groupBy(digest).agg(best, size)
    winners = materialise(counted.where(F.col("group_size") * heavy > total))
    often = rows.join(F.broadcast(winners), digest)
    others = rows.join(F.broadcast(winners.select(digest)), digest, "left_anti")
    rare = others.join(others.groupBy(digest).agg(best, size), digest)
    return (
        often.unionByName(rare)
        .withColumn("keep_id", F.col(f"__best.{id_column}"))
        .withColumn("kept", F.col(f"__best.{row}") == F.col(row))
        .drop("__best")
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are (by SHA-256); a null text is an
    empty one.  Repeated rows each get a row, one of them is kept.  A null id
    can only stay if all ids of its group are null.  An empty table gives an
    empty result; other columns are ignored.
    """
    rows = materialise(
        docs.select(
            F.col(f"`{id_column}`").alias(id_column),
            F.sha2(text_or_empty(text), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    return keepers(rows, "text_sha256", id_column, "__row", heavy).select(
        id_column, "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    Of equal texts (null: empty) the row with the largest id, null ids last; of
    repeated rows one.  An empty table gives an empty one.
    """
    rows = materialise(
        docs.select(
            F.col(f"`{id_column}`").alias("id"),
            F.sha2(text_or_empty(text), 256).alias("digest"),
            row_key(id_column, text).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    return surviving(docs, keepers(rows, "digest", "id", "row", heavy), id_column, text)
