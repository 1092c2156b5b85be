"""Shards of near equal bytes: minimax contiguous partition of groups of equal texts.

Groups are put in the order of their digests.  The smallest capacity that lets
all groups fit into the shards, contiguously, is found by binary search with a
greedy check; then the shards are cut.  The sizes of all groups never meet in
one place: the driver holds the sums of digest ranges, of which the search
treats those with several groups as divisible.  Only ranges that a cut falls
into are split further, by a small aggregation, until every cut lies between
two groups; the capacity is then exactly that of the full list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import text_or_empty
from pairloom.operators.ranking import position_by_sort
from pairloom.session import materialise

SHARDS = 24
# Hex digits of the first ranges, and of each further split.
FIRST, NEXT = 4, 2
# A range of at most so many groups is split into its groups.
SMALL = 4096

# prefix, bytes, bytes of the largest group, groups
Range = tuple[str, int, int, int]


@dataclass
class Ranges:
    """Consecutive digest ranges with their sums; `split` lists what a set of ranges holds in finer ones."""

    items: list[Range]
    split: Callable[[list[Range]], list[Range]]
    ends: np.ndarray = field(init=False)
    divisible: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.items.sort()
        self.ends = np.cumsum(np.array([i[1] for i in self.items], np.int64))
        self.divisible = np.array([i[3] > 1 for i in self.items], bool)

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def around(self, place: int) -> tuple[int, int, int]:
        """The item that holds the place and the boundaries at or below and at or above it."""
        i = int(np.searchsorted(self.ends, place, side="right"))
        if i == len(self.items):
            return i, self.total, self.total
        start = int(self.ends[i - 1]) if i else 0
        if self.divisible[i] or place == start:
            return i, place, place
        return i, start, int(self.ends[i])

    def refined(self, places: list[int], most: int) -> bool:
        """Splits the divisible ranges that a place lies inside or that hold a group above `most`; False if there is none."""
        hit = {i for i, item in enumerate(self.items) if self.divisible[i] and item[2] > most}
        for place in places:
            i, *_ = self.around(place)
            if i < len(self.items) and self.divisible[i] and place != (int(self.ends[i - 1]) if i else 0):
                hit.add(i)
        if not hit:
            return False
        finer = self.split([self.items[i] for i in sorted(hit)])
        self.items = [x for i, x in enumerate(self.items) if i not in hit] + finer
        self.__post_init__()
        return True

    def greedy(self, capacity: int, shards: int) -> list[int] | None:
        """Cuts of shards that are filled one after another, None if they don't hold everything.

        A group above the capacity has a shard to itself.
        """
        cuts, at = [], 0
        for _ in range(shards):
            if at + capacity >= self.total:
                return cuts
            _, low, high = self.around(at + capacity)
            at = low if low > at else high
            if at == self.total:
                return cuts
            cuts.append(at)
        return None

    def cuts(self, shards: int) -> list[str]:
        """First digest (or a prefix of it) of the shards after the first.

        The capacity is the smallest that suffices, single groups above it
        apart; so the largest shard is as small as the order allows, and a huge
        group doesn't leave the other shards uneven.
        """
        while True:
            low, high = 1, max(1, self.total)
            while low < high:
                middle = (low + high) // 2
                if self.greedy(middle, shards) is None:
                    low = middle + 1
                else:
                    high = middle
            cuts = self.greedy(low, shards)
            if not self.refined(cuts, low):
                starts = [int(np.searchsorted(self.ends, c, side="right")) for c in cuts]
                return [self.items[i][0] for i in starts] + ["~"] * (shards - 1 - len(cuts))


def _sums(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
        F.sum("bytes").cast("bigint"), F.max("bytes"), F.count(F.lit(1))
    )


def ranges(groups: DataFrame) -> Ranges:
    """`groups` has digest (64 hex digits) and bytes, is stored, and has one row per digest."""

    def split(wide: list[Range]) -> list[Range]:
        out = []
        for size in sorted({(len(r[0]), r[3] <= SMALL) for r in wide}):
            length, few = size
            chosen = [r[0] for r in wide if (len(r[0]), r[3] <= SMALL) == size]
            inside = groups.where(F.substring("digest", 1, length).isin(chosen))
            out += [tuple(r) for r in _sums(inside, 64 if few else length + NEXT).collect()]
        return out

    return Ranges([tuple(r) for r in _sums(groups, FIRST).collect()], split)


def shards(docs: DataFrame, id_column: str = "doc_id", text: str = "text", count: int = SHARDS) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: size is the UTF-8 bytes of the text (null: none) plus 8,
    equal texts share a shard, and the largest shard is as small as the order of
    the digests allows.  Repeated rows and null ids are rows like
    others.  An empty table gives an empty result; other columns are ignored.
    """
    body = text_or_empty(text)
    rows = materialise(
        docs.select(
            F.col(f"`{id_column}`").alias(id_column),
            (F.octet_length(body) + 8).cast("bigint").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.sha2(body, 256).alias("digest"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    groups = materialise(rows.groupBy("digest").agg(F.sum("size").cast("bigint").alias("bytes")))
    cuts = ranges(groups).cuts(count)
    shard = sum((F.when(F.col("digest") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    placed = position_by_sort(rows.withColumn("shard", shard), [F.col("digest"), F.col(id_column), F.col("__row")], "__place")
    # One number per shard.
    held = dict(placed.groupBy("shard").count().collect())
    before = np.cumsum([0, *(held.get(s, 0) for s in range(count))]).tolist()
    first = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("shard") + 1)
    return placed.select(
        id_column,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("__place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
