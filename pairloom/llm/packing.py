"""Best-fit packing of token pieces into sequences by linear grouping.

Large lengths are sorted and cut into groups of equal cardinality, each length
rounded up to the largest of its group.  Few sizes remain, for which
configurations (how many pieces of each size share a sequence) are chosen by a
knapsack and repeated as often as the groups allow.  Actual documents then take
the places of the rounded ones, and small pieces go best-fit into what is left.

A plan only depends on how many pieces each length has, at most `capacity`
numbers, so it is made on the driver whatever the size of the corpus; ranks
from one distributed sort tell each piece its place in the plan.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pairloom.llm.common import map_arrow, text_or_empty
from pairloom.operators.ranking import position_by_sort
from pairloom.session import materialise

CAPACITY = 2048
GROUPS = 2048
# Pieces up to this length fill gaps.
SMALL = 384
END_ID = 0
FLUSH_BYTES = 8 << 20

# A run of blanks and what follows it up to the next one.  The split pattern never joins text across the end of such
# a unit, so a unit has the same ids wherever it stands.  Texts with other white space are encoded whole.
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile("[" + "".join(map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))) + "]")
# Units that a worker remembers.
REMEMBERED = 400_000


class _Units(dict):
    """Ids of a unit as packed unsigned 32-bit numbers, remembered."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = array("I", self.encoding.encode_ordinary(unit)).tobytes()
        return ids


@cache
def _units(ranks_path: str, pattern: str) -> _Units:
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _Units(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))


def packed_ids(text: str, units: _Units) -> bytes:
    """The ids of a text, little-endian unsigned 32-bit."""
    if OTHER_SPACE.search(text):
        return array("I", units.encoding.encode_ordinary(text)).tobytes()
    if len(units) > REMEMBERED:
        units.clear()
    return b"".join(map(units.__getitem__, UNIT.findall(text)))


PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def token_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of at most `capacity` ids: id, piece, start, length, ids (packed, little-endian unsigned 32-bit).

    A document is its ids and the end id, so an empty or null text is one piece
    of one id.  Only longer documents are cut; the first piece takes the rest.
    The rank file has the vocabulary and merges of the tokenizer file, and the
    tests hold the ids against the tokenizer; special tokens' strings in a text
    are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(ranks_path, pattern)
        names = [id_column, *PIECES.names]
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            held, kinds[0] = 0, batch.schema.field(0).type
            for place in range(batch.num_rows):
                ids = packed_ids(batch.column(1)[place].as_py(), units) + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                first = total % capacity or capacity
                for piece, end in enumerate(range(first, total + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = ids[4 * start : 4 * end]
                    for column, value in zip(rows, (batch.column(0)[place].as_py(), piece, start, end - start, part)):
                        column.append(value)
                held += len(ids)
                if held > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                    rows, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    narrow = docs.select(F.col(f"`{id_column}`").alias(id_column), text_or_empty(text).alias("text"))
    return map_arrow(narrow, run, T.StructType([narrow.schema[0], *PIECES.fields]))


@dataclass
class LargePlan:
    """By rank from the longest: run i starts at rank starts[i]; `per` pieces go to each sequence from first[i] on."""

    starts: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequences: int

    def place(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, rank, side="right") - 1
        return self.first[run] + (rank - self.starts[run]) // self.per[run]


def plan_large(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> LargePlan:
    """Configurations for lengths with their counts."""
    lengths = sorted(counts, reverse=True)
    ends = np.cumsum([counts[x] for x in lengths], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    # Equal groups, rounded up to the length at their first rank; groups of one size are one.
    sizes: list[int] = []
    begins: list[int] = []
    for rank in sorted({g * total // groups for g in range(groups)} if total else ()):
        size = lengths[int(np.searchsorted(ends, rank, side="right"))]
        if not sizes or sizes[-1] != size:
            sizes.append(size)
            begins.append(rank)
    bounds = [*begins[1:], total]
    taken = list(begins)
    left = [b - a for a, b in zip(begins, bounds)]
    runs: list[tuple[int, int, int]] = []
    sequences = lead = 0
    while True:
        while lead < len(sizes) and not left[lead]:
            lead += 1
        if lead == len(sizes):
            break
        chosen = _configuration(sizes, left, lead, capacity)
        times = min(left[i] // n for i, n in chosen.items())
        for i, n in chosen.items():
            runs.append((taken[i], sequences, n))
            taken[i] += n * times
            left[i] -= n * times
        sequences += times
    runs.sort()
    starts, first, per = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return LargePlan(starts, first, per, sequences)


def _configuration(sizes: list[int], left: list[int], lead: int, capacity: int) -> dict[int, int]:
    """The fullest sequence with a piece of the largest size left, preferring large sizes."""
    room = capacity - sizes[lead]
    mask = (1 << room + 1) - 1
    reach = [1]
    order: list[int] = []
    for i in range(lead, len(sizes)):
        size, most = sizes[i], min(left[i] - (i == lead), room // sizes[i])
        if most <= 0:
            continue
        now = reach[-1]
        for _ in range(most):
            wider = now | now << size & mask
            if wider == now:
                break
            now = wider
        order.append(i)
        reach.append(now)
    fill = reach[-1].bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    chosen[lead] = 1
    for i, before in zip(reversed(order), reversed(reach[:-1])):
        while not before >> fill & 1:
            chosen[i] += 1
            fill -= sizes[i]
    return chosen


@dataclass
class SmallPlan:
    """Run i takes pieces of one length from a rank on (key = length, rank), one to each gap.

    The gap has slack[i] free ids and rank gap[i] + (rank - the run's first);
    slack -1 stands for new sequences.
    """

    keys: np.ndarray
    slack: np.ndarray
    gap: np.ndarray
    new: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = _key(length, rank)
        run = np.searchsorted(self.keys, key, side="right") - 1
        return self.slack[run], self.gap[run] + key - self.keys[run]


def _key(length, rank):
    return (np.int64(1) << 44) * length + rank


def plan_small(counts: dict[int, int], gaps: dict[int, int], capacity: int = CAPACITY) -> SmallPlan:
    """Best fit: each piece, longest first, goes where least room is left."""
    free: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for slack, n in gaps.items():
        if slack:
            free[slack].append((slack, 0, n))
    runs: list[tuple[int, int, int]] = []
    new = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        at = length
        while left:
            while at <= capacity and not free.get(at):
                at += 1
            if at > capacity:
                opened = -(-left // (capacity // length))
                free[capacity].append((-1, new, new + opened))
                new += opened
                at = capacity
            origin, low, high = free[at].pop()
            n = min(left, high - low)
            runs.append((int(_key(length, rank)), origin, low))
            if low + n < high:
                free[at].append((origin, low + n, high))
            if at > length:
                free[at - length].append((origin, low, low + n))
                at = max(length, min(at, at - length))
            left -= n
            rank += n
    runs.sort()
    keys, slack, gap = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    return SmallPlan(keys, slack, gap, new)


def _counts(df: DataFrame, column: str) -> dict[int, int]:
    """Rows per value; the values are at most `capacity`, so few numbers reach the driver."""
    return {int(v): int(n) for v, n in df.groupBy(column).count().collect()}


def assign(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """pieces (narrow, with a length) with sequence_id and offset; `order` breaks ties among equal lengths."""
    ranked = position_by_sort(pieces, [F.col("length").desc(), *[F.col(c) for c in order]], "__rank")
    ranked = materialise(ranked)
    counts = _counts(ranked, "length")
    whole = counts.get(capacity, 0)
    large_counts = {k: n for k, n in counts.items() if small < k < capacity}
    small_counts = {k: n for k, n in counts.items() if k <= small}
    large = plan_large(large_counts, capacity, groups)
    larges = whole + sum(large_counts.values())
    is_large = F.col("length") > small

    def place_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            ours = np.where(rank < whole, rank, 0)
            if len(large.starts):
                ours = np.where(rank < whole, rank, whole + large.place(np.maximum(rank - whole, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ours, pa.int64())], names=[*batch.schema.names, "sequence_id"])

    kept = [*pieces.columns, "__rank"]
    schema = T.StructType([*ranked.select(*kept).schema.fields, T.StructField("sequence_id", T.LongType())])
    larger = map_arrow(ranked.where(is_large).select(*kept), place_large, schema)

    room = larger.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("bigint").alias("__slack")).where("__slack > 0")
    room = materialise(position_by_sort(room, [F.col("__slack"), F.col("sequence_id")], "__gap"))
    gaps = _counts(room, "__slack")
    smaller_plan = plan_small(small_counts, gaps, capacity)
    base = whole + large.sequences
    # Ranks within a length, and gap ranks within a slack, from the ranks over all.
    before: dict[int, int] = {}
    at = larges
    for length in sorted(small_counts, reverse=True):
        before[length] = at
        at += small_counts[length]
    start_of = np.zeros(small + 1, np.int64)
    for length, rank in before.items():
        start_of[length] = rank
    gap_start = np.zeros(capacity + 1, np.int64)
    seen = 0
    for slack in sorted(gaps):
        gap_start[slack] = seen
        seen += gaps[slack]

    def place_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy() - start_of[length]
            slack, gap = smaller_plan.place(length, rank)
            fresh = slack < 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.where(fresh, base + gap, -1), pa.int64()), pa.array(np.where(fresh, -1, gap_start[slack] + gap), pa.int64())],
                names=[*batch.schema.names, "__new", "__gap"],
            )

    schema = T.StructType([*schema.fields[:-1], T.StructField("__new", T.LongType()), T.StructField("__gap", T.LongType())])
    smaller = (
        map_arrow(ranked.where(~is_large).select(*kept), place_small, schema)
        .join(room.select("__gap", "sequence_id"), "__gap", "left")
        .withColumn("sequence_id", F.when(F.col("__new") >= 0, F.col("__new")).otherwise(F.col("sequence_id")))
        .drop("__gap", "__new")
    )
    inside = Window.partitionBy("sequence_id").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        larger.unionByName(smaller)
        .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("bigint"))
        .drop("__rank")
    )


def packed(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated rows too, in whichever order of equal
    ones; null ids are ids like others.  An empty table gives an empty result;
    other columns are ignored.
    """
    pieces = token_pieces(docs, ranks_path, pattern, id_column, text, capacity)
    narrow = materialise(pieces.select(id_column, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return assign(narrow, [id_column, "piece"], capacity)


def sequences(pieces: DataFrame, places: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """sequence_id and its packed ids, from token_pieces and where packed() puts them; ids must be unique."""
    both = pieces.join(places.select(id_column, "piece", "sequence_id", "offset"), [id_column, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))
