"""Removal of byte strings that occur twice, from sorted suffixes.

Sorting every suffix would move many times the input, so only suffixes that
start at anchors are sorted.  Anchors are chosen by content: of the grams in
each string of `length` bytes those with the least hash.  Equal strings thus
have an anchor at the same place, and a repeated string is found from the
suffix after that anchor and the bytes before it.

1. Each block of documents names its anchors' gram hashes; where a hash is
   counted, the block learns which of them occur elsewhere, too.
2. For those the block sorts its suffixes (cut at `length` bytes, each distinct
   context once), front-codes the sorted run and sends it to the share of its
   hash.  A share merges its runs with a loser tree that keeps common-prefix
   lengths, so that known prefixes are never compared again.
3. Suffixes that agree in `length - i` bytes are neighbours in that order, and
   contexts that agree in the i bytes before the anchor are neighbours in the
   order of reversed left contexts.  Being neighbours in both, for some i, is to
   share the string that starts i bytes before the anchor.
4. Each block gets the outcome for its contexts and removes what they cover.

Hot grams would bring together as many contexts as there are documents with a
common passage.  From HOT occurrences on, their strings are counted by 128-bit
digests instead, each distinct string once per block.

Blocks are stored in buckets by name; hashes, runs and outcomes move, texts don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm.bpe import bucketed
from pairloom.llm.common import encoded, map_arrow
from pairloom.session import materialise

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 8 << 20
# Window starts that are hashed at a time.
PIECE = 1 << 20
HOT = 1 << 16
# Places of hot strings whose digests are made at a time.
HOT_PIECE = 1 << 18
# Places whose strings are hashed at a time.
HASHED = 1 << 14
NONE = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- hashes and anchors -------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _letters(seed: int) -> np.ndarray:
    return _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed)) * _ODD)


def gram_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on, by doubling."""
    width, level = 1, _letters(seed)[data]
    out, done = None, 0
    while True:
        if size & width:
            tail = level if out is None else _mixed(out[: len(level) - done] * _ODD + level[done:]) if len(level) > done else level[:0]
            out, done = tail, done + width
        if done == size:
            return out
        level = _mixed(level[:-width] * _ODD + level[width:]) if len(level) > width else level[:0]
        width *= 2


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """best over each `size` consecutive values."""
    width, level = 1, values
    while 2 * width <= size:
        level = best(level[:-width], level[width:])
        width *= 2
    return best(level[: len(values) - size + 1], level[size - width : len(values) - width + 1])


def segments(starts: np.ndarray, length: int, piece: int = PIECE) -> Iterator[list[tuple[int, int]]]:
    """Byte ranges that hold all strings of `length` bytes inside documents, in lists of about a piece."""
    held, size = [], 0
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        for at in range(begin, end - length + 1, piece):
            held.append((at, min(end, at + piece + length - 1)))
            size += held[-1][1] - at
            if size >= piece:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors: grams whose hash is least in some string of `length` bytes."""
    places, hashes = [], []
    span = length - gram + 1
    for ranges in segments(starts, length):
        body = np.concatenate([data[a:b] for a, b in ranges])
        lengths = np.array([b - a for a, b in ranges])
        edges = np.concatenate([[0], np.cumsum(lengths)])
        values = gram_hashes(body, gram)
        least = _sliding(values, span, np.minimum)
        valid = np.ones(len(least), bool)
        for end in edges[1:-1].tolist():
            valid[end - length + 1 : end] = False
        least[~valid] = 0
        wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        chosen = np.flatnonzero((_sliding(wide, span, np.maximum) == values) & (values > 0))
        which = np.searchsorted(edges, chosen, side="right") - 1
        places.append(np.array([a for a, _ in ranges])[which] + chosen - edges[which])
        hashes.append(values[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Pieces of a long document overlap.
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


# --- merging sorted runs ------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    size = min(len(a), len(b))
    x, y = a[known:size], b[known:size]
    if x == y:
        return size
    differing = int.from_bytes(x) ^ int.from_bytes(y)
    return size - (differing.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the bytes shared with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for suffix in suffixes:
        n = common(before, suffix, 0)
        shared.append(n)
        rest.append(suffix[n:])
        before = suffix
    return shared, rest


def restored(shared: list[int], rest: list[bytes]) -> list[bytes]:
    out, before = [], b""
    for n, tail in zip(shared, rest):
        before = before[:n] + tail
        out.append(before)
    return out


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, bytes shared with the one before) in sorted order, from (shared, suffixes) of sorted runs.

    A loser tree: each inner node holds the loser of its match and how many
    bytes it shares with the suffix that won there.  Of two that share different
    numbers of bytes with the last one out, the one that shares more is smaller;
    only on a tie are bytes compared, from there on.
    """
    count = len(runs)
    if not count:
        return
    size = 1 << (count - 1).bit_length()
    heads = [0] * count
    shares = [0 if runs[i][1] else -1 if i < count else -1 for i in range(count)] + [-1] * (size - count)
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); an exhausted run has -1 shared bytes and loses."""
        p, q = shares[a], shares[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p < 0:
            return a, b
        x, y = runs[a][1][heads[a]], runs[b][1][heads[b]]
        n = common(x, y, p)
        if x[n:] <= y[n:]:
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while shares[winner] >= 0:
        yield winner, heads[winner], shares[winner]
        heads[winner] += 1
        shared, suffixes = runs[winner]
        shares[winner] = shared[heads[winner]] if heads[winner] < len(suffixes) else -1
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


# --- what contexts share ------------------------------------------------------------------------------------------


def spans_of_contexts(rights: list[bytes], shared: list[int], lefts: list[bytes], often: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in the order of their rights: least and largest i whose string is repeated, NONE if there is none.

    String i starts i bytes before the anchor.  `lefts` are read away from the
    anchor.  `often` marks contexts that stand for several places by themselves.
    All strings of a context contain the gram, so what they cover is one range.
    """
    count, most = len(rights), length - gram
    right_len = np.array([len(r) for r in rights], np.int64)
    left_len = np.array([len(x) for x in lefts], np.int64)
    low, high = np.full(count, NONE, np.int64), np.full(count, -1, np.int64)
    shared_right = np.array(shared, np.int64)
    group = np.cumsum(shared_right < gram)
    table = np.zeros((count, most + -most % 8), np.uint8)
    flat = np.frombuffer(b"".join(x.ljust(table.shape[1], b"\0") for x in lefts), np.uint8).reshape(table.shape) if table.shape[1] else table
    order = np.lexsort([*flat.view(">u8").T[::-1], group]) if table.shape[1] else np.lexsort([group])
    sorted_left, sorted_len = flat[order], left_len[order]
    shared_left = np.zeros(count, np.int64)
    if count > 1:
        differs = sorted_left[1:] != sorted_left[:-1]
        run = np.where(differs.any(1), differs.argmax(1), flat.shape[1]) if flat.shape[1] else np.zeros(count - 1, np.int64)
        shared_left[1:] = np.minimum(run, np.minimum(sorted_len[1:], sorted_len[:-1]))
        shared_left[1:][group[order][1:] != group[order][:-1]] = -1
    shared_left[:1] = -1
    left_class = np.empty(count, np.int64)
    for i in range(most + 1):
        fits = np.flatnonzero((left_len >= i) & (right_len >= length - i))
        if not len(fits):
            continue
        left_class[order] = np.cumsum(shared_left < i)
        code = (np.cumsum(shared_right < length - i) * (count + 1) + left_class)[fits]
        _, back, n = np.unique(code, return_inverse=True, return_counts=True)
        hit = fits[(n[back] > 1) | often[fits]]
        low[hit] = np.minimum(low[hit], i)
        high[hit] = i
    return low, np.where(high < 0, NONE, high)


# --- blocks and shares --------------------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return b"".join(len(a).to_bytes(4, "little") for a in arrays) + zstandard.compress(raw, 1)


def _arrays(value: bytes, *kinds) -> list[np.ndarray]:
    head = 4 * len(kinds)
    raw, at, out = zstandard.decompress(value[head:]), 0, []
    for i, kind in enumerate(kinds):
        n = int.from_bytes(value[4 * i : 4 * i + 4], "little")
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def blocks(docs: DataFrame, id_column: str, text: str, block_bytes: int, length: int, gram: int) -> DataFrame:
    """block, ids and byte lengths of its documents, their bytes compressed, its anchors."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), encoded(text).alias("body"))
    names = ["block", "ids", "lengths", "body", "anchors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, bodies, held = None, [], [], 0

        def block() -> pa.RecordBatch:
            body, lengths = b"".join(bodies), [len(b) for b in bodies]
            places, hashes = anchors(np.frombuffer(body, np.uint8), _starts(lengths), length, gram)
            values = [uuid.uuid4().hex, ids, lengths, zstandard.compress(body, 3), _packed(places.astype("<u4"), hashes)]
            kinds = [pa.string(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                bodies.append(body.as_py())
                held += len(bodies[-1])
                if held >= block_bytes:
                    yield block()
                    ids, bodies, held = [], [], 0
        if ids:
            yield block()

    schema = T.StructType([
        T.StructField("block", T.StringType()),
        T.StructField("ids", T.ArrayType(narrow.schema["id"].dataType)),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("body", T.BinaryType()),
        T.StructField("anchors", T.BinaryType()),
    ])
    return map_arrow(narrow, run, schema)


def _starts(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype(np.int64)


class Block:
    """A block's bytes with its anchors, and what it asks of the shares in each round."""

    def __init__(self, row: dict, shares: int, length: int, gram: int) -> None:
        """A row without the body knows its anchors only."""
        self.shares, self.length, self.gram = shares, length, gram
        places, self.hashes = _arrays(row["anchors"], "<u4", "<u8")
        self.places = places.astype(np.int64)
        if row.get("body"):
            self.bytes = zstandard.decompress(row["body"])
            self.data = np.frombuffer(self.bytes, np.uint8)
            self.starts = _starts(row["lengths"])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes by (share, hash) with their counts; the share of a hash is its remainder."""
        values, counts = np.unique(self.hashes, return_counts=True)
        order = np.lexsort([values, values % np.uint64(self.shares)])
        return values[order], counts[order]

    def parts(self, values: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(share, slice) of values that are ordered by share."""
        share = (values % np.uint64(self.shares)).astype(np.int64)
        edges = np.flatnonzero(np.diff(share)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(share)]):
            if b > a:
                yield int(share[a]), slice(a, b)

    def answer(self, answers, values: np.ndarray) -> np.ndarray:
        """The shares' answers, one small number per value."""
        by_share = {x["share"]: x["answer"] for x in answers or ()}
        out = np.zeros(len(values), np.uint8)
        for share, part in self.parts(values):
            (out[part],) = _arrays(by_share[share], np.uint8)
        return out

    def repeated(self, answers) -> np.ndarray:
        """For each anchor: 0 if its gram occurs once, 1 if more often, 2 if it is hot."""
        values, _ = self.distinct()
        found = self.answer(answers, values)
        order = np.argsort(values)
        return found[order][np.searchsorted(values[order], self.hashes)] if len(values) else np.zeros(0, np.uint8)

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the contexts of anchors: bytes before it and a suffix, in the document."""
        doc = np.searchsorted(self.starts, places, side="right") - 1
        return np.maximum(places - (self.length - self.gram), self.starts[doc]), np.minimum(places + self.length, self.starts[doc + 1])

    def contexts(self, kind: np.ndarray) -> tuple[dict[int, list], np.ndarray, np.ndarray]:
        """Distinct contexts of repeated anchors by share, sorted by suffix: (suffix, left, often).

        Also the number (share, place in its list, counted through) of each such anchor's context, and the anchors.
        """
        own = np.flatnonzero(kind == 1)
        places = self.places[own]
        first, last = self.bounds(places)
        keys: dict[tuple, int] = {}
        number, times = np.empty(len(own), np.int64), []
        rows = []
        for n, (a, p, b, h) in enumerate(zip(first.tolist(), places.tolist(), last.tolist(), (self.hashes[own] % np.uint64(self.shares)).tolist())):
            key = (self.bytes[a:b], p - a)
            at = keys.get(key)
            if at is None:
                at = keys[key] = len(rows)
                rows.append((h, self.bytes[p:b], self.bytes[a:p][::-1]))
                times.append(0)
            times[at] += 1
            number[n] = at
        order = sorted(range(len(rows)), key=rows.__getitem__)
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        by_share: dict[int, list] = {}
        for at in order:
            share, suffix, left = rows[at]
            by_share.setdefault(share, []).append((suffix, left, times[at] > 1))
        return by_share, place[number] if len(rows) else number, own

    def hot_places(self, kind: np.ndarray) -> np.ndarray:
        """Places of the strings that hold a hot anchor, each once however many anchors it has."""
        own = self.places[kind == 2]
        first, last = self.bounds(own)
        return covered_by(first, np.minimum(own, last - self.length) + 1)

    def digests_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two digests of the string at each place."""
        one, two = (np.empty(len(places), np.uint64) for _ in range(2))
        for at in range(0, len(places), HASHED):
            some = places[at : at + HASHED]
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(some) != 1]))
            counts = np.diff(np.append(fresh, len(some)))
            # Neighbouring places share their bytes.
            body = np.concatenate([self.data[a : a + n + self.length - 1] for a, n in zip(some[fresh].tolist(), counts.tolist())])
            own = np.arange(len(some)) + np.repeat(np.arange(len(fresh)), counts) * (self.length - 1)
            for out, seed in ((one, 1), (two, 2)):
                out[at : at + len(some)] = gram_hashes(body, self.length, seed)[own]
        return one, two


def covered_by(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places in the ranges, ascending, each once; ranges are merged before any place is listed."""
    there = stop > first
    first, stop = first[there], stop[there]
    if not len(first):
        return np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(stop[order])
    fresh = np.concatenate([[True], first[1:] > upto[:-1]])
    begins, ends = first[fresh], upto[np.append(np.flatnonzero(fresh)[1:] - 1, len(upto) - 1)]
    steps = np.ones(int((ends - begins).sum()), np.int64)
    steps[0] = begins[0]
    steps[np.cumsum(ends - begins)[:-1]] = begins[1:] - ends[:-1] + 1
    return np.cumsum(steps, out=steps)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one at a time, for each is a block."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _share_rows(block: str, parts) -> pa.RecordBatch:
    shares, values = zip(*parts) if parts else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(list(shares), pa.int32()), pa.array([block] * len(shares), pa.string()), pa.array(list(values), pa.binary())],
        names=["share", "block", "question"],
    )


QUESTION = "share int, block string, question binary"
ANSWER = "share int, block string, answer binary, hot boolean"


def _answers(table: pa.Table, answers: list[bytes], hot: list[bool] | None = None) -> pa.Table:
    """One row per question; `hot` says whether an answer holds a 2."""
    marks = pa.array(hot or [False] * len(answers), pa.bool_())
    return pa.table({"share": table["share"], "block": table["block"], "answer": pa.array(answers, pa.binary()), "hot": marks})


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    """A block's answers as a list: at most one per share, and together no larger than what the block asked."""
    return materialise(answers.groupBy("block").agg(F.collect_list(F.struct("share", "answer")).alias(name), F.max("hot").alias("hot")))


def _count(hot: int):
    """Answers each value with 0 if it has one place over all blocks, 1 if more, 2 from `hot` on."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_arrays(q, "<u8", "<u8", "<u4") for q in table["question"].to_pylist()]
        keys = np.concatenate([np.stack([a, b], 1) for a, b, _ in asked])
        order = np.lexsort([keys[:, 1], keys[:, 0]])
        fresh = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(1)])
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(fresh) - 1
        total = np.bincount(group, np.concatenate([c for _, _, c in asked]))
        state = ((total > 1).astype(np.uint8) + (total >= hot))[group].astype(np.uint8)
        ends = np.cumsum([len(a) for a, _, _ in asked])[:-1]
        parts = np.split(state, ends)
        return _answers(table, [_packed(x) for x in parts], [bool((x == 2).any()) for x in parts])

    return run


def _merge(length: int, gram: int):
    """Answers each context of a run with the least and the largest i."""

    def run(table: pa.Table) -> pa.Table:
        runs, lefts, often = [], [], []
        for question in table["question"].to_pylist():
            shared, tails, left_sizes, flags, tail_bytes, left_bytes = _arrays(question, np.uint8, "<u4", "<u4", np.uint8, np.uint8, np.uint8)
            shared = shared.tolist()
            runs.append((shared, restored(shared, _cut(tail_bytes, tails))))
            lefts.append(_cut(left_bytes, left_sizes))
            often.append(flags)
        order = list(merged(runs))
        low, high = spans_of_contexts(
            [runs[r][1][i] for r, i, _ in order], [n for _, _, n in order], [lefts[r][i] for r, i, _ in order],
            np.array([often[r][i] for r, i, _ in order], bool), length, gram,
        )
        out = [np.full((2, len(r[1])), NONE, np.uint8) for r in runs]
        for (r, i, _), a, b in zip(order, low.tolist(), high.tolist()):
            out[r][0, i], out[r][1, i] = a, b
        return _answers(table, [_packed(x[0], x[1]) for x in out])

    return run


def _cut(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _run(contexts: list) -> bytes:
    """A sorted run, front-coded, with left contexts and marks."""
    shared, tails = front_coded([c[0] for c in contexts])
    size = lambda parts: np.fromiter(map(len, parts), "<u4", len(parts))
    lefts = [c[1] for c in contexts]
    joined = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
    return _packed(
        np.array(shared, np.uint8), size(tails), size(lefts), np.array([c[2] for c in contexts], np.uint8), joined(tails), joined(lefts)
    )


def without_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    A byte goes if a string of `length` bytes over it also starts anywhere else
    in any document; strings never cross documents and are those of the input.
    A null text is empty, a text shorter than `length` loses nothing.  Repeated
    rows are rows like others, so their texts lose all such strings.  An empty
    table gives an empty result; other columns are ignored.  `length` is at most
    254, for lengths travel as bytes.
    """
    if not gram <= length < NONE:
        raise ValueError(f"gram <= length < {NONE} is needed")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = 4 * partitions
    stored = bucketed(blocks(docs, id_column, text, block_bytes, length, gram), "block", partitions)

    def opened(row) -> Block:
        return Block(row, shares, length, gram)

    def ask_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = opened(row)
                values, counts = block.distinct()
                yield _share_rows(row["block"], [(s, _packed(values[p], np.zeros(len(values[p]), "<u8"), counts[p].astype("<u4"))) for s, p in block.parts(values)])

    def ask_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = opened(row)
                by_share, _, _ = block.contexts(block.repeated(row["grams"]))
                yield _share_rows(row["block"], [(s, _run(c)) for s, c in by_share.items()])

    def ask_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = opened(row)
                one, two, counts = _digests(block, block.repeated(row["grams"]))[2:]
                yield _share_rows(row["block"], [(s, _packed(one[p], two[p], counts[p].astype("<u4"))) for s, p in block.parts(one)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(1).type.value_type
            for row in _rows(batch):
                block = opened(row)
                state = block.repeated(row["grams"])
                covered = np.zeros(len(block.data) + 1, np.int32)
                by_share, number, own = block.contexts(state)
                if len(own):
                    answers = {x["share"]: _arrays(x["answer"], np.uint8, np.uint8) for x in row["contexts"]}
                    low, high = (np.concatenate([answers[s][k] for s in by_share]).astype(np.int64)[number] for k in (0, 1))
                    hit = low != NONE
                    places = block.places[own][hit]
                    np.add.at(covered, places - high[hit], 1)
                    np.add.at(covered, places - low[hit] + length, -1)
                place, inverse, one, _, _ = _digests(block, state)
                if len(place):
                    twice = block.answer(row["strings"], one)[inverse] > 0
                    np.add.at(covered, place[twice], 1)
                    np.add.at(covered, place[twice] + length, -1)
                yield _kept(row["ids"], block, np.cumsum(covered[:-1], dtype=np.int32) > 0, kind)

    def _kept(ids, block: Block, gone: np.ndarray, kind) -> pa.RecordBatch:
        rows = []
        for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            own = gone[a:b]
            removed = int(np.count_nonzero(own))
            runs = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(bool(len(own)) and bool(own[0])) if removed else 0
            rows.append((b - a, removed, runs, block.data[a:b][~own].tobytes() if removed else block.bytes[a:b]))
        n_bytes, n_removed, n_spans, kept = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array(list(c), pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(list(kept), pa.binary())],
            names=[id_column, "n_bytes", "n_removed", "n_spans", "kept"],
        )

    asked = map_arrow(stored.select("block", "anchors"), ask_grams, QUESTION)
    grams = _by_block(asked.groupBy("share").applyInArrow(_count(hot), ANSWER), "grams")
    known = stored.join(grams, "block", "left")
    # Strings are asked for where a gram is hot only.
    heated = known.where("hot")
    asked = map_arrow(known.select("block", "lengths", "body", "anchors", "grams"), ask_contexts, QUESTION)
    contexts = _by_block(asked.groupBy("share").applyInArrow(_merge(length, gram), ANSWER), "contexts")
    asked = map_arrow(heated.select("block", "lengths", "body", "anchors", "grams"), ask_strings, QUESTION)
    strings = _by_block(asked.groupBy("share").applyInArrow(_count(2), ANSWER), "strings")
    everything = known.drop("hot").join(contexts.drop("hot"), "block", "left").join(strings.drop("hot"), "block", "left")
    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType),
        *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept", T.BinaryType()),
    ])
    return map_arrow(everything.select("block", "ids", "lengths", "body", "anchors", "grams", "contexts", "strings"), remove, schema)


def _digests(block: Block, kind: np.ndarray):
    """Places of hot strings, the number of each one's digest pair, and distinct pairs by share with counts.

    Digests are made and reduced to distinct ones in pieces, so a text of few
    different strings takes little more than a number per place.
    """
    place = block.hot_places(kind)
    inverse = np.empty(len(place), np.int64)
    pairs, counts, known = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(place), HOT_PIECE):
        part = np.stack(block.digests_at(place[at : at + HOT_PIECE]), 1)
        own, back, often = _distinct(part)
        inverse[at : at + len(part)] = back + known
        pairs.append(own)
        counts.append(often)
        known += len(own)
    every, back, _ = _distinct(np.concatenate(pairs))
    often = np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)
    order = np.lexsort([every[:, 1], every[:, 0], every[:, 0] % np.uint64(block.shares)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for at in range(0, len(place), HOT_PIECE):
        part = slice(at, at + HOT_PIECE)
        inverse[part] = rank[back[inverse[part]]]
    return place, inverse, every[order, 0], every[order, 1], often[order]


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of two columns, the number of each row's, and how often each occurs."""
    order = np.lexsort([pairs[:, 1], pairs[:, 0]])
    rows = pairs[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return rows[fresh], number, np.bincount(number, minlength=int(fresh.sum()))
