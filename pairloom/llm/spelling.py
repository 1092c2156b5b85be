"""Spelling variants: words one edit apart, found through Bloom filters.

Words are counted over all texts.  The vocabulary's words are hashed into
blocked Bloom filters, one for each word length (long filters in parts), built
by or-ing bits in Spark.  Filters of at most FILTER_BYTES together are broadcast
at a time; each task then makes all edits of its words as hashes and asks the
filters.  Only what they let through is shuffled and joined with the vocabulary,
where spelling decides, so false positives go and no neighbour is missed.

An insertion is the other word's deletion, and a replacement is made from the
word with the smaller letter, so each pair is found once.  Edits are hashed
without being written out: a word's hash is a sum over its places, of which an
edit changes a known part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import encoded, map_arrow, slices
from pairloom.session import materialise

SHORTEST, LEAST, RATIO = 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"
# A replacement can bring in any letter of a word; A-Z don't occur in lower-cased ones.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
BITS_PER_WORD, BLOCK_BITS = 24, 512
FILTER_BYTES = 16 << 20
# Words as long as this and longer share the filters of one length.
LONGEST = 64
# Words whose edits one task makes.
WORDS = 1 << 14
# Distinct words a task holds before it hands on its counts, and edits that are hashed at a time.
HELD, EDITS = 1 << 18, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = (0x47B6137B, 0x44974D91, 0x6824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
_ROUNDS = 6


# --- hashes ----------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def _letters(codes: np.ndarray) -> np.ndarray:
    return _mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _powers(count: int) -> np.ndarray:
    out = np.full(count, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _keys(sums: np.ndarray, length: int) -> np.ndarray:
    return _mixed(sums + np.uint64(length))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, code points) in pieces of about EDITS edits."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, EDITS // (length * len(ALPHABET)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield length, some, _codes([words[i] for i in some.tolist()], length)


def word_keys(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, places, codes in _by_length(words):
        out[places] = _keys((_letters(codes) * _powers(length)).sum(1, dtype=np.uint64), length)
    return out


def edits(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row, place, key) of all words that come from a word by a deletion, or by a replacement with a larger letter.

    Of equal letters in a row only the first is deleted.  A long word's edits
    come in pieces.
    """
    count, length = codes.shape
    power = _powers(length)
    terms = _letters(codes) * power
    total = terms.sum(1, dtype=np.uint64)[:, None]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    shorter = upto - terms + (total - upto) * np.uint64(_INVERSE)
    fresh = np.ones((count, length), bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(fresh)
    yield length - 1, row, place, _keys(shorter[row, place], length - 1)
    letters = _letters(ALPHABET)
    step = max(1, EDITS // (max(1, count) * len(ALPHABET)))
    for at in range(0, length, step):
        part = slice(at, at + step)
        row, place, letter = np.nonzero(ALPHABET > codes[:, part, None])
        place += at
        yield length, row, place, _keys(total[row, 0] + letters[letter] * power[place] - terms[row, place], length)


# --- filters ---------------------------------------------------------------------------------------------------


def _blocks(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) * np.uint64(blocks) >> np.uint64(31)).astype(np.int64)


def _bits(keys: np.ndarray, k: int) -> np.ndarray:
    low = keys & np.uint64((1 << 31) - 1)
    return np.uint64(1) << (low * np.uint64(_SALTS[k]) >> np.uint64(25) & np.uint64(63))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The numbers of the keys that a filter (blocks x 8 words) lets through."""
    block = _blocks(keys, len(table))
    left = np.arange(len(keys))
    for k in range(BLOCK_BITS // 64):
        left = left[table[block[left], k] & _bits(keys[left], k) != 0]
    return left


def _plan(vocabulary: DataFrame, limit: int) -> list[list[tuple[int, int, int, int]]]:
    """Filters (length, part, parts, blocks) in rounds of at most `limit` bytes; from a count of words per length."""
    shard = F.least(F.length("word"), F.lit(LONGEST)).alias("shard")
    rounds, room = [], 0
    for row in sorted(vocabulary.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()):
        size = -(-row["n"] * BITS_PER_WORD // 8)
        parts = -(-size // limit)
        blocks = max(1, -(-size // parts) * 8 // BLOCK_BITS)
        for part in range(parts):
            need = blocks * BLOCK_BITS // 8
            if not rounds or room < need:
                rounds.append([])
                room = limit
            rounds[-1].append((row["shard"], part, parts, blocks))
            room -= need
    return rounds


def build(vocabulary: DataFrame, plan: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The planned filters.  Tasks or the bits of their words, Spark those of the tasks; no more than the plan's bytes are collected."""
    of = {s: (parts, blocks) for s, _, parts, blocks in plan}
    wanted = {(s, part) for s, part, _, _ in plan}
    names = [f"w{k}" for k in range(BLOCK_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            lengths = np.minimum(batch.column(0).to_numpy(), LONGEST)
            for shard in np.unique(lengths).tolist():
                if shard not in of:
                    continue
                parts, blocks = of[shard]
                own = keys[lengths == shard]
                part = _part(own, parts)
                for p in np.unique(part).tolist():
                    if (shard, p) not in wanted:
                        continue
                    some = own[part == p]
                    place, inverse = np.unique(_blocks(some, blocks), return_inverse=True)
                    table = np.zeros((len(place), len(names)), np.uint64)
                    for k in range(len(names)):
                        np.bitwise_or.at(table[:, k], inverse, _bits(some, k))
                    fixed = [pa.array(np.full(len(place), v, np.int32)) for v in (shard, p)]
                    words = [pa.array(np.ascontiguousarray(table[:, k]).view(np.int64)) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(place), *words], names=["shard", "part", "block", *names])

    schema = "shard int, part int, block bigint, " + ", ".join(f"{w} bigint" for w in names)
    found = map_arrow(vocabulary.select(F.length("word").alias("length"), "key"), run, schema)
    whole = found.groupBy("shard", "part", "block").agg(*[F.bit_or(w).alias(w) for w in names]).toArrow()
    shard, part, block = (whole.column(i).to_numpy() for i in range(3))
    words = np.stack([whole.column(3 + k).to_numpy().view(np.uint64) for k in range(len(names))], 1)
    tables = {}
    for s, p, _, blocks in plan:
        own = (shard == s) & (part == p)
        tables[s, p] = np.zeros((blocks, len(names)), np.uint64)
        tables[s, p][block[own]] = words[own]
    return tables


def _positives(vocabulary: DataFrame, dealt: DataFrame, plan: list[tuple[int, int, int, int]]) -> DataFrame:
    """id, place, gone (deletion or replacement), near (key): edits of the words that the plan's filters let through."""
    tables = vocabulary.sparkSession.sparkContext.broadcast(build(vocabulary, plan))
    parts_of = {s: parts for s, _, parts, _ in plan}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for length, places, codes in _by_length(batch.column(1).to_pylist()):
                if not {min(length, LONGEST), min(length - 1, LONGEST)} & set(parts_of):
                    continue
                for size, row, place, keys in edits(codes):
                    shard = min(size, LONGEST)
                    parts = parts_of.get(shard, 0)
                    part = _part(keys, parts) if parts > 1 else None
                    for p in range(parts):
                        table = tables.value.get((shard, p))
                        if table is None:
                            continue
                        own = np.flatnonzero(part == p) if parts > 1 else slice(None)
                        hit = passes(table, keys[own])
                        hit = own[hit] if parts > 1 else hit
                        if len(hit):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(ids[places[row[hit]]]), pa.array(place[hit].astype(np.int32)),
                                    pa.array(np.full(len(hit), size < length)), pa.array(keys[hit].view(np.int64)),
                                ],
                                names=["id", "place", "gone", "near"],
                            )

    return map_arrow(dealt.select("id", "word"), run, "id bigint, place int, gone boolean, near bigint")


# --- operator --------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, slips: int | None = None) -> DataFrame:
    """word, n: runs of letters of at least so many code points, A-Z lower-cased, over all texts.

    With `slips` a run loses a code point in every document where the CRC-32 h
    of "<id>:<run>" is divisible by it: that at place h % length.
    """
    run_of = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for piece in slices(batch, 1):
                for ident, raw in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    found = Counter(run_of.findall(raw.lower().decode()))
                    if slips:
                        prefix = zlib.crc32(f"{ident}:".encode())
                        for word in list(found):
                            h = zlib.crc32(word.encode(), prefix)
                            if h % slips == 0:
                                at = h % len(word)
                                n = found.pop(word)
                                if len(word) > shortest:
                                    held[word[:at] + word[at + 1 :]] += n
                    held.update(found)
                    if len(held) > HELD:
                        yield counted(held)
                        held = Counter()
        yield counted(held)

    ident = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))
    partial = map_arrow(docs.select(ident.alias("id"), encoded(text).alias("raw")), run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def with_keys(words: DataFrame) -> DataFrame:
    """words (word, n), stored, with a number (id) and the hash of the spelling (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(word_keys(batch.column(0).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["word", "n", "key"])

    keyed = map_arrow(words.select("word", "n"), run, "word string, n bigint, key bigint")
    return materialise(keyed.withColumn("id", F.monotonically_increasing_id()))


def neighbours(vocabulary: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(u, v): words (struct of id, word, n) one edit apart, each pair once.  `vocabulary` as with_keys() returns it."""
    found = None
    # The number is given: words are small, but not the work on their edits.
    dealt = vocabulary.repartition(max(1, -(-vocabulary.count() // WORDS)), "id")
    for plan in _plan(vocabulary, limit):
        some = _positives(vocabulary, dealt, plan)
        found = some if found is None else found.unionByName(some)
    word = F.struct("id", "word", "n")
    if found is None:
        return vocabulary.select(word.alias("u"), word.alias("v")).where(F.lit(False))
    met = materialise(found).join(vocabulary.select(F.col("key").alias("near"), word.alias("v")), "near")
    both = met.join(vocabulary.select("id", word.alias("u")), "id")
    front = "substr(u.word, 1, place)"
    rest = "substr(u.word, place + 2)"
    replaced = f"length(u.word) = length(v.word) AND u.word <> v.word AND {front} = substr(v.word, 1, place) AND {rest} = substr(v.word, place + 2)"
    return both.where(f"CASE WHEN gone THEN concat({front}, {rest}) = v.word ELSE {replaced} END").select("u", "v")


def variants(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
    slips: int | None = None,
    limit: int = FILTER_BYTES,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words have at least `shortest` code points and `least` occurrences.  `form`
    is the commonest of the words one edit away (ties: smallest in code-point
    order) if it is `ratio` times as common; `root` follows forms to the last
    one.  Forms grow `ratio`-fold, so a chain is short.  A null text has no
    words, a null id counts as an empty one (for `slips` only); repeated rows
    count as often.  An empty table gives an empty result; other columns are
    ignored.
    """
    words = word_counts(docs, id_column, text, shortest, slips).where(F.col("n") >= least)
    vocabulary = with_keys(words)
    pairs = materialise(neighbours(vocabulary, limit))
    turned = pairs.select(F.col("u.id").alias("id"), F.col("v").alias("near")).unionByName(
        pairs.select(F.col("v.id").alias("id"), F.col("u").alias("near"))
    )
    best = turned.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near.n")).alias("less"), F.col("near.word").alias("word"))).alias("best")
    )
    common = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    judged = materialise(
        vocabulary.join(best, "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), common["word"].alias("form"), (-common["less"]).alias("form_n")
        )
    )
    roots = materialise(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(_ROUNDS):
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # Each round doubles the steps taken.
        moved = roots.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved)
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
