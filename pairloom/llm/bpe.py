"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens, their words.  A block of documents is stored as
the list of its distinct units (blanks and what follows them) and the positions
of each unit, as a sequence of list places; so a word is named once per block,
however often it stands there.  The blocks' distinct words are dealt out by
hash, every distinct word is encoded once where it arrives, and the ids go back
to the blocks that asked, which put their documents together by position.
Blocks are stored in buckets by their name, so only ids move to them.

Decoding takes the bytes of each id from the table of the tokens' bytes, which
every task loads; its size is that of the vocabulary.  A join would move a row
for each token.
"""

from __future__ import annotations

import base64
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm.common import map_arrow, text_or_empty
from pairloom.llm.packing import OTHER_SPACE, UNIT
from pairloom.session import scratch_path, scratch_table

BLOCK_BYTES = 12 << 20
FLUSH_IDS = 1 << 20


def rank_table(path: str) -> list[bytes]:
    """The bytes of each token in the order of ids."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {token: i for i, token in enumerate(rank_table(path))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lengths = np.fromiter(map(len, parts), "<u4", len(parts)).tobytes()
    return len(parts).to_bytes(4, "little") + zstandard.compress(lengths + b"".join(parts), 3)


def unpack(value: bytes) -> list[bytes]:
    count = int.from_bytes(value[:4], "little")
    raw = zstandard.decompress(value[4:])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", count), dtype=np.int64) + 4 * count).tolist()
    return [raw[a:b] for a, b in zip([4 * count, *ends], ends)]


def _places_packed(places: np.ndarray) -> bytes:
    """List places by planes of bytes, which compress better; frequent units have small places."""
    return len(places).to_bytes(8, "little") + zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _places(value: bytes) -> np.ndarray:
    count = int.from_bytes(value[:8], "little")
    planes = np.frombuffer(zstandard.decompress(value[8:]), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _List(dict):
    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        return place


BLOCK = ["block", "ids", "counts", "units", "places"]


def blocks(docs: DataFrame, id_column: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids and counts of units of its documents, its distinct units, the place of each unit in that list."""
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, places, known, held, kind = [], [], array("I"), _List(), 0, None

        def block() -> pa.RecordBatch:
            found = np.frombuffer(places, np.uint32) if places else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(found, minlength=len(known)), kind="stable")
            moved = np.empty(len(order), np.uint32)
            moved[order] = np.arange(len(order), dtype=np.uint32)
            units = list(known)
            values = [uuid.uuid4().hex, ids, counts, pack([units[i].encode() for i in order.tolist()]), _places_packed(moved[found])]
            kinds = [pa.string(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=BLOCK)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                units = [body] if OTHER_SPACE.search(body) else UNIT.findall(body)
                places.extend(map(known.__getitem__, units))
                ids.append(doc)
                counts.append(len(units))
                held += len(body)
                if held >= block_bytes:
                    yield block()
                    ids, counts, places, known, held = [], [], array("I"), _List(), 0
        if ids:
            yield block()

    schema = T.StructType([
        T.StructField("block", T.StringType()),
        T.StructField("ids", T.ArrayType(narrow.schema["id"].dataType)),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("units", T.BinaryType()),
        T.StructField("places", T.BinaryType()),
    ])
    return map_arrow(narrow, run, schema)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows stored in buckets by a key in the shared folder, so that joins on the key needn't move them."""
    name, path = scratch_table(), scratch_path(df.sparkSession, "buckets")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _words(units: list[str], pattern, shares: int) -> tuple[list[list[str]], list[list[str]]]:
    """The words of each unit, and the distinct words of each share, sorted."""
    by_unit = [pattern.findall(u) for u in units]
    dealt: list[list[str]] = [[] for _ in range(shares)]
    for word in {w for ws in by_unit for w in ws}:
        dealt[xxhash.xxh64_intdigest(word.encode()) % shares].append(word)
    for words in dealt:
        words.sort()
    return by_unit, dealt


def _of_units(row: dict, pattern, shares: int) -> list[bytes]:
    """The packed ids of each of a block's units, from the answers for its words."""
    by_unit, dealt = _words([u.decode() for u in unpack(row["units"])], pattern, shares)
    ids: dict[str, bytes] = {}
    for part in row["answers"] or ():
        ids.update(zip(dealt[part["share"]], unpack(part["answer"])))
        dealt[part["share"]] = []
    return [b"".join([ids[w] for w in words]) for words in by_unit]


def asked(stored: DataFrame, pattern: str, shares: int) -> DataFrame:
    """share, block, words: the distinct words of a block that fall into each share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for block, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, dealt = _words([u.decode() for u in unpack(units)], compiled, shares)
                full = [i for i, words in enumerate(dealt) if words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.string()),
                     pa.array([pack([w.encode() for w in dealt[i]]) for i in full], pa.binary())],
                    names=["share", "block", "words"],
                )

    return map_arrow(stored.select("block", "units"), run, "share int, block string, words binary")


def answered(questions: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """share, block, ids of the words asked for; a share is answered in one place, each of its words encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        current, known = None, {}
        for batch in batches:
            out = []
            for share, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if share != current:
                    current, known = share, {}
                answer = []
                for word in unpack(words):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = array("I", encoding.encode_ordinary(word.decode())).tobytes()
                    answer.append(ids)
                out.append(pack(answer))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["share", "block", "answer"])

    dealt = questions.repartition(_partitions(questions), "share")
    return map_arrow(dealt.sortWithinPartitions("share"), run, "share int, block string, answer binary")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, ids: the token ids of each row of docs, each match of the pattern by itself, no special tokens.

    A null or empty text has no ids.  Repeated rows and null ids are rows like
    others.  An empty table gives an empty result; other columns are ignored.
    """
    shares = 4 * _partitions(docs)
    stored = bucketed(blocks(docs, id_column, text, block_bytes), "block", _partitions(docs))
    answers = answered(asked(stored, pattern, shares), ranks_path, pattern)
    # A block's answers are as many as shares, and together no larger than its own words.
    back = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("share", "answer"))).alias("answers"))
    joined = stored.join(back, "block", "left").select(*BLOCK, "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            kind = batch.schema.field(1).type.value_type
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                yield from _documents(row, _of_units(row, compiled, shares), kind)

    def _documents(row, of_unit, kind) -> Iterator[pa.RecordBatch]:
        places = _places(row["places"])
        at, names, bodies, held = 0, [], [], 0
        for doc, count in zip(row["ids"], row["counts"]):
            body = b"".join([of_unit[p] for p in places[at : at + count].tolist()])
            at += count
            names.append(doc)
            bodies.append(body)
            held += len(body) // 4
            if held >= FLUSH_IDS:
                yield _lists(names, bodies, kind)
                names, bodies, held = [], [], 0
        if names:
            yield _lists(names, bodies, kind)

    def _lists(names, bodies, kind) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(b) // 4 for b in bodies)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(bodies), "<i4"), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.ListArray.from_arrays(pa.array(ends), values)], names=[id_column, "ids"])

    schema = T.StructType([
        T.StructField(id_column, docs.schema[id_column].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return map_arrow(joined, run, schema)


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list's ids: the found tokens stand one after another, so a list's bytes are one range of them."""
    found = table.take(lists.flatten())
    if not len(found):
        return pa.array([b""] * len(lists), pa.binary())
    offsets = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets[bounds].tobytes()), found.buffers()[2]])


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with the bytes of their ids, which each task looks up in the rank file; an unknown id is an error.

    No ids give no bytes; repeated rows each get a row; an empty table gives an
    empty one.  Null lists of ids are not expected.
    """
    schema = T.StructType([*tokens.schema.fields, T.StructField(into, T.BinaryType())])
    place = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(rank_table(ranks_path), pa.binary())
        for batch in batches:
            ends = batch.column(place).offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + FLUSH_IDS, side="right")) - 1)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, _joined(part.column(place), table)], names=[*batch.schema.names, into])
                at = to

    return map_arrow(tokens, run, schema)


def digests(tokens: DataFrame, ranks_path: str, id_column: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 of the decimal ids, decoded_sha256 of the decoded bytes."""
    return decode(tokens, ranks_path).select(
        id_column,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
