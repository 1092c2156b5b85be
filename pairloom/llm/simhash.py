"""SimHash near-duplicates found by covering locality-sensitive hashing.

For radius r there are 2^(r+1) - 1 tables.  Bit i of a fingerprint has a vector
m(i) of r + 1 bits, not zero; table v keeps the bits whose m(i) has an odd inner
product with v.  Any r differing bits leave some v that is orthogonal to all of
their vectors, so every pair within the radius agrees in a table, for certain.

Fingerprints that meet another one in a table are candidates.  For radius 2 (or
less) they are linked without looking at pairs: two of them are at most 2 bits
apart exactly if some key is at most 1 bit from both, and at most 65
fingerprints share a key.  So a bucket of any size costs linear work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pairloom.llm.common import encoded, map_arrow, row_key, spare, surviving
from pairloom.llm.components import components
from pairloom.session import materialise

BITS = 64


def masks(radius: int) -> list[int]:
    """The bits that each table keeps, as unsigned numbers."""
    vectors = (1 << radius + 1) - 1
    kept = lambda v: sum(1 << i for i in range(BITS) if (i % vectors + 1 & v).bit_count() % 2)
    return [kept(v) for v in range(1, vectors + 1)]


def signed(number: int) -> int:
    return number - (1 << BITS) if number >> BITS - 1 else number


def shingle_hashes(text: bytes, words: int, blank: bool = False) -> np.ndarray:
    """XXH64 (big-endian) of every run of lower-cased (A-Z) words; a text without a word has none, or that of b"" if `blank`."""
    found = text.lower().split()
    if not found:
        return np.array([xxhash.xxh64_intdigest(b"", 42)] * blank, ">u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    size = min(words, len(found))
    starts = [0, *(ends[: len(found) - size] + 1).tolist()]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], ">u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    """Lower-cased (A-Z) words; a bit is set if it is in over half of the shingles' hashes; no word gives 0."""
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, into: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    raw = spare(docs, "__bytes")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(t.as_py(), words)) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())])
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names], encoded(text).alias(raw)), run, schema)


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect exactly what links within the radius connect."""
    if radius not in (1, 2):
        raise ValueError("links are found exactly for a radius of 1 or 2")
    kept = [signed(m) for m in masks(radius)]
    tables = materialise(
        prints.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in kept])).alias("t", "key"))
    )
    shared = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Near keys may differ in the bits that the table leaves out, for there the pair differs.
    free = [[signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks(radius)]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(b) for b in bits]) for bits in free]), F.col("t") + 1)
    flipped = tables.join(shared, ["t", "key"]).select("fp", F.explode(flips).alias("flip"))
    near = flipped.select("fp", "flip", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if radius == 1:
        met = near.where("flip <> 0").join(prints.select(F.col("fp").alias("z")).distinct(), "z", "left_semi")
        return met.select(F.col("fp").alias("u"), F.col("z").alias("v")).distinct()
    near = near.select("fp", "z").distinct()
    stars = near.groupBy("z").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    return stars.select(F.array_min("near").alias("u"), F.explode("near").alias("v")).where("u <> v").distinct()


def near_groups(prints: DataFrame, id_column: str, radius: int = 2) -> DataFrame:
    """(fp, component): the smallest id reachable from each fingerprint.  `prints` must be stored."""
    nodes = prints.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = components(links(prints, radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named)
    grouped = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(grouped, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Fingerprints link at `radius` or fewer differing bits, equal ones always.
    A null text is empty; texts without a word have fingerprint zero, which
    links like any other.  Null ids are ignored for component_id unless all of
    a component's are null.  Repeated rows each get a row.  An empty table gives
    an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("__text"))
    prints = materialise(with_fingerprint(narrow, "__text", words).drop("__text"))
    groups = near_groups(prints, id_column, radius)
    return prints.join(groups, "fp").select(
        id_column,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs of each group stays: that with the smallest id (null ids last), the first stored of repeated ones.

    A null text is empty; texts without a word are one group; an empty table
    gives an empty one.
    """
    keyed = docs.select(
        F.col(f"`{id_column}`").alias("id"), row_key(id_column, text).alias("key"), F.col(f"`{text}`").alias("__text")
    )
    prints = with_fingerprint(keyed, "__text", words).drop("__text").withColumn("row", F.monotonically_increasing_id())
    # Rows stand in for documents: their order is that of the ids, then of the rows.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    ranked = materialise(prints.select("key", "fp", "row", place.alias("place")))
    stays = near_groups(ranked, "place", radius).select(F.col("component.row").alias("row"), F.lit(True).alias("stays")).distinct()
    verdicts = ranked.join(stays, "row", "left").select("key", F.coalesce("stays", F.lit(False)).alias("kept"))
    return surviving(docs, verdicts, id_column, text)
