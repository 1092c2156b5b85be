"""Near copies by the share of common shingles: fingerprints, then rare shingles name candidates, exact Jaccard decides.

1. SimHash fingerprints of the shingles that covering masks bring within two
   bits are compared first.  At a similarity of 0.8 fingerprints differ in up to
   a third of their bits, so this finds the closest copies only.
2. Min-hash bands tell which texts may have a near copy at all: of 24 bands of
   four minima a pair at 0.8 shares none with a probability of 0.59^24 (3 in a
   million).  Only these texts' shingles are looked at further.
3. Among them the search is exact.  A text's shingles are ordered by how many
   texts have them, rare ones first.  Similar texts share one of their first
   shingles, and the places where they do bound how much they can share in all.
   Passages that many texts have in common come last in that order, and a text
   with too many shingles of its own meets nobody.
4. Texts that share a first shingle are compared with one of them, the one with
   the fewest shingles of its own, which all of a group of copies resemble.
   What is linked then is one component.  Texts for which the bounds leave a
   partner in another component go on to the next round with more texts to
   compare with, until none is left.  No pairs within a group are listed.

All of this is the same at every size: no caps, and no link is lost but by the
chance of the bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pairloom.llm import simhash
from pairloom.llm.common import encoded, map_arrow, row_key, slices, surviving
from pairloom.llm.components import components
from pairloom.session import materialise

WORDS = 5
# Similar: common shingles * 5 >= all shingles of both * 4.
PART, WHOLE = 4, 5
BANDS, MINIMA = 24, 4
RADIUS = 2
# Texts of a bucket that the others are compared with: one in the first round, then so many times more in each.
STEP = 8
_RANDOM = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _RANDOM.integers(0, (1 << 64) - 1, BANDS * MINIMA, np.uint64)


def distinct_shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of lower-cased (A-Z) words; a shorter text is one run, also that without a word."""
    return np.unique(simhash.shingle_hashes(text, words, blank=True)).astype(np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; the band's number is part of it."""
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096, None] ^ _FLIPS) * _FACTORS).min(0))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _with(docs: DataFrame, make, fields: list[T.StructField], kinds: list[pa.DataType]) -> DataFrame:
    """docs, of which __text is the last column, with what make(text) returns in its place."""
    names = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, batch.num_columns - 1):
                made = [make(t) for t in piece.column(piece.num_columns - 1).to_pylist()]
                columns = zip(*made) if made else [[]] * len(kinds)
                arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *arrays], names=[*names, *(f.name for f in fields)])

    schema = T.StructType([*docs.schema.fields[:-1], *fields])
    return map_arrow(docs.select(*names, encoded("__text").alias("__text")), run, schema)


def _signed(keyed: DataFrame, words: int) -> DataFrame:
    """keyed with node (digest of the shingle set), fp and bands in place of its text."""

    def make(text: bytes):
        hashes = simhash.shingle_hashes(text, words, blank=True)
        own = np.unique(hashes).astype(np.uint64)
        return xxhash.xxh3_128_digest(own.tobytes()), simhash.signed(simhash.majority(hashes)), bands(own)

    fields = [T.StructField("node", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return _with(keyed, make, fields, [pa.binary(), pa.int64(), pa.list_(pa.int64())])


def _sets(named: DataFrame, words: int) -> DataFrame:
    """named with its shingles (set) in place of its text."""
    make = lambda t: (distinct_shingles(t, words).view(np.int64),)
    return _with(named, make, [T.StructField("set", T.ArrayType(T.LongType()))], [pa.list_(pa.int64())])


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """(u, v): nodes of equal fingerprints as stars, and one node for each link of fingerprints."""
    prints = materialise(rows.select("fp", "node").distinct())
    lead = prints.groupBy("fp").agg(F.min("node").alias("lead"))
    same = prints.join(lead, "fp").where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    of = lambda c: lead.select(F.col("fp").alias(f"fp_{c}"), F.col("lead").alias(c))
    near = simhash.links(prints, RADIUS).select(F.col("u").alias("fp_u"), F.col("v").alias("fp_v"))
    return same.unionByName(near.join(of("u"), "fp_u").join(of("v"), "fp_v").where("u <> v").select("u", "v"))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    common = F.size(F.array_intersect("set_u", "set_v"))
    either = F.size("set_u") + F.size("set_v") - common
    return pairs.join(of("u"), "u").join(of("v"), "v").where(common * WHOLE >= either * PART).select("u", "v")


def _entries(sets: DataFrame) -> DataFrame:
    """A row (h, node, n, most, own) for each of a node's first shingles that another node may meet there.

    `n` is the size of its set, `most` that of the largest partner for which the
    shingle's place p allows a common share of 0.8: two sets that have their
    first common shingle at places p and q share min(n - p, m - q) at most.
    `own` is the share of shingles that no other node has.
    """
    tokens = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("h"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = tokens.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("list"))
    single = F.col("n") - F.size("list")
    first = F.expr(f"n - ({PART} * n + {WHOLE - 1}) div {WHOLE} + 1").cast("int")
    named = ordered.select("node", "n", single.alias("single"), F.slice("list", F.lit(1), F.greatest(F.lit(0), first - single)).alias("list"))
    placed = named.select("node", "n", "single", F.posexplode("list").alias("at", "x"))
    most = F.expr(f"({PART + WHOLE} * (n - single - at)) div {PART} - n")
    entries = placed.select(F.col("x.h").alias("h"), "node", "n", most.alias("most"), (F.col("single") / F.col("n")).alias("own"))
    met = entries.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return entries.join(met, "h", "left_semi")


def _open(entries: DataFrame) -> DataFrame:
    """The entries (with root) for which the bounds leave a partner with another root.

    A bucket's entries are summed up per size: the largest `most`, and the
    largest one of another root.
    """
    best = entries.groupBy("h", "n", "root").agg(F.max("most").alias("most"))
    top = best.groupBy("h", "n").agg(F.max(F.struct("most", "root")).alias("top"))
    other = best.join(top, ["h", "n"]).where("root <> top.root").groupBy("h", "n").agg(F.max("most").alias("second"))
    sizes = top.join(other, ["h", "n"], "left").select(F.col("h").alias("of"), F.col("n").alias("m"), "top", "second")
    reach = F.when(F.col("root") == F.col("top.root"), F.col("second")).otherwise(F.col("top.most"))
    meets = (F.col("h") == F.col("of")) & (F.col("m") <= F.col("most")) & (F.col("m") * WHOLE >= F.col("n") * PART) & (reach >= F.col("n"))
    return entries.join(sizes, meets, "left_semi")


def _with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    joined = entries.join(roots, "node", "left")
    return joined.select("h", "node", "n", "most", "own", F.coalesce("root", "node").alias("root"))


def groups(rows: DataFrame, texts: DataFrame, words: int = WORDS, step: int = STEP) -> DataFrame:
    """(node, root) for the nodes that are similar to another, by chains of similar ones; roots are left out.

    `rows` (stored) has key, node, fp, bands; `texts` has key and __text.
    """
    every = rows.select("node", F.explode("bands").alias("band")).distinct()
    met = every.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    pairs = materialise(_by_fingerprint(rows).distinct())
    candidates = every.join(met, "band", "left_semi").select("node")
    candidates = candidates.unionByName(pairs.select(F.col("u").alias("node"))).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # One text stands for all with the same shingles.
    named = materialise(rows.groupBy("node").agg(F.min("key").alias("key")).join(candidates, "node", "left_semi"))
    sets = materialise(_sets(named.join(texts, "key").select("node", "__text"), words).dropDuplicates(["node"]))

    links = materialise(_alike(pairs, sets))
    roots = components(links)
    entries = materialise(_entries(sets))
    count = 1
    while True:
        now = materialise(_open(_with_roots(entries, roots)))
        if now.isEmpty():
            return roots
        nth = F.row_number().over(Window.partitionBy("h").orderBy("own", "node"))
        chosen = materialise(now.withColumn("nth", nth).where(F.col("nth") <= count).drop("nth"))
        lead = chosen.select("h", *[F.col(c).alias(f"lead_{c}") for c in ("node", "n", "most", "root")])
        fits = "root <> lead_root AND n <= lead_most AND lead_n <= most"
        pairs = now.join(lead, "h").where(fits).select(F.least("node", "lead_node").alias("u"), F.greatest("node", "lead_node").alias("v"))
        links = _alike(materialise(pairs.distinct()), sets)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))
        entries = materialise(now.drop("root").join(chosen.select("h", "node"), ["h", "node"], "left_anti"))
        count *= step


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, step: int = STEP) -> DataFrame:
    """Of each group of similar texts one row of docs stays: that with the smallest id (null ids last), once if repeated.

    A group is what chains of similar texts connect.  A null text is empty; texts
    without a word are similar to each other, texts of fewer words than a shingle
    to those with the same words.  An empty table gives an empty result, other
    columns stay as they are.
    """
    keyed = docs.select(
        row_key(id_column, text).alias("key"),
        F.struct(F.col(f"`{id_column}`").isNull().alias("none"), F.col(f"`{id_column}`").alias("id")).alias("place"),
        F.col(f"`{text}`").alias("__text"),
    )
    rows = materialise(_signed(keyed, words))
    roots = materialise(groups(rows, keyed.select("key", "__text"), words, step))
    grouped = rows.select("key", "place", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = grouped.groupBy("root").agg(F.min(F.struct("place", "key"))["key"].alias("key"))
    kept = stays.select("key").distinct().withColumn("stays", F.lit(True))
    verdicts = rows.select("key").join(kept, "key", "left").select("key", F.col("stays").isNotNull().alias("kept"))
    return surviving(docs, verdicts, id_column, text)
