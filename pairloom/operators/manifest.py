"""Image-uid manifests: sightings, metadata, paths, payloads and needed uids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom import constants as C
from pairloom.functions import keys as K
from pairloom.operators.ranking import position_by_sort
from pairloom.session import materialise

SIDES = (("image_0_uid", "jpg_0", "image_1_uid"), ("image_1_uid", "jpg_1", "image_0_uid"))
# Rows of one split take the low 55 bits of a scan ordinal.
SPLIT_STEP = 1 << 55


def scan_ordinal(split: Column, row_idx: Column, side: Column | int = 0, splits: Sequence[str] = C.SPLITS) -> Column:
    """Integer that orders cells by split, row and side."""
    side = F.lit(side) if isinstance(side, int) else side
    return K.split_rank(split, splits) * F.lit(SPLIT_STEP) + row_idx * 2 + side


def image_cell(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(payload, source path) of an image cell stored as bytes, text, struct or one-item array."""
    from pyspark.sql import types as T

    none = (F.lit(None).cast("binary"), F.lit(None).cast("string"))
    if column not in df.columns:
        return none

    def parts(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
        if isinstance(dtype, T.ArrayType):
            return parts(F.when(F.size(value) == 1, value[0]), dtype.elementType)
        if isinstance(dtype, T.BinaryType):
            return value, none[1]
        if isinstance(dtype, T.StringType):
            return none[0], value
        if isinstance(dtype, T.StructType):
            names = dtype.fieldNames()
            payload = parts(value["bytes"], dtype["bytes"].dataType)[0] if "bytes" in names else none[0]
            path = value["path"].cast("string") if "path" in names else none[1]
            return payload, path
        return none

    return parts(F.col(column), df.schema[column].dataType)


def sightings(prefs: DataFrame, include_fields: Sequence[str] = ()) -> DataFrame:
    """One row per image cell: uid, partner, caption, best flag, payload, source path, scan ordinal."""
    cells = []
    for side, (uid, image, partner) in enumerate(SIDES):
        payload, path = image_cell(prefs, image)
        cells.append(
            F.struct(
                F.col(uid).cast("string").alias("uid"),
                F.col(partner).cast("string").alias("partner_uid"),
                F.lit(image).alias("image_column"),
                F.lit(side).alias("side"),
                payload.alias("payload"),
                path.alias("source_path"),
            )
        )
    kept = ["split", "row_idx", "caption", "best_image_uid", *[f for f in include_fields if f in prefs.columns]]
    rows = prefs.select(*[c for c in kept if c in prefs.columns], F.explode(F.array(*cells)).alias("c"))
    rows = rows.select(*[c for c in rows.columns if c != "c"], "c.*").filter(F.col("uid").isNotNull())
    best = F.coalesce(F.col("best_image_uid").cast("string") == F.col("uid"), F.lit(False))
    return rows.withColumn("is_best", best).withColumn(
        "ord", scan_ordinal(F.col("split"), F.col("row_idx"), F.col("side"))
    )


def uid_counts(cells: DataFrame, splits: Sequence[str] = C.SPLITS, include_fields: Sequence[str] = ()) -> DataFrame:
    """Per uid: occurrences, per-split map, best and other counts, first and last sighting."""
    seen = F.struct("split", "row_idx", "image_column")
    per_split = [F.count_if(F.col("split") == s).alias(f"__{s}") for s in splits]
    extra = [F.min_by(F.col(f), "ord").alias(f"field__{f}") for f in include_fields if f in cells.columns]
    grouped = cells.groupBy("uid").agg(
        F.count(F.lit(1)).alias("num_occurrences"),
        *per_split,
        F.count_if("is_best").alias("best_count"),
        F.count_if(~F.col("is_best")).alias("non_best_count"),
        F.min_by(seen, "ord").alias("first_seen"),
        F.max_by(seen, "ord").alias("last_seen"),
        *extra,
    )
    entries = F.filter(
        F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"__{s}").alias("value")) for s in splits]),
        lambda e: e["value"] > 0,
    )
    return grouped.withColumn("split_counts", F.map_from_entries(entries)).drop(*[f"__{s}" for s in splits])


def capped_samples(cells: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """First n distinct values per uid in scan order.

    Repeats are folded by a combining aggregate; the ranking then keeps n rows
    per uid on the map side already, so a hot uid ships n rows per task.
    """
    firsts = (
        cells.filter(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy("uid", value)
        .agg(F.min("ord").alias("__o"))
    )
    ranked = firsts.withColumn("__rn", F.row_number().over(Window.partitionBy("uid").orderBy("__o")))
    return (
        ranked.filter(F.col("__rn") <= n)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("__rn", value))).alias(name))
        .withColumn(name, F.transform(name, lambda s: s[value]))
    )


def capped_lists(cells: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """uid and a list per column: its first values in scan order, each once, as many as its limit says.

    All columns go through one folding aggregate, one ranking that keeps the
    largest limit's rows on the map side already, and one gathering per uid.
    """
    values = [F.when(F.col(c) != "", F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))) for i, c in enumerate(limits)]
    flat = cells.select("uid", "ord", F.explode(F.array_compact(F.array(*values))).alias("x")).select("uid", "ord", "x.k", "x.v")
    firsts = flat.groupBy("uid", "k", "v").agg(F.min("ord").alias("o"))
    ranked = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("uid", "k").orderBy("o")))
    ranked = ranked.filter(F.col("rn") <= max(limits.values()))
    fits = [(F.col("k") == i) & (F.col("rn") <= n) for i, n in enumerate(limits.values())]
    gathered = ranked.filter(reduce(or_, fits)).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "rn", "v"))).alias("x"))
    of = lambda i: F.transform(F.filter("x", lambda s: s["k"] == i), lambda s: s["v"])
    return gathered.select("uid", *[of(i).alias(c) for i, c in enumerate(limits)])


def uid_metadata(
    prefs: DataFrame,
    captions: int = 3,
    partners: int = 6,
    paths: int = 4,
    include_fields: Sequence[str] = (),
    splits: Sequence[str] = C.SPLITS,
) -> DataFrame:
    """Full metadata record per image uid."""
    cells = sightings(prefs, include_fields)
    meta = uid_counts(cells, splits, include_fields)
    names = {"caption": "caption_samples", "partner_uid": "partner_uid_samples", "source_path": "source_paths"}
    limits = {c: n for c, n in zip(names, (captions, partners, paths)) if n > 0}
    if limits:
        lists = capped_lists(cells, limits).withColumnsRenamed({c: names[c] for c in limits})
        meta = meta.join(lists, "uid", "left")
    empty = F.array().cast("array<string>")
    return meta.withColumns({n: F.coalesce(F.col(n), empty) if c in limits else empty for c, n in names.items()})


def first_paths(cells: DataFrame, path: Column) -> DataFrame:
    """uid -> first non-null path in scan order."""
    located = cells.select("uid", "ord", path.alias("path")).filter(F.col("path").isNotNull())
    return located.groupBy("uid").agg(F.min_by("path", "ord").alias("path"))


def locator_paths(cells: DataFrame, dataset: str) -> DataFrame:
    """uid -> locator of its first cell, for images that stay in the dataset."""
    return first_paths(cells, K.make_locator(F.lit(dataset), F.col("split"), F.col("row_idx"), F.col("image_column")))


def materialise_images(cells: DataFrame, overwrite: bool = False) -> DataFrame:
    """One payload row per uid with its shard.

    The first payload in scan order is kept, or the last one with `overwrite`;
    a uid without payload keeps its first source path.
    """
    pick = F.max if overwrite else F.min
    has = F.col("payload").isNotNull()
    grouped = cells.groupBy("uid").agg(
        pick(F.when(has, F.col("ord"))).alias("__won"),
        F.min_by(
            F.when(F.col("source_path") != "", F.col("source_path")),
            F.when(F.coalesce(F.col("source_path") != "", F.lit(False)), F.col("ord")),
        ).alias("source_path"),
        F.min("ord").alias("first_ord"),
    )
    # Bytes are fetched for the chosen cell only, no aggregation holds them; cells have an ord of their own.
    bytes_of = cells.where(has).select(F.col("uid").alias("__uid"), F.col("ord").alias("__ord"), "payload")
    same = F.col("uid").eqNullSafe(F.col("__uid")) & (F.col("__won") == F.col("__ord"))
    grouped = grouped.join(bytes_of, same, "left").drop("__uid", "__ord", "__won")
    stem = K.path_stem(F.col("uid"))
    return grouped.select(
        "uid",
        K.stem_shard(stem).alias("shard"),
        stem.alias("stem"),
        "payload",
        F.when(F.col("payload").isNull(), F.col("source_path")).alias("source_path"),
        (F.col("payload").isNull() & F.col("source_path").isNull()).alias("unresolved"),
    )


def attach(rows: DataFrame, lookup: DataFrame, value: str, name: str, unique: bool = False) -> DataFrame:
    """Left-joins a per-uid value for both sides of a pair.

    Of repeated uids in the lookup one value counts, so rows never multiply;
    `unique` says that there are none, which spares wide values an aggregation.

    The lookup is a table that grows with the data, so no broadcast is forced:
    the planner picks one when its size allows, else both joins shuffle on uid
    and adaptive execution splits a hot uid.
    """
    lookup = lookup if unique else K.one_per_key(lookup, "uid", value)
    for side in ("preferred", "dispreferred"):
        right = lookup.select(F.col("uid").alias(f"{side}_uid"), F.col(value).alias(f"{side}_{name}"))
        rows = rows.join(right, f"{side}_uid", "left")
    return rows


def attach_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds preferred_path and dispreferred_path."""
    return attach(rows, paths.filter(F.col("path").isNotNull()), "path", "path")


def attach_meta(rows: DataFrame, meta: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Adds preferred_meta and dispreferred_meta structs."""
    fields = fields or [c for c in meta.columns if c != "uid"]
    packed = meta.select("uid", F.struct(*[f for f in fields if f in meta.columns]).alias("meta"))
    return attach(rows, packed, "meta", "meta")


def compact_meta(meta: DataFrame) -> DataFrame:
    """uid with the struct of fields kept in latent manifests."""
    return meta.select("uid", F.struct(*[f for f in C.COMPACT_META_FIELDS if f in meta.columns]).alias("uid_meta"))


def caption_for(meta: DataFrame, default: str) -> Column:
    """First caption sample, else the caption, else a default."""
    options = []
    if "caption_samples" in meta.columns:
        options.append(F.try_element_at("caption_samples", F.lit(1)))
    if "caption" in meta.columns:
        options.append(F.col("caption").cast("string"))
    return F.coalesce(*options, F.lit(default))


def referenced_uids(assignments: DataFrame, include_support: bool = False, order: str | None = None) -> DataFrame:
    """(uid, ord) of every uid named by query pairs, and by support pairs on request.

    `ord` follows the line (the `order` column), then query before support, then
    pair, then preferred before dispreferred.
    """
    line = F.col(order) if order else F.lit(0).cast("bigint")  # without an order all rows are one line
    lists = [("query_pairs", 0)] + ([("support_pairs", 1)] if include_support else [])

    def tagged(column: str, rank: int) -> Column:
        filled = F.coalesce(F.col(column), F.array().cast(assignments.schema[column].dataType))
        return F.transform(
            filled,
            lambda p, i: F.struct(
                F.lit(rank).alias("list"),
                i.alias("i"),
                K.trimmed_key(p["preferred_uid"]).alias("preferred_uid"),
                K.trimmed_key(p["dispreferred_uid"]).alias("dispreferred_uid"),
            ),
        )

    pairs = F.concat(*[tagged(column, rank) for column, rank in lists])
    rows = assignments.select(line.alias("line"), F.explode(pairs).alias("p"))
    valid = F.col("p.preferred_uid").isNotNull() & F.col("p.dispreferred_uid").isNotNull()
    return (
        rows.filter(valid)
        .select(
            "line",
            F.col("p.list").alias("list"),
            F.col("p.i").alias("i"),
            F.posexplode(F.array("p.preferred_uid", "p.dispreferred_uid")).alias("side", "uid"),
        )
        .select("uid", F.struct("line", "list", "i", "side").alias("ord"))
    )


def ordered_unique_uids(uids: DataFrame) -> DataFrame:
    """Distinct uids with their place by first sighting, for (uid, ord) with a struct ordinal.

    The places come from a range sort, so uids that share an ordinal (all of a
    frame without an order) are spread as well; among those the uid decides.
    """
    firsts = uids.groupBy("uid").agg(F.min("ord").alias("o"))
    # One row per uid; stored, because a range sort reads its input twice.
    return position_by_sort(materialise(firsts), [F.col("o"), F.col("uid")], "place").select("uid", "place")


def extraction_counters(assignments: DataFrame, include_support: bool = False) -> DataFrame:
    """One row: records, pairs and malformed pieces of an assignment table.

    A `bad_line` column, where present, marks lines that were not JSON ('json')
    or not objects ('shape').
    """
    bad = F.col("bad_line") if "bad_line" in assignments.columns else F.lit(None).cast("string")
    good = bad.isNull()
    pair_ok = lambda p: K.trimmed_key(p["preferred_uid"]).isNotNull() & K.trimmed_key(p["dispreferred_uid"]).isNotNull()
    lists = ["query_pairs"] + (["support_pairs"] if include_support else [])
    n_ok = {c: F.coalesce(F.size(F.filter(c, pair_ok)), F.lit(0)) for c in lists}
    n_bad = {c: F.coalesce(F.size(F.filter(c, lambda p: ~pair_ok(p))), F.lit(0)) for c in lists}
    no_list = sum((F.when(good & F.col(c).isNull(), 1).otherwise(0) for c in lists), F.lit(0))
    total = lambda c: F.coalesce(F.sum(F.when(good, c).otherwise(0)), F.lit(0)).cast("bigint")
    return assignments.agg(
        F.count_if(good).alias("num_records_seen"),
        total(n_ok["query_pairs"]).alias("num_query_pairs_seen"),
        (total(n_ok["support_pairs"]) if include_support else F.lit(0).cast("bigint")).alias("num_support_pairs_seen"),
        F.count_if(bad == "json").alias("num_skipped_malformed_lines"),
        (F.count_if(bad == "shape") + F.coalesce(F.sum(no_list), F.lit(0))).cast("bigint").alias(
            "num_skipped_malformed_records"
        ),
        total(sum(n_bad.values(), F.lit(0))).alias("num_skipped_malformed_pairs"),
    )


def resolve_needed(needed: DataFrame, paths: DataFrame, strict: bool = False) -> DataFrame:
    """Needed uids with path and a `missing` flag; strict fails on a missing one."""
    joined = needed.join(paths.filter(F.col("path").isNotNull()), "uid", "left")
    if strict:
        joined = joined.withColumn(
            "path", F.coalesce("path", F.raise_error(F.concat(F.lit("no path for uid "), F.col("uid"))).cast("string"))
        )
    return joined.withColumn("missing", F.col("path").isNull()).withColumn(
        "is_locator", F.coalesce(F.col("path").startswith("hf://"), F.lit(False))
    )


def uid_difference(left: DataFrame, right: DataFrame, key: str = "uid") -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def dedupe_records(records: DataFrame, keys: Sequence[str] = ("uid", "path")) -> DataFrame:
    """One record per key set (nulls equal)."""
    return records.dropDuplicates(list(keys))


def not_yet_written(df: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return df.join(existing.select(*key), list(key), "left_anti")
