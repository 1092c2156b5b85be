"""Key, flag and name expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from pairloom import constants as C


# Characters counted as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Text without leading or trailing white space of any kind.

    Most texts begin and end with a visible ASCII character and are left as they
    are: two comparisons cost far less than a search in the list of white space.
    """
    text = value.cast("string")
    visible = [F.substring(text, at, 1).between("!", "~") for at in (1, -1)]
    return F.when(visible[0] & visible[1], text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def is_blank(value: Column) -> Column:
    """Narrow missing test: null or white space only."""
    return F.coalesce(strip(value) == "", F.lit(True))


def is_missing(value: Column) -> Column:
    """Wide missing test: blank, or a word that stands for nothing."""
    return stands_for_nothing(strip(value))


def stands_for_nothing(text: Column) -> Column:
    """The wide missing test on text that is stripped already."""
    return F.coalesce(F.lower(text).isin(*C.MISSING_WORDS), F.lit(True))


def trimmed_key(value: Column) -> Column:
    """Trimmed key text, null where nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def fail_unless(ok: Column, value: Column, message: Column | str) -> Column:
    """The value, or a job failure where the condition does not hold."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text).cast("void"))


def bool_like(value: Column, dtype: T.DataType) -> Column:
    """Truth of a loosely typed flag; null counts as false."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(value != 0, F.lit(False))
    word = F.lower(strip(value))
    return F.coalesce(~word.isin(*C.FALSE_WORDS, *C.EMPTY_WORDS), F.lit(False))


def bool_like_strict(value: Column, dtype: T.DataType, strict: bool = False) -> Column:
    """True or false for recognised words only; null (or a failure) otherwise."""
    if isinstance(dtype, T.BooleanType):
        parsed = value
    elif isinstance(dtype, T.NumericType):
        parsed = F.when(value == 1, True).when(value == 0, False)
    else:
        word = F.lower(strip(value))
        parsed = F.when(word.isin(*C.TRUE_WORDS), True).when(word.isin(*C.FALSE_WORDS), False)
    if strict:
        return fail_unless(parsed.isNotNull(), parsed, "value is not boolean-like")
    return parsed


def path_stem(uid: Column, keep_dots: bool = True) -> Column:
    """Path-safe form of a uid: other characters become an underscore."""
    kept = r"\p{L}\p{N}\-_." if keep_dots else r"\p{L}\p{N}\-_"
    stem = F.regexp_replace(uid, f"[^{kept}]", "_")
    return stem if keep_dots else F.when(stem == "", "image").otherwise(stem)


def stem_shard(stem: Column, short: str = "xx") -> Column:
    """First two characters of a stem, or a fixed name when it is shorter."""
    return F.when(F.length(stem) >= 2, F.substring(stem, 1, 2)).otherwise(F.lit(short))


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def shard_number(name: Column, strict: bool = False) -> Column:
    """Number after 'shard' in a file name."""
    found = F.regexp_extract(name, r"shard(\d+)", 1)
    number = F.when(found != "", found.cast("bigint"))
    return fail_unless(number.isNotNull(), number, "no shard number in file name") if strict else number


def shard_split(name: Column, splits: Sequence[str] = C.SPLITS, strict: bool = False) -> Column:
    """Split a shard file belongs to, read from the start of its name."""
    split = F.coalesce(*[F.when(name.startswith(f"{s}_shard"), s) for s in splits])
    return fail_unless(split.isNotNull(), split, "no known split in file name") if strict else split


def split_rank(split: Column, splits: Sequence[str] = C.SPLITS) -> Column:
    """Place of a split in scan order; unknown ones come last."""
    rank = F.lit(len(splits))
    for place, name in enumerate(splits):
        rank = F.when(split == name, place).otherwise(rank)
    return rank.cast("bigint")


def row_order(key: Column) -> list[Column]:
    """Sort columns: all-digit keys first by number (any length), then text."""
    digits = key.rlike(r"^\d+$")
    bare = F.when(digits, F.regexp_replace(key, "^0+", ""))
    return [F.when(digits, 0).otherwise(1), F.coalesce(F.length(bare), F.lit(0)), F.coalesce(bare, F.lit("")), key]


def natural_key(path: Column) -> Column:
    """Sort key in which runs of digits, however long, compare as numbers.

    A run stands as "0", its length without leading zeros in ten digits, and
    those digits: numbers of one length compare as text, a longer one is larger.
    """
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), 1)

    def number(digits: Column) -> Column:
        bare = F.regexp_replace(digits, "^0+", "")
        return F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 10, "0"), bare)

    return F.concat(F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p)), ""), F.lit("|"), path)


def make_locator(dataset: Column, split: Column, row_idx: Column, column: Column) -> Column:
    """Locator text of one image cell."""
    return F.concat(F.lit("hf://"), F.concat_ws("/", dataset, split, row_idx.cast("string"), column))


def parse_locator(locator: Column) -> Column:
    """Struct of a locator's parts, null where the text is not a locator.

    The dataset part may contain slashes, so the parts are taken from the right.
    """
    pattern = r"^hf://(.+)/([^/]+)/\s*([+-]?\d+)\s*/([^/]+)$"
    part = lambda n: F.regexp_extract(locator, pattern, n)
    return F.when(
        locator.rlike(pattern),
        F.struct(
            part(1).alias("dataset"),
            part(2).alias("split"),
            part(3).try_cast("bigint").alias("row_idx"),
            part(4).alias("column"),
        ),
    )


def one_per_key(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with one row per key: the smallest value, by its JSON text where it isn't a string."""
    order = F.col(value) if dict(lookup.dtypes)[value] == "string" else F.to_json(F.struct(F.col(value)))
    return lookup.groupBy(key).agg(F.min_by(F.col(value), order).alias(value))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, two nulls being equal; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


PREFIX = "__prefix"


def prefix(*names: str) -> Column:
    """A number to stand in front of key columns where rows are sorted by them.

    Spark's sort compares eight bytes of the first column before it looks at the
    rows; texts often begin alike, hashes tell nearly all keys apart.
    """
    return F.xxhash64(*[F.col(c) for c in names]).alias(PREFIX)


def seeded_hash(seed: int | str, *parts: Column) -> Column:
    """Hex digest that orders rows at random, the same way on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_number(digest: Column) -> Column:
    """Integer below 2^60 from the start of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
