"""Quality rules with thresholds that follow the language and the source.

Each document gets a few counts.  Their rates per word are summarised per
language and source by quantile sketches: counts of logarithmic buckets whose
relative width is at most 1/32, which are merged by adding counts and give the
same quantiles in any order of merging.  A source with few documents takes the
merged sketch of its language, and a language with few that of all documents.
A rate is rejected beyond a fence that the sketch's quartiles set, so what is
usual for a source passes there.  Nothing runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.tensors import let
from pairloom.llm.common import BLANKS, text_or_empty
from pairloom.session import materialise

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
# Documents that a sketch needs to speak for itself.
ENOUGH = 100
# Rates are whole thousandths per word.
SCALE = 1000
EXACT, STEPS = 64, 32


@dataclass(frozen=True)
class Fence:
    """Rates above q75 + spread * (q75 - q25) + margin are rejected, with `below` also those as far under q25."""

    name: str
    count: str
    spread: int
    margin: int
    below: bool = False


FENCES = (
    Fence("symbols", "n_symbols", 8, 100),
    Fence("dup_lines", "n_dup_lines", 8, 100),
    Fence("word_length", "word_chars", 8, 2500, below=True),
)

_BLANK = "[ \\t-\\r]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more; windows are compared by a 64-bit hash."""

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda at, i: F.struct((at["n"] + F.least(F.lit(WINDOW), i - at["last"])).alias("n"), i.alias("last")),
            lambda at: at["n"],
        )

    def starts(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def exact(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
        found = let(F.array_sort(pairs), lambda ordered: covered(starts(ordered)))
        return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(found)

    # With too few words no window is taken, so the sequence always ascends.
    last = F.greatest(F.size(words) - F.lit(WINDOW - 1), F.lit(1))
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows, exact))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five counts and base_failed; a null text has no words."""
    body = text_or_empty(text)
    trimmed = F.btrim(body, F.lit(BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeated(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    measured = docs.withColumn("__counts", counts)
    out = measured.withColumns({name: F.col(f"__counts.{name}") for name in MEASURES}).drop("__counts")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )


def _rate(fence: Fence) -> Column:
    """Thousandths per word, rounded down; null without words."""
    return F.expr(f"CASE WHEN n_words > 0 THEN {SCALE} * {fence.count} div n_words END")


def _bucket(rate: Column) -> Column:
    """Rates below EXACT have a bucket each, above it each power of two has STEPS."""
    power = F.length(F.bin(rate)) - 1
    step = F.floor((rate - F.pow(F.lit(2), power)) * STEPS / F.pow(F.lit(2), power))
    return F.when(rate < EXACT, rate).otherwise(EXACT + (power - 6) * STEPS + step).cast("int")


def _value(bucket: Column) -> Column:
    """The lower end of a bucket."""
    over = bucket - EXACT
    power = F.floor(over / STEPS) + 6
    return F.when(bucket < EXACT, bucket).otherwise(F.pow(F.lit(2), power) * (STEPS + over % STEPS) / STEPS).cast("bigint")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, fence, bucket, n over the documents that don't fail the base rules."""
    points = F.array(*[F.struct(F.lit(f.name).alias("fence"), _bucket(_rate(f)).alias("bucket")) for f in FENCES])
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(points).alias("p"))
        .groupBy("lang", "source", "p.fence", "p.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fence, q25, q75, n of merged sketches; a sketch has a bounded number of buckets."""
    merged = sketch.groupBy(*keys, "fence", "bucket").agg(F.sum("n").alias("n"))
    spot = Window.partitionBy(*keys, "fence")
    running = merged.withColumn("upto", F.sum("n").over(spot.orderBy("bucket"))).withColumn("all", F.sum("n").over(spot))
    quantile = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("all") * share, F.col("bucket")))
    return running.groupBy(*keys, "fence").agg(
        _value(quantile(25)).alias("q25"), _value(quantile(75)).alias("q75"), F.max("all").alias("n")
    )


def _bounds(quartiles: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per keys: a struct of lower and upper bounds per fence."""
    wide = quartiles.groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("fence") == f.name, F.struct("q25", "q75"))).alias(f.name) for f in FENCES]
    )
    bounds = []
    for f in FENCES:
        reach = f.spread * (F.col(f"{f.name}.q75") - F.col(f"{f.name}.q25")) + f.margin
        bounds.append((F.col(f"{f.name}.q75") + reach).alias(f"{f.name}_most"))
        if f.below:
            bounds.append((F.col(f"{f.name}.q25") - reach).alias(f"{f.name}_least"))
    return wide.select(*keys, F.when(F.col("n") >= ENOUGH, F.struct(*bounds)).alias(name))


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, bounds: one row per pair, from its own sketch, its language's, or that of all documents."""
    sketch = materialise(sketches(measured))
    own = _bounds(_quartiles(sketch, ["lang", "source"]), ["lang", "source"], "own")
    of_lang = _bounds(_quartiles(sketch, ["lang"]), ["lang"], "of_lang").withColumnRenamed("lang", "__lang")
    # One row, or none for an empty table; too few documents of all kinds set no bounds.
    of_all = _bounds(_quartiles(sketch.withColumn("__one", F.lit(1)), ["__one"]), ["__one"], "of_all")
    row = of_all.first()
    if row is not None and row["of_all"] is not None:
        rest = F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in row["of_all"].asDict().items()])
    else:
        rest = F.lit(None).cast(of_all.schema["of_all"].dataType)
    chosen = own.join(of_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return materialise(chosen.select("lang", "source", F.coalesce("own", "of_lang", rest).alias("bounds")))


def judged(measured: DataFrame) -> DataFrame:
    """measured (stored, with lang and source) with kept.

    The thresholds are stored before the join, so the planner knows their size
    and broadcasts them only where they are small; larger ones are joined by a
    shuffle that splits hot keys.  Null languages and sources are groups too.
    """
    bounds = thresholds(measured).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = measured.join(
        bounds, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    kept = ~F.col("base_failed")
    for f in FENCES:
        rate = _rate(f)
        inside = rate <= F.col(f"bounds.{f.name}_most")
        if f.below:
            inside &= rate >= F.col(f"bounds.{f.name}_least")
        kept &= F.coalesce(inside, F.lit(True))
    return joined.withColumn("kept", kept).drop("__lang", "__source", "bounds")


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, the five counts, base_failed, kept.

    A null text has no words and fails.  Repeated rows each get a row, and count
    as often in the sketches.  Where neither a source nor its language nor all
    documents reach ENOUGH rows, only the base rules hold.  An empty table gives
    an empty result; other columns are ignored.
    """
    narrow = docs.select(
        F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("__text"), F.col("lang"), F.col("source")
    )
    measured = materialise(with_measures(narrow, "__text").drop("__text"))
    return judged(measured).select(id_column, *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    A null text fails; repeated rows are judged alike; an empty table gives an
    empty one.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__text"), "lang", "source"
    )
    measured = materialise(with_measures(whole, "__text").drop("__text"))
    return judged(measured).where("kept").select("__doc.*")
