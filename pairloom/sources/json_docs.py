"""JSON and JSON-lines readers that tolerate the layouts in use.

Documents are read in byte ranges (json_items.py), so a large one is the work of
many tasks and none of them holds it.  A document that is broken anywhere is
left out as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pairloom.functions import keys as K
from pairloom.operators.ranking import BUCKET, _offset_ranks
from pairloom.session import materialise
from pairloom.sources.file_lists import list_tree, read_files
from pairloom.sources.json_items import RANGE_BYTES, read_items

# What each kind of document starts with.
_STARTS = {"columnar": ("[", "{"), "grouped": ("{",), "mapping": ("{",), "uids": ("[", "{"), "samples": ("[", "{")}


def _judged(spark: SparkSession, path: str | Sequence[str], kind: str, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(items, documents): items with their text as a JSON list or object of one entry; documents with reason.

    Reason: null for a usable document; json where it can't be parsed, shape for
    another layout, no_uids or no_samples.
    """
    items, docs = read_items(spark, path, range_bytes)
    text = F.col("text").cast("string")
    whole = (
        F.when(F.col("kind").isin("scalar", "map"), F.concat(F.lit("{"), text, F.lit("}")))
        .when(F.col("kind").isin("record", "list"), F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
    )
    items = items.select("file", "column", "kind", "place", whole.alias("text"))
    valid = F.when(F.col("kind") == "bad", False).otherwise((F.col("kind") == "box") | F.try_parse_json("text").isNotNull())
    # A document is used only when all of its items are known to be sound; they are stored, so this reads them once more.
    broken = items.where(~valid).select("file").distinct().withColumn("broken", F.lit(True))
    docs = docs.join(broken, "file", "left")
    lacks = []
    if kind in ("uids", "samples"):
        held = items.where((F.col("kind") == "box") & (F.col("column") == kind) & (F.col("text") == "[")).select("file").distinct()
        docs = docs.join(held.withColumn("held", F.lit(True)), "file", "left")
        lacks = [F.when((F.col("top") == "{") & F.col("held").isNull(), f"no_{kind}")]
    unsound = F.col("fault") | F.col("broken").isNotNull()
    reason = F.coalesce(F.when(unsound, "json"), F.when(~F.col("top").isin(*_STARTS[kind]), "shape"), *lacks)
    return items, materialise(docs.select("file", "top", reason.alias("reason")))


def document_reasons(spark: SparkSession, path: str | Sequence[str], kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, reason) of each document: why the reader of this kind leaves it out, null if it doesn't.

    Kinds: columnar, grouped, mapping, uids, samples, sidecar.  Sidecars are
    small and read whole.
    """
    if kind == "sidecar":
        return _whole_documents(list_tree(spark, path, recursive=False)).select("file", _sidecar_reason().alias("reason"))
    return _judged(spark, path, kind, range_bytes)[1].select("file", "reason")


def _strict(docs: DataFrame) -> DataFrame:
    what = F.concat(F.lit("unusable document ("), F.col("reason"), F.lit(") "), F.col("file"))
    return docs.filter(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(what).cast("boolean")))


def _usable(spark: SparkSession, path: str | Sequence[str], kind: str, strict: bool, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Items of the documents without a reason, and those documents (file, top); with strict a broken one fails at once."""
    items, docs = _judged(spark, path, kind, range_bytes)
    docs = (materialise(_strict(docs)) if strict else docs.filter("reason IS NULL")).select("file", "top")
    return items.join(docs.select("file"), "file", "left_semi"), docs


def _one(text: Column, kind: T.DataType) -> Column:
    """The value of a list of one."""
    return F.get(F.from_json(text, T.ArrayType(kind)), F.lit(0))


def _entry(text: Column, kind: T.DataType) -> Column:
    """Key and value of an object of one."""
    return F.get(F.map_entries(F.from_json(text, T.MapType(T.StringType(), kind))), F.lit(0))


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line_no, line) of text files, numbered from 0 in file order.

    Lines are ranked inside each block of a file and block sizes give the
    offset, so a large file stays spread over its blocks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(BUCKET),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("line"),
    )
    return _offset_ranks(rows, ["file"], [F.col("__at")], "line_no").select("file", "line_no", "line")


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines parsed into `schema` columns plus `bad_line`: null, 'json' or 'shape'. Blank lines are dropped."""
    loose = T.StructType(list(schema.fields) + [T.StructField("__bad", T.StringType())])
    text = K.strip(F.col("line"))
    rows = lines.withColumn("line", text).filter(F.col("line") != "")
    rows = rows.withColumn("r", F.from_json("line", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    # Only lines the typed parser refused are parsed again.
    valid = F.col("r.__bad").isNull() | F.try_parse_json("line").isNotNull()
    bad = F.when(~F.coalesce(valid, F.lit(False)), "json").when(~F.col("line").startswith("{"), "shape")
    return rows.select("file", "line_no", *[F.col("r")[f.name].alias(f.name) for f in schema.fields], bad.alias("bad_line"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, strict: bool = False) -> DataFrame:
    """Records of JSON-lines files with their file and line number.

    Lines that are not JSON objects are dropped, or fail the job when strict;
    `parse_lines` keeps them, marked, for counting.
    """
    rows = parse_lines(read_lines(spark, path), schema)
    ok = F.col("bad_line").isNull()
    if strict:
        where = F.concat(F.lit("bad line "), F.col("line_no").cast("string"), F.lit(" in "), F.col("file"))
        ok = F.when(ok, True).otherwise(F.raise_error(where).cast("boolean"))
    return rows.filter(ok).drop("bad_line")


def _numbered(rows: DataFrame) -> DataFrame:
    """row_idx: a row's place in its document, digit keys first by number, then others by text.

    Keys with the same beginning are ranked together, so no document is ranked in one task.
    """
    number = F.regexp_replace("row_key", "^0+", "")
    size = F.length(number)
    digits = F.concat(F.lit("0"), F.lpad(size.cast("string"), 10, "0"), F.substring(number, F.lit(1), F.greatest(size - 4, F.lit(0))))
    bucket = F.when(F.col("row_key").rlike(r"^\d+$"), digits).otherwise(F.concat(F.lit("1"), F.substring("row_key", 1, 8)))
    return _offset_ranks(rows.withColumn(BUCKET, bucket), ["file"], K.row_order(F.col("row_key")), "row_idx")


def read_columnar_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, strict: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Records of documents in any of the accepted layouts, with file, row_key and row_idx.

    Layouts: list of records; {column: {row: value}}; {column: [values]}; plain
    columns are repeated on every row; an object without nesting is one record.
    Absent cells are null.  Rows are numbered digits first, then by text.
    """
    fields, names = schema.fields, [f.name for f in schema.fields]
    items, docs = _usable(spark, path, "columnar", strict, range_bytes)
    text, kind, column = F.col("text"), F.col("kind"), F.col("column")
    records = items.where(kind == "record").select("file", F.col("place").cast("string").alias("row_key"), _one(text, schema).alias("r"))
    records = records.select("file", "row_key", "r.*")

    cell = lambda f: F.when(kind == "map", _entry(text, f.dataType)["value"]).otherwise(_one(text, f.dataType))
    key = F.when(kind == "map", _entry(text, T.StringType())["key"]).otherwise(F.col("place").cast("string"))
    # Cells of one row meet in a shuffle on (file, row).
    cells = items.where(kind.isin("map", "list") & column.isin(*names)).select(
        "file", key.alias("row_key"), *[F.when(column == f.name, cell(f)).alias(f.name) for f in fields]
    )
    gathered = cells.groupBy("file", "row_key").agg(*[F.any_value(n, True).alias(n) for n in names])
    plain = items.where(kind == "scalar").select("file", F.from_json(text, schema).alias("s"))
    plain = plain.groupBy("file").agg(F.struct(*[F.any_value(f"s.{n}", True).alias(n) for n in names]).alias("s"))
    nested = items.where((kind == "box") & column.isin(*names)).select("file").distinct()
    columnar = gathered.join(plain, "file", "left").select(
        "file", "row_key", *[F.coalesce(F.col(n), F.col("s")[n]).alias(n) for n in names]
    )
    single = docs.where("top = '{'").join(nested, "file", "left_anti").join(plain, "file", "left")
    single = single.select("file", F.lit("0").alias("row_key"), *[F.col("s")[n].alias(n) for n in names])
    return _numbered(records.unionByName(columnar).unionByName(single))


def read_user_grouped_json(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, strict: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Records of {user: [record, ...]} documents; a record's own user_id wins over the key."""
    fields = [f for f in schema.fields if f.name != "user_id"]
    record = T.StructType([T.StructField("user_id", T.StringType()), *fields])
    items, _ = _usable(spark, path, "grouped", strict, range_bytes)
    rows = items.where("kind = 'list'").select("file", "column", F.col("place").alias("pos"), _one(F.col("text"), record).alias("r"))
    return rows.select(
        "file", "pos", F.coalesce(F.col("r.user_id"), F.col("column")).alias("user_id"), *[F.col("r")[f.name].alias(f.name) for f in fields]
    )


def read_mapping_json(
    spark: SparkSession, path: str | Sequence[str], value: str = "path", strict: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """(uid, value) of object documents; null values are dropped, keys become trimmed text."""
    items, _ = _usable(spark, path, "mapping", strict, range_bytes)
    parsed = items.where("kind = 'scalar'").select(_entry(F.col("text"), T.StringType()).alias("e"))
    return parsed.select(F.col("e.key").alias("uid"), F.col("e.value").alias(value)).filter(F.col(value).isNotNull()).select(
        K.trimmed_key(F.col("uid")).alias("uid"), value
    )


def _listed(items: DataFrame, name: str) -> DataFrame:
    """(pos, item) of a list document, or of the list an object has under a name."""
    own = (F.col("kind") == "record") | (F.col("kind") == "list") & (F.col("column") == name)
    return items.where(own).select(F.col("place").alias("pos"), _one(F.col("text"), T.StringType()).alias("item"))


def tidy_uid_list(rows: DataFrame) -> DataFrame:
    """Distinct trimmed uids with their first position."""
    return rows.select(K.trimmed_key(F.col("uid")).alias("uid"), "pos").filter(F.col("uid").isNotNull()).groupBy("uid").agg(
        F.min("pos").alias("pos")
    )


def read_uid_list(spark: SparkSession, path: str, strict: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Distinct uids of a text file (one per line) or JSON document, with their first position."""
    if path.endswith(".json"):
        items, _ = _usable(spark, path, "uids", strict, range_bytes)
        rows = _listed(items, "uids").select("pos", F.col("item").alias("uid"))
    else:
        rows = read_lines(spark, path).select(F.col("line_no").alias("pos"), F.col("line").alias("uid"))
    return tidy_uid_list(rows.withColumn("pos", F.col("pos").cast("bigint")))


def read_samples(
    spark: SparkSession, path: str, paths: DataFrame | None = None, strict: bool = False, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """uid, category and image path of sample lists; a path inside the list wins over the map.

    With strict a broken document or a sample without a path fails the job.
    """
    items, _ = _usable(spark, path, "samples", strict, range_bytes)
    rows = _listed(items, "samples")
    record = F.from_json("item", "uid string, category string, image_path string")
    nested = F.col("item").startswith("{")
    rows = rows.withColumn("r", F.when(nested, record)).select(
        "pos",
        K.trimmed_key(F.when(nested, F.col("r.uid")).otherwise(F.col("item"))).alias("uid"),
        F.col("r.category").alias("category"),
        F.col("r.image_path").alias("image_path"),
    )
    if paths is not None:
        known = K.one_per_key(paths.filter(F.col("path").isNotNull()), "uid", "path").withColumnRenamed("path", "__p")
        rows = rows.join(known, "uid", "left").withColumn("image_path", F.coalesce("image_path", "__p")).drop("__p")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no image path for sample "), F.coalesce("uid", F.lit("null"))))
        rows = rows.withColumn("image_path", F.coalesce("image_path", missing.cast("string")))
    return rows


def _whole_documents(files: DataFrame) -> DataFrame:
    """(file, doc): small documents, one per row."""
    return read_files(files).select(F.col("path").alias("file"), K.strip(F.col("content")).alias("doc"))


def _sidecar_reason() -> Column:
    return F.coalesce(F.when(F.try_parse_json("doc").isNull(), "json"), F.when(~F.col("doc").startswith("{"), "shape"))


def scan_sidecars(spark: SparkSession, root: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """Sidecar documents below a folder with their path; broken ones are left out, or fail the job when strict."""
    docs = _whole_documents(list_tree(spark, root, "*.json")).withColumn("reason", _sidecar_reason())
    usable = _strict(docs) if strict else docs.filter("reason IS NULL")
    return usable.select(F.col("file").alias("json_path"), F.from_json("doc", schema).alias("r")).select("json_path", "r.*")
