"""Queries that write derived tables in a file layout and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.operators import distribution as Q, latents as L, manifest as M
from pairloom.plans import derived as D
from pairloom.plans.registry import CTES, query, rounded
from pairloom.session import scratch_path
from pairloom.sources.file_lists import list_tree
from pairloom.sources import file_moves as FM, image_sizes as IS, json_docs as JD, keyed, payload_files as PF, sinks, tables, tensor_files as TF

# Documents hold at most this many entries, so one document is never a large group.
DOCUMENT = 256

POOL = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("user_id", "preferred_uid", "dispreferred_uid", "caption", "pair_key")]
    + [T.StructField("source_row_idx", T.LongType())]
)
_POOL_SQL = "SELECT user_id, preferred_uid, dispreferred_uid, caption, split || ':' || row_idx AS pair_key, row_idx AS source_row_idx FROM pool"


def _write_documents(docs: DataFrame, path: str) -> list[str]:
    """One document per `doc` number, each in a file of its own; returns the folders' glob."""
    rows = docs.select(F.col("doc").cast("string").alias("uid"), F.col("value").cast("binary").alias("payload"))
    PF.write_payloads(rows, path, "json", tasks=_tasks(docs))
    return [f"{path}/part-*/*/*"]


def _tasks(df: DataFrame) -> int:
    """Tasks that write files so small that Spark would give them to one."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


@query("s1_split_partitions", "SELECT split, count(*) AS n_rows, min(row_idx) AS first_row, max(row_idx) AS last_row FROM prefs GROUP BY ALL")
def s1_splits(spark, sf):
    path = scratch_path(spark, "prefs")
    sinks.publish_splits(D.derive(spark, sf, "prefs"), path)
    rows = tables.read_preferences(spark, path)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query("s1_one_split", "SELECT row_idx, user_id FROM prefs WHERE split = 'validation'")
def s1_one(spark, sf):
    path = scratch_path(spark, "prefs")
    sinks.publish_splits(D.derive(spark, sf, "prefs"), path)
    return tables.read_preferences(spark, path, split="validation").select("row_idx", "user_id")


@query(
    "s2_columnar_json",
    """SELECT vec_id, uid, len(vals) AS n_values, round(list_sum(CAST(vals AS DOUBLE[])), 4) AS total, 'same' AS note,
              row_number() OVER (PARTITION BY vec_id // 256 ORDER BY vec_id) - 1 AS row_idx FROM latents""",
)
def s2(spark, sf):
    path = scratch_path(spark, "columns")
    rows = D.derive(spark, sf, "latents").withColumn("doc", F.floor(F.col("vec_id") / DOCUMENT).cast("bigint"))
    column = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("vec_id").cast("string"), c))).alias(c)
    docs = rows.groupBy("doc").agg(column("vec_id"), column("uid"), column("vals")).withColumn("note", F.lit("same"))
    globs = _write_documents(docs.select("doc", F.to_json(F.struct("uid", "vec_id", "note", "vals")).alias("value")), path)
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("uid", T.StringType()),
            T.StructField("note", T.StringType()),
            T.StructField("vals", T.ArrayType(T.FloatType())),
        ]
    )
    read = JD.read_columnar_json(spark, globs, schema)
    return read.select("vec_id", "uid", F.size("vals").alias("n_values"), F.round(X.total(F.col("vals")), 4).alias("total"), "note", "row_idx")


@query("s4_jsonl_scan", _POOL_SQL)
def s4(spark, sf):
    path = scratch_path(spark, "pool")
    sinks.write_jsonl(D.pool(spark, sf), path)
    return JD.read_jsonl(spark, path, POOL).drop("file", "line_no")


@query(
    "s4_bad_lines",
    """SELECT CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'shape' ELSE 'ok' END AS kind, count(*) AS n_lines
       FROM events WHERE event_id % 5 <> 2 GROUP BY ALL""",
)
def s4_bad(spark, sf):
    path = scratch_path(spark, "lines")
    n = F.col("event_id")
    good = F.to_json(F.struct(n.cast("string").alias("user_id"), F.col("event_type").alias("caption")))
    line = (
        F.when(n % 5 == 0, F.concat(F.lit("{"), F.col("event_type")))
        .when(n % 5 == 1, F.concat(F.lit("["), n.cast("string"), F.lit("]")))
        .when(n % 5 == 2, "   ")
        .otherwise(good)
    )
    D.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    marked = JD.parse_lines(JD.read_lines(spark, path), POOL)
    return marked.groupBy(F.coalesce("bad_line", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("s5_user_grouped_json", _POOL_SQL)
def s5(spark, sf):
    path = scratch_path(spark, "by-user")
    rows = D.pool(spark, sf).withColumn("doc", F.floor(F.col("row_idx") / DOCUMENT).cast("bigint"))
    # The user id is left out of every other record, where the key stands in for it.
    own = F.when(F.col("row_idx") % 2 == 0, F.col("user_id")).alias("user_id")
    record = F.struct(own, "preferred_uid", "dispreferred_uid", "caption", "pair_key", "source_row_idx")
    # Dealt out by document once: nearly every row is a list of its own, so nothing is gained by listing them before.
    lists = rows.repartition("doc").groupBy("doc", "user_id").agg(F.collect_list(record).alias("records"))
    docs = lists.groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("user_id", "records")))).alias("value"))
    return JD.read_user_grouped_json(spark, _write_documents(docs, path), POOL).drop("file", "pos")


@query("s6_mapping_json", "SELECT uid, path FROM known_paths")
def s6(spark, sf):
    path = scratch_path(spark, "map")
    rows = D.derive(spark, sf, "paths").withColumn("doc", F.floor(F.substring("uid", 5, 10).cast("bigint") / DOCUMENT))
    entry = F.concat(F.to_json(F.struct(F.col("uid").alias("k"))), F.lit(""))
    # Null values are written out by hand, as the document writer would leave them out.
    cell = F.concat(F.regexp_extract(entry, r'^\{"k":(.*)\}$', 1), F.lit(":"), F.coalesce(F.concat(F.lit('"'), "path", F.lit('"')), F.lit("null")))
    docs = rows.groupBy("doc").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(cell), ","), F.lit("}")).alias("value"))
    return JD.read_mapping_json(spark, _write_documents(docs, path))


@query("s7_uid_list", "SELECT DISTINCT uid FROM sightings")
def s7(spark, sf):
    path = scratch_path(spark, "uids")
    cells = M.sightings(D.derive(spark, sf, "prefs"))
    padded = F.when(F.col("side") == 0, F.concat(F.lit(" "), "uid")).otherwise(F.col("uid"))
    cells.select(F.explode(F.array(padded, F.lit(" "))).alias("value")).write.text(path)
    return JD.read_uid_list(spark, path).select("uid")


@query(
    "s8_sample_list",
    """SELECT l.uid, CASE WHEN vec_id % 3 > 0 THEN 'kind' || vec_id % 4 END AS category,
              CASE WHEN vec_id % 3 = 2 THEN 'own/' || vec_id ELSE k.path END AS image_path FROM latents l LEFT JOIN known_paths k USING (uid)""",
)
def s8(spark, sf):
    path = scratch_path(spark, "samples")
    n = F.col("vec_id")
    text = F.concat(F.lit('"'), "uid", F.lit('"'))
    record = F.to_json(
        F.struct(
            "uid",
            F.concat(F.lit("kind"), (n % 4).cast("string")).alias("category"),
            F.when(n % 3 == 2, F.concat(F.lit("own/"), n.cast("string"))).alias("image_path"),
        )
    )
    rows = D.derive(spark, sf, "latents").select(F.floor(n / DOCUMENT).alias("doc"), F.when(n % 3 == 0, text).otherwise(record).alias("item"))
    items = F.array_join(F.collect_list("item"), ",")
    wrapped = F.when(F.col("doc") % 2 == 0, F.concat(F.lit('{"samples":['), items, F.lit("]}"))).otherwise(F.concat(F.lit("["), items, F.lit("]")))
    docs = rows.groupBy("doc").agg(wrapped.alias("value"))
    known = D.derive(spark, sf, "paths").filter(F.col("path").isNotNull())
    return JD.read_samples(spark, _write_documents(docs, path), known).select("uid", "category", "image_path")


@query("s10_latent_scan", "SELECT uid, round(list_sum(CAST(vals AS DOUBLE[])), 6) AS total FROM latents")
def s10(spark, sf):
    path = scratch_path(spark, "latents")
    sinks.write_sharded(D.latents(spark, sf), path)
    rows = tables.scan_latents(spark, path)
    return rows.select("uid", F.round(X.total(F.col("vals")), 6).alias("total"))


def _container_files(spark, sf, path):
    """A container for each latent, in turn of the three storage types, with values that all of them hold; each seventh is cut off."""
    n = F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, ("FloatStorage", "HalfStorage", "BFloat16Storage"))), (n % 3 + 1).cast("int"))
    rows = D.latents(spark, sf).withColumn("vals", F.transform("vals", lambda v: F.floor(v * 8) / 8))
    made = TF.with_containers(rows, ["uid", "scaled", "latent_semantics"], storage_type=kind)
    payload = F.when(n % 7 == 0, F.substring("payload", 1, 300)).otherwise(F.col("payload"))
    PF.write_payloads(made.select(F.md5("uid").alias("uid"), payload.alias("payload")), path, "pt")
    return TF.tensor_files(spark, path, bundle=TF.BUNDLE_KEYS)


CTES["containers"] = """
    SELECT vec_id, uid, ch, ht, wd, scaled, latent_semantics, list_transform(CAST(vals AS DOUBLE[]), lambda v: floor(v * 8) / 8) AS vals,
           CASE vec_id % 3 WHEN 0 THEN 'float32' WHEN 1 THEN 'float16' ELSE 'bfloat16' END AS dtype FROM latents"""


@query(
    "s10_tensor_files",
    """SELECT md5(uid) || '.pt' AS name, CASE WHEN vec_id % 7 > 0 THEN 'latent' END AS key, CASE WHEN vec_id % 7 > 0 THEN dtype END AS dtype,
              CASE WHEN vec_id % 7 > 0 THEN len(vals) END AS n_values, CASE WHEN vec_id % 7 > 0 THEN round(list_sum(vals), 4) END AS total,
              CASE WHEN vec_id % 7 = 0 THEN 'broken' END AS reason FROM containers""",
)
def s10_files(spark, sf):
    rows = _container_files(spark, sf, scratch_path(spark, "containers"))
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("name")
    size = F.when(F.col("vals").isNotNull(), F.size("vals")).alias("n_values")
    return rows.select(name, "key", "dtype", size, F.round(X.total(F.col("vals")), 4).alias("total"), "reason")


@query(
    "s10_container_manifest",
    """SELECT uid, ch || 'x' || ht || 'x' || wd AS shape, dtype, scaled, latent_semantics, list_min(vals) AS min, list_max(vals) AS max,
              round(list_avg(vals), 6) AS mean FROM containers WHERE vec_id % 7 > 0""",
)
def s10_manifest(spark, sf):
    rows = _container_files(spark, sf, scratch_path(spark, "containers"))
    manifest = L.build_manifest(TF.container_latents(rows, "uid string, scaled string, latent_semantics string"))
    shape = F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape")
    return manifest.select("uid", shape, "dtype", "scaled", "latent_semantics", "min", "max", *rounded("mean"))


@query("k2_uid_map", "SELECT uid, path FROM known_paths")
def k2(spark, sf):
    path = scratch_path(spark, "uid-map")
    sinks.write_uid_map(D.derive(spark, sf, "paths").filter(F.col("path").isNotNull()), path)
    return spark.read.parquet(path)


@query("k2_uid_map_json", "SELECT uid, path FROM known_paths")
def k2_json(spark, sf):
    path = scratch_path(spark, "uid-map")
    sinks.export_uid_map(D.derive(spark, sf, "paths").filter(F.col("path").isNotNull()), path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("uid", "path"))


@query(
    "k8_write_missing",
    """SELECT count(*) AS num_seen, count(DISTINCT uid) FILTER (NOT there) AS num_written,
              count(*) - count(DISTINCT uid) FILTER (NOT there) AS num_skipped
       FROM (SELECT uid, uid IN (SELECT uid FROM latents WHERE NOT scaled) AS there FROM sightings)""",
)
def k8_write(spark, sf):
    path = scratch_path(spark, "present")
    sinks.write_missing(D.latents(spark, sf).filter(~F.col("scaled")).select("uid"), path, ["uid"])
    return sinks.write_missing(M.sightings(D.derive(spark, sf, "prefs")).select("uid"), path, ["uid"])


@query("s9_image_scan", "SELECT split, row_idx // 500 AS part, count(*) AS n_rows FROM prefs GROUP BY ALL")
def s9(spark, sf):
    path = scratch_path(spark, "images")
    rows = D.derive(spark, sf, "prefs").select("split", F.floor(F.col("row_idx") / 500).cast("bigint").alias("part"), F.col("row_idx").cast("string").alias("row"))
    # A file for each part of a split, with a line for each of its 500 rows at most.
    parts = rows.groupBy("split", "part").agg(F.array_join(F.collect_list("row"), "\n").cast("binary").alias("payload"))
    PF.write_payloads(parts.withColumn("uid", F.concat_ws("-", "split", "part")), path, "jpg", tasks=_tasks(parts))
    listed = tables.scan_images(spark, path).select(F.split_part("uid", F.lit("-"), F.lit(1)).alias("split"), F.split_part("uid", F.lit("-"), F.lit(2)).cast("bigint").alias("part"), "path")
    # What the folder lists against what the files hold.
    held = PF.read_payloads(spark, path).select("path", F.size(F.split(F.col("payload").cast("string"), "\n")).cast("bigint").alias("n_rows"))
    return listed.join(held, "path", "full").select("split", "part", "n_rows")


@query("s12_shard_list", "SELECT split, row_number() OVER (ORDER BY split) - 1 AS place FROM prefs GROUP BY split")
def s12(spark, sf):
    path = scratch_path(spark, "shards")
    sinks.publish_splits(D.derive(spark, sf, "prefs"), path)
    names = tables.expand_shards(spark, [f"{path}/split=t*", f"{path}/split=*"])
    listed = spark.createDataFrame([(name.rpartition("=")[2], place) for place, name in enumerate(names)], "split string, place bigint")
    return listed.join(tables.read_preferences(spark, path).select("split").distinct(), "split")


# A document for every fifty events: every fourth is whole, cut off, of another layout, or an object without the list.
_BROKEN_SQL = """
    SELECT reason, count(*) AS n_documents FROM (
        SELECT DISTINCT event_id // 50 AS doc,
               CASE (event_id // 50) % 4 WHEN 1 THEN 'json' WHEN 2 THEN 'shape' WHEN 3 THEN '{lacks}' ELSE 'ok' END AS reason
        FROM events) GROUP BY ALL"""


def _broken_documents(spark, sf):
    events = D.table(spark, sf, "events").select(F.floor(F.col("event_id") / 50).alias("doc"), F.col("event_id").cast("string").alias("id"))
    whole = events.groupBy("doc").agg(F.to_json(F.struct(F.collect_list("id").alias("uids"), F.collect_list("id").alias("samples"))).alias("whole"))
    value = (
        F.when(F.col("doc") % 4 == 1, F.substring("whole", 1, F.length("whole") - 2))
        .when(F.col("doc") % 4 == 2, F.lit('"text"'))
        .when(F.col("doc") % 4 == 3, F.lit('{"other": ["a"]}'))
        .otherwise(F.col("whole"))
    )
    return _write_documents(whole.select("doc", value.alias("value")), scratch_path(spark, "broken"))


def _bad_documents(name: str, kind: str, lacks: str) -> None:
    @query(f"{name}_bad_documents", _BROKEN_SQL.format(lacks=lacks))
    def bad(spark, sf):
        reasons = JD.document_reasons(spark, _broken_documents(spark, sf), kind)
        return reasons.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n_documents"))


for _name, _kind, _lacks in (
    ("s2", "columnar", "ok"), ("s5", "grouped", "ok"), ("s6", "mapping", "ok"), ("s7", "uids", "no_uids"), ("s8", "samples", "no_samples"), ("s11", "sidecar", "ok"),
):
    _bad_documents(_name, _kind, _lacks)


@query("s11_sidecars", "SELECT event_id // 50 AS number, count(*) AS n_events FROM events GROUP BY ALL")
def s11(spark, sf):
    path = scratch_path(spark, "sidecars")
    rows = D.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("number")).agg(F.count(F.lit(1)).alias("n_events"))
    _write_documents(rows.select(F.col("number").alias("doc"), F.to_json(F.struct("number", "n_events")).alias("value")), path)
    return JD.scan_sidecars(spark, path, "number bigint, n_events bigint").select("number", "n_events")


@query("k4_uid_list", "SELECT DISTINCT uid, dense_rank() OVER (ORDER BY uid) - 1 AS place FROM sightings")
def k4(spark, sf):
    from pairloom.operators.ranking import position_by_sort

    path = scratch_path(spark, "uid-list")
    uids = M.sightings(D.derive(spark, sf, "prefs")).select("uid").distinct()
    sinks.write_uid_list(uids, path, sort_by_uid=True)
    lines = JD.read_lines(spark, path).filter(F.col("line") != "")
    # Part files follow each other in name order.
    placed = position_by_sort(lines, [F.col("file"), F.col("line_no")], "place")
    return placed.select(F.col("line").alias("uid"), "place")


@query(
    "k5_sample_csv",
    """SELECT uid, 'stored' AS "group", '4x4x4' AS shape, count(*) FILTER (isnan(v)) AS nan_count,
              round(avg(v) FILTER (isfinite(v)), 5) AS "mean" FROM tensors GROUP BY ALL""",
)
def k5(spark, sf):
    path = scratch_path(spark, "csv")
    rows = Q.with_full_stats(D.bad_tensors(spark, sf).select("uid", "vals", "shape")).withColumn("group", F.lit("stored"))
    sinks.write_sample_csv(rows, path)
    kinds = {"nan_count": "bigint", "mean": "double"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in C.SAMPLE_CSV_COLUMNS)
    back = spark.read.option("header", "true").schema(schema).csv(path)
    return back.select("uid", "group", "shape", "nan_count", *rounded("mean", digits=5))


@query("k9_split_publish", "SELECT split, score, count(*) AS n_rows FROM scored GROUP BY ALL")
def k9(spark, sf):
    from pairloom.plans.tensors import _scored

    path = scratch_path(spark, "splits")
    sinks.publish_splits(_scored(spark, sf), path)
    return spark.read.parquet(path).groupBy("split", "score").agg(F.count(F.lit(1)).alias("n_rows"))


@query("k10_metric_log", "SELECT micro_step, round(loss, 6) AS loss FROM steps")
def k10(spark, sf):
    path = scratch_path(spark, "log")
    log = D.derive(spark, sf, "steps").select("micro_step", "loss", "is_validation")
    for part in (log.filter(~F.col("is_validation")), log.filter("is_validation")):
        sinks.append_metrics(part, path)
    return spark.read.schema("micro_step bigint, loss double").json(path).select("micro_step", *rounded("loss"))


CTES["cell_forms"] = """
    SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN caption END AS payload, CASE WHEN row_idx % 3 = 0 THEN user_id END AS source_path FROM prefs"""


@query("p20_image_cells", "SELECT row_idx, payload, source_path, payload AS bare, source_path AS text_path, payload AS listed FROM cell_forms")
def p20(spark, sf):
    n = F.col("row_idx")
    payload = F.when(n % 2 == 0, F.col("caption").cast("binary"))
    path = F.when(n % 3 == 0, F.col("user_id"))
    rows = D.derive(spark, sf, "prefs").select(
        "row_idx", F.struct(payload.alias("bytes"), path.alias("path")).alias("both"), payload.alias("bare"), path.alias("text"), F.array(payload).alias("listed")
    )
    both = M.image_cell(rows, "both")
    return rows.select(
        "row_idx",
        both[0].cast("string").alias("payload"),
        both[1].alias("source_path"),
        M.image_cell(rows, "bare")[0].cast("string").alias("bare"),
        M.image_cell(rows, "text")[1].alias("text_path"),
        M.image_cell(rows, "listed")[0].cast("string").alias("listed"),
    )


def _vector_files(spark, sf, path, extension="bin"):
    """One small file for each vector, named by a digest of its number; returns what is found there."""
    rows = D.table(spark, sf, "embeddings").select(F.md5(F.col("vec_id").cast("string")).alias("uid"), F.col("vec_id").cast("string").cast("binary").alias("payload"))
    PF.write_payloads(rows, path, extension, tasks=_tasks(rows))
    return list_tree(spark, path)


@query(
    "k6_move_files",
    """SELECT substr(md5(vec_id::VARCHAR), 1, 2) AS folder, md5(vec_id::VARCHAR) || '.bin' AS name, vec_id::VARCHAR AS payload, 'moved' AS status
       FROM embeddings""",
)
def k6_move(spark, sf):
    path = scratch_path(spark, "flat")
    journal = scratch_path(spark, "journal")
    FM.plan_moves(_vector_files(spark, sf, f"{path}/from"), f"file://{path}/to" if path.startswith("/") else f"{path}/to", journal)
    moved = FM.move_files(spark, journal).select(F.regexp_extract("target", "([^/]*)$", 1).alias("name"), "status")
    there = PF.read_payloads(spark, f"{path}/to").withColumn("payload", F.col("payload").cast("string")).drop("path")
    return there.join(moved, "name").select("folder", "name", "payload", "status")


@query(
    "j14_rewrite_sidecars",
    """SELECT md5(vec_id::VARCHAR) AS uid, CASE WHEN vec_id % 3 = 0 THEN 'own' ELSE 'old' END AS latent,
              CASE WHEN vec_id % 3 = 0 THEN 'updated' ELSE 'missing_pt' END AS status FROM embeddings""",
)
def j14_rewrite(spark, sf):
    path, journal = scratch_path(spark, "sidecars"), scratch_path(spark, "journal")
    ids = D.table(spark, sf, "embeddings").select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("uid"))
    document = F.to_json(F.struct("uid", F.lit("old").alias("latent_path"))).cast("binary")
    PF.write_payloads(ids.select("uid", document.alias("payload")), path, "json", tasks=_tasks(ids))
    # Every third latent is there, beside its sidecar.
    stored = list_tree(spark, path).select("path")
    own = ids.where("vec_id % 3 = 0").select("uid")
    beside = stored.join(own, F.regexp_extract("path", r"([^/]*)\.json$", 1) == F.col("uid"), "left_semi")
    latents = beside.select(F.regexp_replace("path", r"\.json$", ".pt").alias("path"))
    statuses = L.reconcile_sidecars(JD.scan_sidecars(spark, path, "uid string, latent_path string").select("json_path", "latent_path"), latents)
    done = FM.rewrite_sidecars(statuses, journal).select("json_path", "status")
    now = JD.scan_sidecars(spark, path, "uid string, latent_path string")
    pt = F.regexp_replace("json_path", r"\.json$", ".pt")
    latent = F.when(F.col("latent_path") == pt, "own").otherwise(F.col("latent_path"))
    return now.join(done, "json_path").select("uid", latent.alias("latent"), "status")


@query(
    "k7_payload_files",
    """SELECT substr(uid, 1, 2) AS folder, uid || '.jpg' AS name, payload FROM (
           SELECT uid, arg_min(concat(caption, CAST(row_idx AS STRING)), (split_rank, row_idx, side)) AS payload
           FROM sightings WHERE side = 0 AND row_idx % 3 > 0 GROUP BY uid)""",
)
def k7_files(spark, sf):
    from pairloom.plans.pairs import _image_cells

    path = scratch_path(spark, "payloads")
    images = M.materialise_images(_image_cells(spark, sf))
    PF.write_payloads(images, path, "jpg", tasks=_tasks(images))
    return PF.read_payloads(spark, path).select("folder", "name", F.col("payload").cast("string").alias("payload"))


@query(
    "k8_keyed_writes",
    """SELECT uid, min(event)::BIGINT AS first_event FROM (
           SELECT uid, 1 AS event FROM sightings WHERE row_idx % 3 = 0 UNION ALL SELECT uid, 2 FROM sightings) GROUP BY uid""",
)
def k8_keyed(spark, sf):
    path = scratch_path(spark, "keyed")
    seen = M.sightings(D.derive(spark, sf, "prefs")).select("uid", "row_idx")
    some = seen.where("row_idx % 3 = 0").select("uid", F.lit(1).cast("bigint").alias("first_event"))
    # The second run of the first write adds nothing, the next write only what is new.
    for write, rows in (("a", some), ("a", some), ("b", seen.select("uid", F.lit(2).cast("bigint").alias("first_event")))):
        keyed.write_new(rows, path, ["uid"], write)
    return keyed.read_keyed(spark, path).drop("bucket")


@query(
    "p28_sizes_from_files",
    """SELECT md5(vec_id::VARCHAR) || '.img' AS name, CASE vec_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'png' END AS format,
              CASE WHEN vec_id % 5 < 3 THEN 64 + vec_id % 1000 END AS width, CASE WHEN vec_id % 5 < 3 THEN 48 + vec_id % 701 END AS height,
              CASE vec_id % 5 WHEN 3 THEN 'cut' WHEN 4 THEN 'format' END AS reason,
              CASE WHEN vec_id % 5 < 3 THEN ceil((48 + vec_id % 701) / 42.67)::BIGINT END AS latent_height,
              CASE WHEN vec_id % 5 < 3 THEN ceil((64 + vec_id % 1000) / 42.67)::BIGINT END AS latent_width
       FROM embeddings""",
)
def p28_files(spark, sf):
    path = scratch_path(spark, "images")
    n = F.col("vec_id")
    big = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    # Little-endian in three bytes.
    little = lambda c: F.concat(*[big(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)), 2) for k in range(3)])
    rows = D.table(spark, sf, "embeddings").select("vec_id", (64 + n % 1000).alias("w"), (48 + n % 701).alias("h"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(F.col("w"), 8), big(F.col("h"), 8))
    # A segment of any length stands before the frame.
    filler = F.concat(F.lit("FFE1"), big(2 + n % 3000, 4), F.repeat(F.lit("C0"), (n % 3000).cast("int")))
    jpeg = F.concat(F.lit("FFD8"), filler, F.lit("FFC2001108"), big(F.col("h"), 4), big(F.col("w"), 4), F.lit("03"))
    webp = F.concat(F.lit("52494646000000005745425056503858" + "0A00000010000000"), little(F.col("w") - 1), little(F.col("h") - 1))
    text = F.when(n % 5 == 0, png).when(n % 5 == 1, jpeg).when(n % 5 == 2, webp).when(n % 5 == 3, F.substring(png, 1, 40)).otherwise(F.lit("474946383961") )
    PF.write_payloads(rows.select(F.md5(n.cast("string")).alias("uid"), F.unhex(text).alias("payload")), path, "img")
    sizes = IS.expected_latents(IS.image_sizes(spark, path), 42.67)
    return sizes.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "format", "width", "height", "reason", "latent_height", "latent_width")
