"""File layouts: readers and writers on small hand-written files."""

import json
import os
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from pairloom import session
from pairloom.operators import latents as L, manifest as M
from pairloom.sources import file_lists as FL, file_moves as FM, image_sizes as IS, json_docs as JD, json_items as JI, keyed, payload_files as PF, sinks, tables

EMB = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("emb", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("caption_0", T.StringType()),
    ]
)
POOL = T.StructType([T.StructField(c, T.StringType()) for c in ("user_id", "preferred_uid", "caption")])


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def records(df):
    return [tuple(r) for r in df.orderBy("row_idx").select("row_key", "user_id", "text", "emb", "caption_0").collect()]


def test_columnar_map_layout_orders_digits_first_and_fills_holes(spark, tmp_path):
    doc = {
        "user_id": {"10": "u10", "9": "u9", "x": "ux"},
        "text": "same for all",
        "emb": {"9": [[1, 2]], "10": [[3, 4], [5, 6]]},
        "caption_0": {"x": "cx", "9": None},
    }
    got = records(JD.read_columnar_json(spark, write(tmp_path / "a.json", json.dumps(doc)), EMB))
    assert got == [
        ("9", "u9", "same for all", [[1.0, 2.0]], None),
        ("10", "u10", "same for all", [[3.0, 4.0], [5.0, 6.0]], None),
        ("x", "ux", "same for all", None, "cx"),
    ]


def test_columnar_list_layout(spark, tmp_path):
    doc = {"user_id": ["a", "b"], "text": ["t0"], "emb": [[[1.0]], [[2.0]]], "caption_0": "c"}
    got = records(JD.read_columnar_json(spark, write(tmp_path / "a.json", json.dumps(doc)), EMB))
    assert got == [("0", "a", "t0", [[1.0]], "c"), ("1", "b", None, [[2.0]], "c")]


def test_record_list_and_single_object(spark, tmp_path):
    listed = [{"user_id": "a", "emb": [[1.0]]}, {"user_id": "b", "caption_0": "c"}]
    got = records(JD.read_columnar_json(spark, write(tmp_path / "a.json", json.dumps(listed)), EMB))
    assert got == [("0", "a", None, [[1.0]], None), ("1", "b", None, None, "c")]
    single = {"user_id": "a", "text": "t", "caption_0": "c"}
    got = records(JD.read_columnar_json(spark, write(tmp_path / "b.json", json.dumps(single)), EMB))
    assert got == [("0", "a", "t", None, "c")]


def test_columnar_empty_columns_give_no_rows(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps({"user_id": {}, "text": {}}))
    assert JD.read_columnar_json(spark, path, EMB).count() == 0


LINES = '{"user_id": "a", "preferred_uid": "p"}\n\n   \nnot json\n[1, 2]\n"text"\n{"user_id": "b", "caption": "c"}\n{"user_id": \n'


def test_jsonl_counts_and_drops_bad_lines(spark, tmp_path, rows):
    path = write(tmp_path / "a.jsonl", LINES)
    marked = JD.parse_lines(JD.read_lines(spark, path), POOL)
    assert rows(marked, "line_no", "bad_line") == [
        (0, None), (3, "json"), (4, "shape"), (5, "shape"), (6, None), (7, "json"),
    ]
    assert rows(JD.read_jsonl(spark, path, POOL), "line_no", "user_id", "caption") == [(0, "a", None), (6, "b", "c")]


def test_jsonl_strict_fails(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", LINES)
    with pytest.raises(PySparkException, match="bad line"):
        JD.read_jsonl(spark, path, POOL, strict=True).collect()


def test_line_numbers_over_many_blocks(spark, tmp_path, rows):
    write(tmp_path / "a.txt", "".join(f"{i}\n" for i in range(5000)))
    write(tmp_path / "b.txt", "".join(f"{i}\n" for i in range(700)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 2
        lines = JD.read_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        assert lines.filter(F.col("line_no") != F.col("line").cast("bigint")).count() == 0
        assert lines.count() == 5700
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_user_grouped_document(spark, tmp_path, rows):
    doc = {"u1": [{"preferred_uid": "p"}, {"user_id": "own", "preferred_uid": "q"}], "u2": []}
    got = JD.read_user_grouped_json(spark, write(tmp_path / "a.json", json.dumps(doc)), POOL)
    assert rows(got, "user_id", "preferred_uid") == [("own", "q"), ("u1", "p")]


def test_mapping_document_drops_null_values(spark, tmp_path, rows):
    path = write(tmp_path / "a.json", json.dumps({"a": "x", "b": None, " 7 ": 3}))
    assert rows(JD.read_mapping_json(spark, path)) == [("7", "3"), ("a", "x")]


def test_uid_lists(spark, tmp_path, rows):
    text = write(tmp_path / "a.txt", "b\n\n a \nb\n")
    assert rows(JD.read_uid_list(spark, text), "pos", "uid") == [(0, "b"), (2, "a")]
    for doc in ({"uids": ["b", " a", "b", ""], "num_uids": 4}, ["b", " a", "b", ""]):
        path = write(tmp_path / "a.json", json.dumps(doc))
        assert rows(JD.read_uid_list(spark, path), "pos", "uid") == [(0, "b"), (1, "a")]


def test_sample_lists(spark, tmp_path, rows):
    items = ["a", {"uid": "b", "category": "cat"}, {"uid": "c", "image_path": "own.jpg"}, 5]
    known = spark.createDataFrame([("a", "a.jpg"), ("c", "c.jpg")], "uid string, path string")
    for doc in ({"samples": items}, items):
        path = write(tmp_path / "s.json", json.dumps(doc))
        got = JD.read_samples(spark, path, known)
        assert rows(got, "pos", "uid", "category", "image_path") == [
            (0, "a", None, "a.jpg"), (1, "b", "cat", None), (2, "c", None, "own.jpg"), (3, "5", None, None),
        ]


def test_image_and_sidecar_scans(spark, tmp_path, rows):
    root = tmp_path / "images"
    (root / "ab").mkdir(parents=True)
    (root / "ab" / "ab.c.JPG").write_bytes(b"123")
    (root / "x.png").write_bytes(b"1")
    (root / "note.txt").write_bytes(b"1")
    assert rows(tables.scan_images(spark, str(root)), "uid", "length") == [("ab.c", 3), ("x", 1)]
    (root / "ab" / "u1.json").write_text(json.dumps({"uid": "u1", "latent_path": "old"}, indent=2))
    got = JD.scan_sidecars(spark, str(root), "uid string, latent_path string")
    assert rows(got.select(F.regexp_extract("json_path", r"([^/]*)$", 1), "uid", "latent_path")) == [("u1.json", "u1", "old")]


def test_sidecar_statuses(spark, rows):
    sidecars = spark.createDataFrame(
        [("r/ab/u1.json", "r/ab/u1.pt"), ("r/ab/u2.json", "old/u2.pt"), ("r/ab/u3.json", None), ("r/u1.json", "x")],
        "json_path string, latent_path string",
    )
    files = spark.createDataFrame([("r/ab/u1.pt",), ("r/ab/u2.pt",), ("r/ab/u3.pt",)], "path string")
    assert rows(L.reconcile_sidecars(sidecars, files), "json_path", "status") == [
        ("r/ab/u1.json", "unchanged"), ("r/ab/u2.json", "updated"), ("r/ab/u3.json", "updated"), ("r/u1.json", "missing_pt"),
    ]


def test_latent_scan(spark, tmp_path, rows):
    root = str(tmp_path / "latents")
    df = spark.createDataFrame([("u1", [1.0, 2.0], [2])], "uid string, vals array<float>, shape array<int>")
    sinks.write_sharded(df, root)
    assert rows(tables.scan_latents(spark, root), "uid", "vals") == [("u1", [1.0, 2.0])]
    with pytest.raises(PySparkException):
        tables.scan_latents(spark, root, recursive=False).collect()


def test_preferences_with_and_without_stored_numbers(spark, tmp_path, rows):
    path = str(tmp_path / "prefs")
    df = spark.range(0, 100, 1, 7).select(
        F.when(F.col("id") < 60, "train").otherwise("test").alias("split"), F.col("id").cast("string").alias("caption")
    )
    df.write.partitionBy("split").parquet(path)
    got = tables.read_preferences(spark, path)
    assert rows(got.groupBy("split").agg(F.min("row_idx"), F.max("row_idx"), F.count_distinct("row_idx"))) == [
        ("test", 0, 39, 40), ("train", 0, 59, 60),
    ]
    only = tables.read_preferences(spark, path, split="test")
    assert only.count() == 40 and "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().toString()


def test_expand_shards(spark, tmp_path):
    for n in (1, 2, 10):
        (tmp_path / f"train_shard{n}.json").write_text("{}")
    found = tables.expand_shards(spark, [f"{tmp_path}/train_shard*.json", f"{tmp_path}/train_shard2.json"])
    assert [f.rsplit("/", 1)[1] for f in found] == ["train_shard1.json", "train_shard2.json", "train_shard10.json"]
    with pytest.raises(FileNotFoundError):
        tables.expand_shards(spark, [f"{tmp_path}/none*.json"])


def test_image_cells(spark, rows):
    schema = "a binary, b string, c struct<bytes:binary,path:string>, d array<binary>"
    df = spark.createDataFrame([(b"A", "p.jpg", (b"C", "c.jpg"), [b"D"])], schema)
    cells = {c: M.image_cell(df, c) for c in ("a", "b", "c", "d", "none")}
    got = df.select(*[x.cast("string") for pair in cells.values() for x in pair]).first()
    assert tuple(got) == ("A", None, None, "p.jpg", "C", "c.jpg", "D", None, None, None)


def read_text(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_writers(spark, tmp_path, rows):
    df = spark.createDataFrame([("b", "2"), ("a", None)], "uid string, path string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "l"))
    assert [json.loads(x) for x in read_text(tmp_path / "l")] == [{"uid": "b", "path": "2"}, {"uid": "a", "path": None}]
    sinks.write_uid_map(df, str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == [("a", None), ("b", "2")]
    sinks.export_uid_map(df.filter("path is not null"), str(tmp_path / "d"))
    assert [json.loads(x) for x in read_text(tmp_path / "d")] == [{"b": "2"}]
    sinks.write_uid_list(df, str(tmp_path / "t"), sort_by_uid=True)
    assert read_text(tmp_path / "t") == ["a", "b"]
    sinks.export_uid_list(df, str(tmp_path / "j"))
    assert read_text(tmp_path / "j" / "items") == ["a", "b"]
    assert json.loads(read_text(tmp_path / "j" / "count")[0]) == {"num_uids": 2}
    sinks.write_summary(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "s"), seed=3, strict=True)
    assert json.loads(read_text(tmp_path / "s")[0]) == {"n": 2, "seed": 3, "strict": True}


def test_csv_writers(spark, tmp_path):
    stats = spark.createDataFrame([("g", "u", [1, 4, 4], 0.5)], "group string, uid string, shape array<int>, mean double")
    sinks.write_sample_csv(stats.coalesce(1), str(tmp_path / "c"))
    head, row = read_text(tmp_path / "c")
    assert head.split(",")[:6] == ["group", "uid", "category", "prompt", "seed", "shape"] and len(head.split(",")) == 22
    assert row.split(",")[:6] == ["g", "u", "", "", "", "1x4x4"]
    bins = spark.createDataFrame([(0.5, 1.0, 1, 2), (0.0, 0.5, 3, 4)], "bin_left double, bin_right double, prior_count long, precomputed_count long")
    sinks.write_histogram_csv(bins, str(tmp_path / "h"))
    assert read_text(tmp_path / "h")[0] == "bin_left,bin_right,prior_count,precomputed_count"
    assert read_text(tmp_path / "h")[1] == "0.0,0.5,3,4"


def test_sharded_missing_split_and_append_writers(spark, tmp_path, rows):
    df = spark.createDataFrame([("abc", 1), ("b", 2), ("a/c", 3)], "uid string, n int")
    sinks.write_sharded(df, str(tmp_path / "s"), files_per_shard=2)
    assert rows(spark.read.parquet(str(tmp_path / "s")), "uid", "shard") == [("a/c", "a_"), ("abc", "ab"), ("b", "xx")]
    target = str(tmp_path / "t")
    first = spark.createDataFrame([("abc", 1), ("b", 2), ("abc", 1)], "uid string, n int")
    assert rows(sinks.write_missing(first, target, ["uid"])) == [(3, 2, 1)]
    assert rows(sinks.write_missing(df.withColumn("n", F.col("n") + 10), target, ["uid"])) == [(3, 1, 2)]
    assert rows(spark.read.parquet(target)) == [("a/c", 13), ("abc", 1), ("b", 2)]
    sinks.write_missing(df, target, ["uid"], overwrite=True)
    assert rows(spark.read.parquet(target)) == [("a/c", 3), ("abc", 1), ("b", 2)]
    sinks.publish_splits(df.withColumn("split", F.lit("test")), str(tmp_path / "p"))
    assert (tmp_path / "p" / "split=test").is_dir()
    for n in (1, 2):
        sinks.append_metrics(spark.createDataFrame([(n, 0.5)], "micro_step long, loss double"), str(tmp_path / "m"))
    assert rows(spark.read.json(str(tmp_path / "m")), "micro_step") == [(1,), (2,)]


def test_broken_documents_have_a_reason_and_strict_fails(spark, tmp_path, rows):
    schema = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("n", T.LongType())])
    texts = {"good": '{"uids": ["a"], "samples": ["a"], "u": []}', "cut": '{"uids": ["a", ', "text": '"x"', "none": '{"no_uids": ["a"]}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    reasons = lambda kind: {
        os.path.basename(f): r for f, r in rows(JD.document_reasons(spark, str(tmp_path), kind))
    }
    assert reasons("uids") == {"good.json": None, "cut.json": "json", "text.json": "shape", "none.json": "no_uids"}
    assert reasons("samples")["none.json"] == "no_samples" and reasons("mapping")["none.json"] is None
    cut = str(tmp_path / "cut.json")
    assert JD.read_columnar_json(spark, cut, schema).count() == 0
    for read in (
        lambda: JD.read_columnar_json(spark, cut, schema, strict=True),
        lambda: JD.read_user_grouped_json(spark, cut, schema, strict=True),
        lambda: JD.read_mapping_json(spark, cut, strict=True),
        lambda: JD.read_uid_list(spark, str(tmp_path / "none.json"), strict=True),
        lambda: JD.read_samples(spark, str(tmp_path / "none.json"), strict=True),
        lambda: JD.scan_sidecars(spark, str(tmp_path), schema, strict=True),
    ):
        with pytest.raises(PySparkException, match="unusable document|Multiple failures"):
            read().collect()
    with pytest.raises(PySparkException, match="no image path"):
        JD.read_samples(spark, str(tmp_path / "good.json"), strict=True).collect()


def test_rows_of_a_null_split_are_numbered(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "split string, n int")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    got = rows(tables.read_preferences(spark, str(tmp_path / "p")), "split", "n")
    assert got == [("a", 1), (None, 2), (None, 3)]


def test_scratch_tables_are_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    kept = session.materialise(spark.range(3))
    (path,) = session._MADE
    assert kept.count() == 3 and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.isdir(path) and session._MADE == []


ODD_DOCUMENTS = {
    "map": {"user_id": {"0": "a", "10": "b\\\"{[,:]}", "9": "é€", "x": None}, "emb": {"0": [[1.5, 2.0], [3.0]], "9": []}, "text": "same", "more": [1, {"a": [2]}]},
    "lists": {"user_id": ["a", "b", None], "text": ["\\", "\\\\\"", "]"], "caption_0": "c"},
    "records": [{"user_id": "a", "emb": [[1.0]]}, {"text": "{[\"", "user_id": None}, {}],
    "single": {"user_id": "a", "text": "t,:"},
    "empty": {}, "none": [],
}
BROKEN_DOCUMENTS = [
    '{"user_id": {"0": "a"}', '{"user_id": {"0": "a"]}', '{"user_id": {"0": "a",}}', '{"user_id": {"0" "a"}}', '[{"user_id": "a"},]', '[{"user_id": tru}]',
    '{"user_id": {"0": "a"}} x', '{"user_id": {"0": "a"} x}', '{"user_id": {"0": "a}', '[1, 2]]', '   ', '{"user_id" {"0": "a"}}', '[,]',
]


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_documents_in_ranges_of_any_size(spark, tmp_path, size):
    """The same rows wherever a range begins: in a string, an escape, a key, a number or a bracket."""
    for name, doc in ODD_DOCUMENTS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=size % 3 or None, ensure_ascii=size == 7), encoding="utf-8")
    for n, text in enumerate(BROKEN_DOCUMENTS):
        (tmp_path / f"bad{n}.json").write_text(text)
    reasons = {os.path.basename(r.file)[:-5]: r.reason for r in JD.document_reasons(spark, str(tmp_path), "columnar", size).collect()}
    assert reasons == {n: None for n in ODD_DOCUMENTS} | {f"bad{n}": "json" for n in range(len(BROKEN_DOCUMENTS))}
    got = {}
    for r in JD.read_columnar_json(spark, str(tmp_path), EMB, range_bytes=size).orderBy("file", "row_idx").collect():
        got.setdefault(os.path.basename(r.file)[:-5], []).append((r.row_key, r.user_id, r.text, r.emb, r.caption_0))
    assert got == {
        "map": [
            ("0", "a", "same", [[1.5, 2.0], [3.0]], None), ("9", "é€", "same", [], None), ("10", 'b\\"{[,:]}', "same", None, None),
            ("x", None, "same", None, None),
        ],
        "lists": [("0", "a", "\\", None, "c"), ("1", "b", '\\\\"', None, "c"), ("2", None, "]", None, "c")],
        "records": [("0", "a", None, [[1.0]], None), ("1", None, '{["', None, None), ("2", None, None, None, None)],
        "single": [("0", "a", "t,:", None, None)], "empty": [("0", None, None, None, None)],
    }


def test_one_document_spans_many_tasks(spark, tmp_path):
    """A document of eight ranges and more is read by as many tasks, none of which holds more than a range and a row."""
    count = 20_000
    doc = {"user_id": {str(i): f"u{i}" for i in range(count)}, "emb": {str(i): [[float(i), 0.5]] * 3 for i in range(count)}, "text": "t"}
    path = write(tmp_path / "large.json", json.dumps(doc))
    size = os.path.getsize(path) // 8
    parts = JI.ranges(spark, [path], size)
    assert parts.count() >= 8 and parts.rdd.getNumPartitions() >= 8
    rows = JD.read_columnar_json(spark, path, EMB, range_bytes=size)
    facts = rows.agg(
        F.count("user_id"), F.max("row_idx"), F.sum(F.col("emb")[0][0]), F.sum((F.col("row_idx").cast("string") == F.col("row_key")).cast("int")),
        F.countDistinct("user_id"), F.sum((F.concat(F.lit("u"), "row_key") == F.col("user_id")).cast("int")),
    ).first()
    assert tuple(facts) == (count, count - 1, count * (count - 1) / 2, count, count, count)


def test_payload_files_appear_with_the_commit_only(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("ab1", b"one"), ("a b", b"two"), ("a_b", b"three"), ("x", b""), (None, b"no"), ("none", None)], "uid string, payload binary")
    PF.write_payloads(df.repartition(3), path)
    found = {r.name: (r.folder, bytes(r.payload)) for r in PF.read_payloads(spark, path).collect()}
    assert len(found) == 3 and found["ab1.bin"] == ("ab", b"one") and found["a_b.bin"] == ("a_", b"three")
    # Spark's scans leave out empty files; the file is there.
    assert [f for _, _, names in os.walk(path) for f in names if f == "x.bin"] == ["x.bin"]
    # A second job adds its files; one that fails leaves nothing, whatever its tasks had written.
    bad = spark.range(0, 400, 1, 4).select(
        F.format_string("u%04d", "id").alias("uid"),
        F.when(F.col("id") < 399, F.lit(b"x")).otherwise(F.raise_error(F.lit("broken row")).cast("binary")).alias("payload"),
    )
    with pytest.raises(Exception, match="broken row|WRITE|write"):
        PF.write_payloads(bad, path)
    assert PF.read_payloads(spark, path).count() == 3 and [d for d in os.listdir(path) if d.startswith("_staging")] == []
    PF.write_payloads(spark.createDataFrame([("zz", b"late")], "uid string, payload binary"), path)
    assert PF.read_payloads(spark, path).count() == 4


def test_moves_may_stop_and_start_again(spark, tmp_path, rows):
    root, journal = tmp_path / "flat", f"{tmp_path}/journal"
    (root / "deep").mkdir(parents=True)
    for n in range(30):
        (root / f"f{n:02}.bin").write_text(str(n))
    (root / "deep" / "f01.bin").write_text("other")
    target = tmp_path / "to"
    (target / "f0").mkdir(parents=True)
    (target / "f0" / "f05.bin").write_text("there before")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "length")
    FM.plan_moves(files, f"file:{target}", journal)
    # A run that ended half-way: some files are in place already.
    for n in range(20, 26):
        (target / "f2").mkdir(exist_ok=True)
        os.rename(root / f"f{n}.bin", target / "f2" / f"f{n}.bin")
    os.remove(root / "f29.bin")
    for _ in range(2):
        FM.plan_moves(files, f"file:{target}", journal)
        status = {r.path.rsplit("flat/", 1)[1]: r.status for r in FM.move_files(spark, journal).collect()}
        assert len(status) == 31 and status["f05.bin"] == "blocked" and status["f29.bin"] == "lost"
        assert sorted((status["f01.bin"], status["deep/f01.bin"])) == ["blocked", "moved"]
        assert {s for f, s in status.items() if f not in ("f05.bin", "f29.bin", "f01.bin", "deep/f01.bin")} == {"moved"}
        assert (target / "f0" / "f05.bin").read_text() == "there before" and (root / "f05.bin").read_text() == "5"
        assert all((target / f"f{n // 10}" / f"f{n:02}.bin").read_text() == str(n) for n in range(29) if n not in (1, 5))


def test_sidecars_are_rewritten_once(spark, tmp_path, rows):
    docs = {"a": '{"latent_path": "old", "x": [1, "é"]}', "b": '{"latent_path": "new/b.pt"}', "c": '{"latent_path": "old"}', "d": "{broken"}
    for name, text in docs.items():
        (tmp_path / f"{name}.json").write_text(text)
    at = lambda n: f"file:{tmp_path}/{n}.json"
    plan = [(at("a"), "old", "new/a.pt"), (at("b"), "new/b.pt", "new/b.pt"), (at("c"), "old", None), (at("d"), None, "new/d.pt")]
    statuses = spark.createDataFrame(plan, "json_path string, latent_path string, next_latent_path string")
    for _ in range(2):
        done = {r.json_path[-6]: r.status for r in FM.rewrite_sidecars(statuses, f"{tmp_path}/journal").collect()}
        assert done == {"a": "updated", "b": "unchanged", "c": "missing_pt", "d": "broken"}
        assert json.loads((tmp_path / "a.json").read_text()) == {"latent_path": "new/a.pt", "x": [1, "é"]}
        assert (tmp_path / "c.json").read_text() == docs["c"] and (tmp_path / "d.json").read_text() == docs["d"]


def test_keyed_writes_add_each_key_once(spark, tmp_path, rows):
    path = str(tmp_path / "keyed")
    frame = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    counts = lambda df: tuple(df.first())
    assert counts(keyed.write_new(frame([("a", 1), ("a", 1), (None, 2)]), path, ["k"], "one")) == (3, 2, 1)
    # The same write again, then another with the same rows.
    assert counts(keyed.write_new(frame([("zzz", 1)]), path, ["k"], "one")) == (1, 0, 1)
    assert counts(keyed.write_new(frame([("a", 9), (None, 9)]), path, ["k"])) == (2, 0, 2)
    # A writer stops after its rows and before the ledger: they are not seen, and the next one clears them away.
    keyed.write_new(frame([("b", 3), ("c", 3)]), path, ["k"], "two", stop_before_ledger=True)
    assert rows(keyed.read_keyed(spark, path), "k", "v") == [("a", 1), (None, 2)]
    assert counts(keyed.write_new(frame([("b", 4)]), path, ["k"], "three")) == (1, 1, 0)
    assert rows(keyed.read_keyed(spark, path), "k", "v") == [("a", 1), ("b", 4), (None, 2)]
    assert counts(keyed.write_new(frame([("b", 3), ("c", 3)]), path, ["k"], "two")) == (2, 1, 1)


def test_keyed_writes_open_only_the_buckets_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "keyed")
    keyed.write_new(spark.range(2000).selectExpr("id AS k"), path, ["k"], "one")
    few = spark.createDataFrame([(5,), (5000,)], "k bigint").withColumn("bucket", keyed.bucket_of(["k"]))
    there = keyed.known_keys(few, path, ["k"])
    assert len({f.split("bucket=")[1].split("/")[0] for f in there.inputFiles()}) == keyed.BUCKETS
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(\d+,\d+\)|PartitionFilters: \[[^\]]*bucket#\d+ = ", plan), plan
    opened = there.select("k", F.input_file_name().alias("f")).select(F.regexp_extract("f", "bucket=(\\d+)", 1)).distinct().count()
    assert opened == few.select("bucket").distinct().count()


def _image(kind, w, h):
    big, little = lambda v, n: v.to_bytes(n, "big"), lambda v, n: v.to_bytes(n, "little")
    riff = lambda body: b"RIFF" + little(4 + len(body), 4) + b"WEBP" + body
    frame = lambda mark: bytes([0xFF, mark, 0, 17, 8]) + big(h, 2) + big(w, 2) + bytes([3] + [0] * 9)
    return {
        "png": IS.PNG + big(13, 4) + b"IHDR" + big(w, 4) + big(h, 4) + b"\x08\x02\x00\x00\x00",
        "jpeg": b"\xff\xd8\xff\xe0\x00\x10" + b"JFIF" + b"\0" * 10 + b"\xff\xd0" + frame(0xC0),
        # A thumbnail's frame inside a segment, a table whose marker looks like a frame, fill bytes, a progressive frame.
        "jpeg2": b"\xff\xd8\xff\xe1" + big(2 + 21 + 2, 2) + b"\xff\xd8" + frame(0xC0)[:21] + b"\xff\xff\xff\xc4\x00\x04ab" + frame(0xC2),
        "vp8": riff(b"VP8 " + little(30, 4) + b"\x10\x02\x00\x9d\x01\x2a" + little(w | 1 << 14, 2) + little(h, 2)),
        "vp8l": riff(b"VP8L" + little(30, 4) + b"\x2f" + little(w - 1 | (h - 1) << 14, 4)),
        "vp8x": riff(b"VP8X" + little(10, 4) + b"\0" * 4 + little(w - 1, 3) + little(h - 1, 3)),
    }[kind]


@pytest.mark.parametrize("kind", ["png", "jpeg", "jpeg2", "vp8", "vp8l", "vp8x"])
def test_image_sizes_from_headers(kind):
    of = lambda data: IS.size_of(lambda start, count: data[start : start + count])
    for w, h in ((1, 1), (640, 480), (16383, 16383)):
        whole = _image(kind, w, h)
        assert of(whole)[1:] == (w, h, None) and of(whole + b"pixels")[1:] == (w, h, None)
        shortest = min(n for n in range(len(whole) + 1) if of(whole[:n])[3] is None)
        assert all(of(whole[:n])[3] == "cut" and of(whole[:n])[1] is None for n in range(1, shortest))
    assert of(b"")[3] == "format" and of(b"GIF89a......")[3] == "format" and of(b"\xff\xd8\xff\xd9")[3] == "no_frame"
    assert of(b"\xff\xd8\x00\x00")[3] == "broken" and of(b"\xff\xd8\xff\xe0\x00\x01")[3] == "broken"
    assert of(_image("png", 1, 5)[:16] + b"\0" * 8)[3] == "no_size" and of(b"RIFF....WEBPALPH....")[3] == "broken"


def test_lists_follow_the_rules_of_scans_without_the_driver(spark, tmp_path, rows, monkeypatch):
    """The files a Spark scan finds, also where every folder is a round of its own."""
    names = ("a.json", "_hidden.json", ".dot.json", "b c%20é.json", "note.txt", "deep/x/a.json", "deep/_no/a.json", "deep/.no/a.json", "doc=1/a.json", "doc=2/_SUCCESS", "empty.json")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.json" else name)
    scan = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
    for budget in (FL.NAMES, 0):
        monkeypatch.setattr(FL, "NAMES", budget)
        found = FL.list_tree(spark, str(tmp_path), "*.json")
        assert rows(found) == rows(scan().option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")) and found.count() == 4
        assert {r.path.rsplit("/", 1)[1]: bytes(r.content).decode() for r in FL.read_files(found).collect()}["b c%20é.json"] == "b c%20é.json"
    flat = [str(tmp_path / "deep" / "x"), f"{tmp_path}/d?c=*", f"{tmp_path}/{{a,note}}.*", str(tmp_path / "a.json")]
    assert rows(FL.list_tree(spark, flat[:3], recursive=False)) == rows(spark.read.format("binaryFile").load(flat[:3]).select("path", "length"))
    assert rows(FL.list_tree(spark, flat[3])) == rows(scan().load(flat[3]).select("path", "length"))
    for missing in (f"{tmp_path}/none", f"{tmp_path}/none*"):
        with pytest.raises(FileNotFoundError):
            FL.list_tree(spark, missing)


@pytest.mark.parametrize("name", ["k7_payload_files", "s11_sidecars", "s7_bad_documents", "s6_bad_documents", "s5_bad_documents", "s11_bad_documents", "s2_bad_documents", "s8_bad_documents", "j14_rewrite_sidecars", "s9_image_scan"])
def test_no_list_of_many_files_is_made_by_the_driver(spark, monkeypatch, name):
    """Spark's file index, which the driver holds, sees the part files of tables only: no folder of one file per row."""
    loads, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: loads.append(a) or load(self, *a, **k))
    texts = []
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **k: texts.append(a))
    partitioned = []
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *a: partitioned.append(a) or self)
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert not loads and not texts and not partitioned


def test_keys_are_found_without_copying_the_document():
    """What is looked at for a key grows with the key, not with what stands before it."""
    from pairloom.sources import json_items

    class Counted(bytes):
        taken = 0

        def __getitem__(self, at):
            part = bytes.__getitem__(self, at)
            Counted.taken += len(part) if isinstance(part, bytes) else 1
            return part

    key = "k" * 3000 + '\\"\\\\'
    data = Counted(b'{"a": [1], ' * 20000 + f'"{key}"  '.encode() + b": [")
    colon = len(data) - 3
    file = json_items._Held(bytes(data))
    assert json_items._key_before(file, data, 0, colon) == "k" * 3000 + '"\\' and Counted.taken < 20000
    # The beginning of the key may stand before the range.
    for start in (colon - 2, colon - 1000, colon - 3020):
        assert json_items._key_before(file, bytes(data)[start:], start, colon - start) == "k" * 3000 + '"\\'
    Counted.taken = 0
    assert json_items._of(data, colon + 2) == ord(":") and json_items._of(data, colon) == ord('"') and Counted.taken < 2000
    assert json_items._of(b" " * 1000, 999) == ord(":") and json_items._of(b"x" + b" " * 1000, 999) == ord("x")
