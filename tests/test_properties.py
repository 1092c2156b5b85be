"""Properties that hold on any data, among them a user who owns a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window, functions as F

from pairloom.functions import keys as K
from pairloom.functions import tensors as X
from pairloom.operators import assign, context, distribution as Q, latents as L, manifest as M, metrics as R, ranking, samples as S, shots


def skewed_pool(spark, n=3000):
    """A third of the rows belong to one user, and some rows repeat a pair."""
    i = F.col("id")
    return spark.range(n).select(
        F.lit("train").alias("split"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (i % 97).cast("string"))).alias("user_id"),
        F.concat(F.lit("p"), (i % 301).cast("string")).alias("preferred_uid"),
        F.concat(F.lit("d"), (i % 7).cast("string")).alias("dispreferred_uid"),
        F.concat(F.lit("c"), (i % 5).cast("string")).alias("caption"),
        i.alias("row_idx"),
        i.alias("source_row_idx"),
        F.concat(F.lit("train:"), i.cast("string")).alias("pair_key"),
    )


def differing(df, *tests):
    """Rows on which any of the tests does not hold."""
    checked = df.select(*[t.alias(f"t{i}") for i, t in enumerate(tests)])
    return checked.filter(" OR ".join(f"NOT t{i}" for i in range(len(tests)))).count()


@pytest.fixture(scope="module")
def pool(spark):
    df = skewed_pool(spark).cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def embeddings(spark, pool):
    groups = shots.gather_shots(shots.chunk_shots(pool))
    rows = groups.withColumn("user_embedding_id", F.concat_ws("_", "user_id", F.col("chunk").cast("string")))
    rows = rows.withColumnRenamed("pairs", "support_pairs").cache()
    rows.count()
    return rows


def test_hash_positions_equal_the_plain_window(spark, pool):
    df = pool.withColumn("h", K.seeded_hash(1, F.col("row_idx")))
    plain = Window.partitionBy("user_id").orderBy("h", "row_idx")
    got = ranking.position_by_hash(df, ["user_id"], "h", ["row_idx"], "p", total="n")
    want = F.row_number().over(plain) - 1
    count = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    assert differing(got, F.col("p") == want, F.col("n") == count) == 0
    assert got.count() == pool.count()


@pytest.mark.parametrize("width", [1, 10, 1 << 20])
def test_ordinal_positions_and_running_values_equal_the_plain_window(spark, pool, width):
    df = pool.withColumn("x", (F.col("row_idx") * 7919 % 1000).cast("double"))
    plain = Window.partitionBy("user_id").orderBy("row_idx")
    got = ranking.position_by_ordinal(df, ["user_id"], "row_idx", "p", width)
    assert differing(got, F.col("p") == F.row_number().over(plain) - 1) == 0
    upto, before = plain.rowsBetween(Window.unboundedPreceding, 0), plain.rowsBetween(Window.unboundedPreceding, -1)
    run = ranking.running(df, "row_idx", {"s": ("sum", "x"), "m": ("max", "x")}, ["user_id"], width=width)
    assert differing(run, F.col("s") == F.sum("x").over(upto), F.col("m") == F.max("x").over(upto)) == 0
    run = ranking.running(df, "row_idx", {"m": ("min", "x")}, ["user_id"], inclusive=False, width=width)
    assert differing(run, F.col("m").eqNullSafe(F.min("x").over(before))) == 0


def test_sorted_positions(spark, pool):
    got = ranking.position_by_sort(pool.select("row_idx", "caption"), [F.desc("caption"), F.col("row_idx")], "p")
    plain = Window.orderBy(F.desc("caption"), "row_idx")
    assert got.count() == pool.count()
    assert differing(got, F.col("p") == F.row_number().over(plain) - 1) == 0


def test_shot_groups_are_full_and_disjoint(spark, pool):
    chunks = shots.chunk_shots(pool)
    sizes = chunks.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.collect_set("pos").alias("p"))
    assert sizes.filter((F.col("n") != 4) | (F.size("p") != 4)).count() == 0
    assert chunks.count() == chunks.select("row_idx").distinct().count()
    left = pool.groupBy("user_id").count().join(chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("used")), "user_id", "left")
    assert left.filter(F.col("count") - F.coalesce("used", F.lit(0)) >= 4).count() == 0
    assert shots.chunk_shots(pool, per_user=2).filter(F.col("chunk") >= 2).count() == 0


def brute_force(pool, embeddings, k):
    """Every (row, candidate) looked at one by one, in plain Python."""
    out = {}
    by_user = {u: g.sort_values("source_row_idx") for u, g in pool.toPandas().groupby("user_id")}
    for row in embeddings.collect():
        own = {(p["preferred_uid"], p["dispreferred_uid"], p["caption"]) for p in row["support_pairs"]}
        mine = by_user[row["user_id"]]
        seen, left = set(), []
        for r in mine.itertuples():
            sig = (r.preferred_uid, r.dispreferred_uid, r.caption)
            if sig not in own and sig not in seen:
                seen.add(sig)
                left.append((sig, r.source_row_idx))
        out[row["user_embedding_id"]] = (len(mine), len(left), dict(left))
    return out


@pytest.mark.parametrize("k", [1, 5, 60])
def test_assignments_against_brute_force(spark, pool, embeddings, k):
    truth = brute_force(pool, embeddings, k)
    got = assign.build_assignments(embeddings, pool, k=k, on_empty="keep").collect()
    assert len(got) == len(truth)
    for row in got:
        before, after, candidates = truth[row["user_embedding_id"]]
        assert (row["num_candidate_pairs_before_filter"], row["num_candidate_pairs_after_filter"]) == (before, after)
        drawn = [((p["preferred_uid"], p["dispreferred_uid"], p["caption"]), p["source_row_idx"]) for p in row["query_pairs"]]
        assert len(drawn) == len(set(drawn)) == min(k, after)
        assert all(candidates.get(sig) == idx for sig, idx in drawn)
        if after <= k:
            assert row["query_sampling_strategy"] == "all_candidates"
            assert [i for _, i in drawn] == sorted(i for _, i in drawn)
        else:
            assert row["query_sampling_strategy"] == f"random_sample_without_replacement_k={k}"


def test_draws_do_not_depend_on_partitioning_but_on_the_seed(spark, pool, embeddings, rows):
    pick = lambda df: rows(df, "user_embedding_id", F.transform("query_pairs", lambda p: p["pair_key"]).cast("string"))
    first = pick(assign.build_assignments(embeddings, pool, on_empty="keep"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = pick(assign.build_assignments(embeddings.repartition(5), pool.repartition(9, "caption"), on_empty="keep"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
    assert first != pick(assign.build_assignments(embeddings, pool, seed=1, on_empty="keep"))


def test_draws_spread_over_the_candidates(spark, pool, embeddings):
    got = assign.build_assignments(embeddings, pool, on_empty="keep").filter(F.col("user_id") == "hot")
    n = got.count()
    assert got.select(F.inline("query_pairs")).select("source_row_idx").distinct().count() > n * 0.5


def test_rows_of_different_shards_stay_apart(spark):
    """Two shards with the same user and row number: one pair each, and only their own exclusions."""
    schema = "split string, user_id string, preferred_uid string, dispreferred_uid string, caption string, source_row_idx long"
    pool = spark.createDataFrame([("t", "u", f"p{i}", "d", "c", i) for i in range(3)], schema)
    emb = spark.createDataFrame(
        [("t", "u", "u_emb_0", s, 0, [(f"p{s}", "d", "c"), ("p2", "d", "c")]) for s in (0, 1)] + [("t", "u", "u_emb_0", None, 0, [])],
        "split string, user_id string, user_embedding_id string, shard_id long, source_embedding_row_idx long, "
        "support_pairs array<struct<preferred_uid:string,dispreferred_uid:string,caption:string>>",
    )
    got = {r["shard_id"]: r for r in assign.build_assignments(emb, pool).collect()}
    assert {s: r["num_candidate_pairs_after_filter"] for s, r in got.items()} == {0: 1, 1: 1, None: 3}
    assert [p["preferred_uid"] for p in got[0]["query_pairs"]] == ["p1"] and [p["preferred_uid"] for p in got[1]["query_pairs"]] == ["p0"]
    assert len(got[None]["query_pairs"]) == 1
    counts = assign.held_out_counts(emb, pool, "user_embedding_id")
    assert {r["shard_id"]: r["num_candidate_pairs_after_filter"] for r in counts.collect()} == {0: 1, 1: 1, None: 3}


def test_every_subset_can_be_drawn(spark):
    """3 of 40 for 2,000 rows: nearly as many different sets as rows, and every candidate about as often."""
    schema = "split string, user_id string, preferred_uid string, dispreferred_uid string, caption string, source_row_idx long"
    pool = spark.createDataFrame([("t", "u", f"p{i}", "d", "c", i) for i in range(40)], schema)
    emb = spark.range(2000).select(
        F.lit("t").alias("split"), F.lit("u").alias("user_id"), F.col("id").cast("string").alias("user_embedding_id"),
        F.array().cast("array<struct<preferred_uid:string,dispreferred_uid:string,caption:string>>").alias("support_pairs"),
    )
    ranked = assign.rank_pool(pool, seed=3)
    got = [frozenset(p["source_row_idx"] for p in r["query_pairs"]) for r in assign.build_assignments(emb, ranked, k=3, seed=3).collect()]
    assert all(len(s) == 3 for s in got) and len(set(got)) > 1700
    times = [sum(i in s for s in got) for i in range(40)]
    assert 100 < min(times) and max(times) < 210


def test_assignment_plan_has_only_hash_joins(spark, pool, embeddings):
    plan = assign.build_assignments(embeddings, pool, on_empty="keep")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_empty_candidate_sets(spark):
    schema = "split string, user_id string, preferred_uid string, dispreferred_uid string, caption string, source_row_idx long"
    pool = spark.createDataFrame([("train", "u", f"p{i % 4}", "d", "c", i) for i in range(8)], schema)
    pairs = [(f"p{i}", "d", "c") for i in range(4)]
    emb = spark.createDataFrame(
        [("train", "u", "e", pairs), ("train", "nobody", "f", pairs)],
        "split string, user_id string, user_embedding_id string, support_pairs array<struct<preferred_uid:string,dispreferred_uid:string,caption:string>>",
    )
    kept = {r["user_embedding_id"]: r for r in assign.build_assignments(emb, pool, on_empty="keep").collect()}
    assert (kept["e"]["num_candidate_pairs_before_filter"], kept["e"]["num_candidate_pairs_after_filter"]) == (8, 0)
    assert (kept["f"]["num_candidate_pairs_before_filter"], kept["f"]["query_pairs"]) == (0, [])
    assert assign.build_assignments(emb, pool, on_empty="skip").count() == 0
    with pytest.raises(PySparkException, match="no held-out query pairs"):
        assign.build_assignments(emb, pool).collect()
    with pytest.raises(ValueError):
        assign.build_assignments(emb, pool, k=0)


def test_missing_captions_match_any_caption(spark, rows):
    schema = "split string, user_id string, preferred_uid string, dispreferred_uid string, caption string, source_row_idx long"
    pool = spark.createDataFrame(
        [("t", "u", "a", "b", "x", 0), ("t", "u", "a", "b", "y", 1), ("t", "u", "c", "d", None, 2), ("t", "u", "e", "f", "z", 3)], schema
    )
    emb = spark.createDataFrame(
        [("t", "u", "open", [("a", "b", None)]), ("t", "u", "closed", [("c", "d", "q"), ("a", "b", "x")])],
        "split string, user_id string, user_embedding_id string, support_pairs array<struct<preferred_uid:string,dispreferred_uid:string,caption:string>>",
    )
    got = assign.build_assignments(emb, pool, k=9, captions_checked=False)
    assert rows(got, "user_embedding_id", F.transform("query_pairs", lambda p: p["source_row_idx"])) == [("closed", [1, 3]), ("open", [2, 3])]
    counts = assign.held_out_counts(emb, pool, "user_embedding_id", captions_checked=False)
    assert rows(counts, "user_embedding_id", "num_candidate_pairs_after_filter") == [("closed", 2), ("open", 2)]


def test_user_chunks_cover_everyone_or_drop_the_rest(spark):
    users = spark.createDataFrame([(f"u{i:02d}",) for i in range(10)] * 2, "user_id string")
    whole = shots.user_chunks(users, 4).toPandas()
    assert sorted(whole.groupby("user_chunk").size()) == [1, 3, 3, 3] and len(whole) == 10
    cut = shots.user_chunks(users, 4, mode="floor").toPandas()
    assert list(cut.groupby("user_chunk").size()) == [2, 2, 2, 2] and "u09" not in set(cut.user_id)
    assert shots.user_chunks(users, 40, mode="floor").count() == 0
    assert shots.user_chunks(users, 40).count() == 10


def tensor_table(spark, arrays, **columns):
    pdf = pd.DataFrame({"uid": [f"u{i}" for i in range(len(arrays))], "vals": [list(map(float, a)) for a in arrays], **columns})
    return spark.createDataFrame(pdf, "uid string, vals array<double>" + "".join(f", {c} string" for c in columns))


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    cases = {
        "normal": rng.normal(size=400), "same": np.full(50, 3.25), "zeros": np.concatenate([np.zeros(30), -np.zeros(5), [1e-30, -1e-30]]),
        "narrow": 1 + rng.random(300) * 1e-4, "wide": 10.0 ** rng.uniform(-30, 30, size=200) * rng.choice([-1, 1], 200), "one": np.array([7.0]),
    }
    dirty = {k: np.concatenate([v, [np.nan, np.inf, -np.inf]]).astype("float32").astype(float) for k, v in cases.items()}
    df = tensor_table(spark, list(dirty.values()), g=list(dirty))
    for row in Q.quantiles(df, ["g"]).collect():
        clean = dirty[row["g"]][np.isfinite(dirty[row["g"]])]
        want = np.quantile(clean, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1])
        got = [row[n] for n in ("p0", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "p100")]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-38)


def test_histogram_edges(spark):
    df = tensor_table(spark, [[2.0, 2.0], [2.0]], g=["a", "b"])
    bins = Q.shared_histogram(df, "g", ("a", "b"), bins=4).orderBy("bin").toPandas()
    assert list(bins.prior_count) == [0, 0, 2, 0] and list(bins.precomputed_count) == [0, 0, 1, 0]
    assert (bins.bin_left[0], bins.bin_right[3]) == (1.5, 2.5)
    df = tensor_table(spark, [[0.0, 1.0, float("nan")], [4.0]], g=["a", "b"])
    bins = Q.shared_histogram(df, "g", ("a", "b"), bins=4).orderBy("bin").toPandas()
    assert list(bins.prior_count) == [1, 1, 0, 0] and list(bins.precomputed_count) == [0, 0, 0, 1]


def test_running_stats_merge_from_any_partitioning(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.normal(size=8) for _ in range(40)]
    df = tensor_table(spark, arrays)
    flat = np.concatenate(arrays)
    for parts in (1, 7, 40):
        row = Q.running_stats(df.repartition(parts)).first()
        assert row["total_count"] == 320
        np.testing.assert_allclose([row["mean_value"], row["std_value"], row["min_value"], row["max_value"]], [flat.mean(), flat.std(), flat.min(), flat.max()])
    assert Q.running_stats(tensor_table(spark, [[0.1, 0.1, 0.1]])).first()["std_value"] < 1e-8


def test_calibration_moves_channel_moments(spark):
    rng = np.random.default_rng(2)
    df = tensor_table(spark, [rng.normal(size=32) for _ in range(6)]).withColumn("shape", F.array(F.lit(2), F.lit(4), F.lit(4)))
    target = spark.createDataFrame([(0, 5.0, 2.0), (1, -1.0, 0.5)], "channel long, channel_mean double, channel_std double")
    moved = Q.calibrate_channels(df, Q.channel_summary(df), target)
    got = Q.channel_summary(moved).orderBy("channel").toPandas()
    np.testing.assert_allclose(got.channel_mean, [5.0, -1.0])
    np.testing.assert_allclose(got.channel_std, [2.0, 0.5])


def test_batches_and_padding(spark):
    df = spark.createDataFrame([(i, [[float(i)] * 2] * (i % 3)) for i in range(7)], "i long, emb array<array<float>>")
    out = S.pad_and_mask(S.batch_ids(df, "i", 3, start_batch=1, width=2)).orderBy("i").toPandas()
    assert list(out.i) == [3, 4, 5, 6] and list(out.batch_id) == [1, 1, 1, 2] and list(out.batch_pos) == [0, 1, 2, 0]
    assert [list(m) for m in out["mask"]] == [[0, 0], [1, 0], [1, 1], []]
    assert [[list(r) for r in e] for e in out.emb][1] == [[4.0, 4.0], [0.0, 0.0]]


def test_capped_samples_keep_scan_order_for_a_hot_uid(spark):
    n = 500
    df = spark.range(n).select(
        F.when(F.col("id") < 20, "validation").otherwise("train").alias("split"), F.col("id").alias("row_idx"), F.lit("hot").alias("image_0_uid"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("image_1_uid"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("caption"),
        F.lit("hot").alias("best_image_uid"),
    )
    meta = M.uid_metadata(df)
    hot = meta.filter("uid = 'hot'").first()
    assert hot["num_occurrences"] == n and hot["best_count"] == n and hot["split_counts"] == {"train": 480, "validation": 20}
    assert hot["caption_samples"] == ["c20", "c21", "c22"] and hot["partner_uid_samples"] == [f"x{i}" for i in range(20, 26)]
    assert (hot["first_seen"]["row_idx"], hot["last_seen"]["row_idx"], hot["source_paths"]) == (20, 19, [])
    plan = M.capped_samples(M.sightings(df), "caption", 3, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_validation_summary_takes_the_first_batches(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(30)] + [("b", 0, 7.0)], "run string, i long, loss double")
    got = {r["run"]: (r["val_batches"], r["val_loss"]) for r in R.validation_summary(df, ["loss"], "i", 20, ["run"], width=4).collect()}
    assert got == {"a": (20, 9.5), "b": (1, 7.0)}


def test_long_tensors_take_linear_time(spark):
    """Whole statistics of full-size latents; work per element must not depend on the tensor's length."""
    rng = np.random.default_rng(3)
    arrays = [rng.normal(size=16 * 24 * 24) for _ in range(40)]
    df = tensor_table(spark, arrays).withColumn("shape", F.array(F.lit(16), F.lit(24), F.lit(24)))
    got = Q.with_full_stats(df).toPandas().sort_values("uid", key=lambda u: u.str[1:].astype(int))
    np.testing.assert_allclose(got["std"], [a.std() for a in arrays])
    np.testing.assert_allclose(got["l2_norm"], [np.linalg.norm(a) for a in arrays])
    summary = Q.channel_summary(df)
    moved = Q.calibrate_channels(df, summary, summary)
    back = moved.select(F.array_max("vals").alias("m"), "uid").toPandas().sort_values("uid", key=lambda u: u.str[1:].astype(int))
    np.testing.assert_allclose(back["m"], [a.max() for a in arrays])


def test_null_keys_and_equal_paths_are_kept_once(spark, rows):
    df = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", None), (None, "q"), (None, "r")], "uid string, latent_path string")
    got = rows(L.mark_duplicates(df), "uid", "latent_path", "first_path", "is_duplicate")
    assert len(got) == 5 and sorted(r[0] or "" for r in got if not r[3]) == ["", "a"]
    assert {r[1] for r in got if not r[3]} == {"p", "q"}


def test_null_ordinals_keep_their_rows(spark):
    df = spark.createDataFrame([("k", None), ("k", 5), (None, 1)], "k string, n long")
    got = ranking.position_by_ordinal(df, ["k"], "n", "at").collect()
    assert sorted((r.k or "", r["at"]) for r in got) == [("", 0), ("k", 0), ("k", 1)]


def test_repeated_lookup_uids_do_not_multiply_rows(spark, rows):
    pairs = spark.createDataFrame([("a", "b")], "preferred_uid string, dispreferred_uid string")
    latents = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3"), ("b", " ")], "uid string, latent_path string")
    assert rows(S.attach_latents(pairs, latents), "preferred_latent_path", "dispreferred_latent_path") == [("1", "3")]


def test_last_image_counts_and_shards_stay_apart(spark, rows):
    records = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, c string")
    images = spark.createDataFrame([(1, 0, "old"), (1, 1, "new")], "sample_id long, place long, path string")
    assert rows(context.report_rows(records, images), "sample_id", "path") == [(1, "new"), (2, None)]
    emb = spark.createDataFrame([("t", s, "u", "u_emb_0", 0) for s in (0, 1)], "split string, shard_id long, user_id string, user_embedding_id string, source_embedding_row_idx long")
    assert context.find_embedding_rows(emb, emb).count() == 2
    files = spark.createDataFrame([("train_shard1.json",), ("validation_shard1.json",)], "name string")
    assert {r.status for r in S.match_shards(files, files).collect()} == {"matched"}


def test_missing_user_of_an_embedding_row_is_not_out_of_range(spark, rows):
    schema = "split string, shard_id long, user_id string, user_embedding_id string, source_embedding_row_idx long, support_pairs array<struct<preferred_uid:string,dispreferred_uid:string,caption:string>>"
    emb = spark.createDataFrame([("t", 0, None, "e", 0, [])], schema)
    asked = spark.createDataFrame([("t", 0, "u", "e", 0, [])], schema).withColumn("query_pairs", F.col("support_pairs"))
    assert rows(S.match_embeddings(asked, emb), "reason") == [("user_mismatch",)]


def test_shapes_and_channels_are_compared(spark):
    row = spark.range(1).select(F.array(*[F.lit(1.0)] * 4).alias("v"))
    shape = lambda *n: F.array(*[F.lit(x) for x in n])
    same = lambda a, b: row.select(X.pair_metrics(F.col("v"), F.col("v"), a, b)["same_shape"]).first()[0]
    assert same(shape(2, 2), shape(2, 2)) and not same(shape(1, 4), shape(4, 1))
    df = row.select(F.col("v").alias("vals"), shape(4, 1, 1).alias("shape"))
    stats = spark.createDataFrame([(c, 0.0, 1.0) for c in range(4)], "channel int, channel_mean double, channel_std double")
    assert Q.calibrate_channels(df, stats, stats).first()["vals"] == [1.0] * 4
    with pytest.raises(PySparkException, match="no statistics"):
        Q.calibrate_channels(df, stats, stats.filter("channel <> 1")).collect()


def test_uids_without_an_order_are_ranked_in_many_tasks(spark):
    pair = F.struct(F.concat(F.lit("p"), (F.col("id") % 4000).cast("string")).alias("preferred_uid"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("dispreferred_uid"))
    lines = spark.range(6000).select("id", F.array(pair).alias("query_pairs"))
    got = M.ordered_unique_uids(M.referenced_uids(lines))
    places = [r.place for r in got.collect()]
    assert len({r.uid for r in got.collect()}) == 10000 and sorted(places) == list(range(10000))
    # Equal ordinals: preferred before dispreferred, then by uid, whatever the partitioning.
    again = M.ordered_unique_uids(M.referenced_uids(lines.repartition(7)))
    assert got.join(again, ["uid", "place"]).count() == 10000
    assert got.orderBy("place").first().uid == "p0" and got.filter("place >= 4000 AND uid LIKE 'p%'").count() == 0
    # With an order the line decides first.
    by_line = {r.uid: r.place for r in M.ordered_unique_uids(M.referenced_uids(lines, order="id")).filter("place < 6").collect()}
    assert by_line == {"p0": 0, "d0": 1, "p1": 2, "d1": 3, "p2": 4, "d2": 5}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ranked_rows_are_dealt_out_once(spark):
    """The join with the offsets takes rows as the window left them, with null keys as well."""
    from pairloom.operators.ranking import position_by_hash

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select(
            F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("a"), F.when(F.col("id") % 2 > 0, F.lit("x")).alias("b"),
            F.md5(F.col("id").cast("string")).alias("h"), "id",
        )
        placed = position_by_hash(df, ["a", "b"], "h", ["id"], "place", 1, total="n")
        # The rows once; the counts by bucket, by key, and for the join.
        assert _exchanges(placed) <= 4
        plain = Window.partitionBy("a", "b")
        want = df.select("*", (F.row_number().over(plain.orderBy("h", "id")) - 1).cast("bigint").alias("place"), F.count(F.lit(1)).over(plain).alias("n"))
        assert placed.columns == want.columns and sorted(map(tuple, placed.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_heavy_keys_are_cut_into_buckets(spark, monkeypatch):
    """Light keys are ranked and gathered where one exchange by key put them; heavy ones get the same places."""
    from pairloom.operators import ranking

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("split"), F.when(F.col("id") % 10 > 0, F.lit("x")).alias("user_id"), (F.col("id") % 400).cast("string").alias("preferred_uid"),
        F.lit("d").alias("dispreferred_uid"), F.lit("c").alias("caption"), F.col("id").alias("row_idx"), F.col("id").alias("source_row_idx"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        # All keys light, some, none.
        for heavy, exchanges in ((1 << 16, 1), (500, 12), (0, 12)):
            monkeypatch.setattr(ranking, "HEAVY", heavy)
            groups = shots.gather_shots(shots.chunk_shots(df))
            assert _exchanges(groups) <= exchanges
            # Users without a null, as pools have them.
            pool = assign.rank_pool(df.fillna("n", ["split", "user_id"]))
            sizes = pool.sizes.select("split", "user_id", "num_candidate_pairs_before_filter", "__n")
            got.append([sorted(map(tuple, x.collect()), key=repr) for x in (groups, pool.placed.select(sorted(pool.placed.columns)), sizes)])
        assert got[0] == got[1] == got[2] and all(map(len, got[0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_at_once_are_those_of_chunks(spark, pool, monkeypatch):
    """Groups taken from neighbours in one sort, for light and heavy users, limited or not."""
    fields = ["preferred_uid", "dispreferred_uid", "caption", "row_idx"]
    for per_user in (-1, 3):
        want = shots.gather_shots(shots.chunk_shots(pool, per_user=per_user), fields=fields)
        for heavy in (1 << 16, 500, 0):
            monkeypatch.setattr(ranking, "HEAVY", heavy)
            got = shots.shot_groups(pool, fields, per_user=per_user)
            if heavy == 1 << 16:
                assert _exchanges(got) == 1 and "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_single_draws_are_not_gathered_again(spark, pool, embeddings):
    """With one draw a row, rows meet their exclusions and their pair, and are grouped no more; joins sort by a hash first."""
    ranked = assign.rank_pool(pool)
    plan = assign.build_assignments(embeddings, ranked, on_empty="keep")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(lines) == 1 and "collect_set" in lines[0]
    assert sum("Join" in line and "__prefix" in line for line in plan.splitlines()) == 2

