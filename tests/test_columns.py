"""Edge cases of column expressions and row checks."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions import keys as K
from pairloom.functions import tensors as X
from pairloom.operators import assign, context, distribution as Q, judging as J, latents as L, pool as P, samples as S
from pairloom.sources.tables import natural_sort_key


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def each(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_bool_like(spark):
    words = ["true", " YES ", "y", "1", "maybe", "false", "No", "n", "0", "none", "NULL", "", "  ", None]
    assert each(spark, words, "string", lambda v: K.bool_like(v, T.StringType())) == [True] * 5 + [False] * 9
    assert each(spark, [0.0, 2.5, None], "double", lambda v: K.bool_like(v, T.DoubleType())) == [False, True, False]
    strict = each(spark, words, "string", lambda v: K.bool_like_strict(v, T.StringType()))
    assert strict == [True] * 4 + [None] + [False] * 4 + [None] * 5
    with pytest.raises(PySparkException, match="boolean-like"):
        each(spark, ["maybe"], "string", lambda v: K.bool_like_strict(v, T.StringType(), strict=True))


def test_missing_tests_differ(spark):
    cells = [None, "", " \t ", "none", " NaN ", "null", "x"]
    assert each(spark, cells, "string", K.is_blank) == [True, True, True, False, False, False, False]
    assert each(spark, cells, "string", K.is_missing) == [True] * 6 + [False]
    assert each(spark, cells, "string", K.trimmed_key) == [None, None, None, "none", "NaN", "null", "x"]


def test_names(spark):
    assert each(spark, ["a/b c.é-_", ""], "string", K.path_stem) == ["a_b_c.é-_", ""]
    assert each(spark, ["a.b", ""], "string", lambda v: K.path_stem(v, keep_dots=False)) == ["a_b", "image"]
    assert each(spark, ["abc", "a", ""], "string", K.stem_shard) == ["ab", "xx", "xx"]
    assert each(spark, ["/x/a.b.pt", "x/.pt", "a"], "string", K.file_stem) == ["a.b", ".pt", "a"]
    assert each(spark, ["train_shard12.json", "other"], "string", K.shard_number) == [12, None]
    assert each(spark, ["validation_shard1", "trainshard"], "string", K.shard_split) == ["validation", None]
    with pytest.raises(PySparkException, match="shard number"):
        each(spark, ["other"], "string", lambda v: K.shard_number(v, strict=True))


def test_orders(spark):
    keys = ["b", "10", "9", "009", "a", "123456789012345678901234567890", "-1"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.orderBy(*K.row_order(F.col("k"))).collect()]
    assert got == ["009", "9", "10", "123456789012345678901234567890", "-1", "a", "b"]
    names = ["s10.json", "s9.json", "s1.json", "r2/s1.json"]
    df = spark.createDataFrame([(k,) for k in names], "k string")
    assert [r[0] for r in df.orderBy(K.natural_key(F.col("k"))).collect()] == sorted(names, key=natural_sort_key)


def test_locators(spark):
    texts = ["hf://a/b/train/7/jpg_0", "hf://a/train/x/jpg_0", "hf://train/7/jpg_0", "/a/train/7/jpg_0", "hf://a/train/7/"]
    got = each(spark, texts, "string", K.parse_locator)
    assert got[0].asDict() == {"dataset": "a/b", "split": "train", "row_idx": 7, "column": "jpg_0"}
    assert got[1:] == [None] * 4
    made = one(spark, K.make_locator(F.lit("a/b"), F.lit("train"), F.lit(7), F.lit("jpg_0")))
    assert made == (texts[0],)


RAW = "row_idx long, split string, user_id string, caption string, image_0_uid string, image_1_uid string, best_image_uid string, has_label string"


def test_pool_reasons_in_order(spark, rows):
    good = dict(split="train", user_id=" u ", caption=" c ", image_0_uid="a", image_1_uid="b ", best_image_uid=" b", has_label="yes")
    spoil = [
        {}, {"has_label": "no", "user_id": None}, {"user_id": "nan"}, {"caption": "None", "image_0_uid": ""}, {"image_0_uid": " "},
        {"image_1_uid": None}, {"best_image_uid": "null"}, {"best_image_uid": "z"}, {"image_1_uid": "a", "best_image_uid": "a"},
    ]
    names = [n.split()[0] for n in RAW.split(", ")]
    df = spark.createDataFrame([tuple({**good, **s, "row_idx": i}[n] for n in names) for i, s in enumerate(spoil)], RAW)
    want = [
        None, "has_label_false", "missing_user_id", "missing_caption", "missing_image_0_uid", "missing_image_1_uid",
        "missing_best_image_uid", "best_uid_mismatch", None,
    ]
    assert [r[1] for r in rows(P.with_reason(df), "row_idx", "reason")] == want
    pool = P.build_pool(df)
    assert rows(pool, "source_row_idx", "user_id", "preferred_uid", "dispreferred_uid", "caption", "pair_key") == [
        (0, "u", "b", "a", " c ", "train:0"), (8, "u", "a", "a", " c ", "train:8"),
    ]
    assert rows(P.with_reason(df).filter("reason is null"), "row_idx") == rows(pool, "source_row_idx")
    kept = P.build_pool(df.filter("row_idx < 2"), strict=True)
    assert kept.count() == 1
    with pytest.raises(PySparkException, match="malformed row"):
        P.build_pool(df, strict=True).collect()


def test_folding_of_wider_and_partial_rows(spark):
    df = spark.createDataFrame(
        [("a", "b", "c", "d", "e", " ", 5), ("a", "b", "c", None, None, None, None)],
        "preferred_image_uid_0 string, dispreferred_image_uid_0 string, caption_0 string, preferred_image_uid_10 string,"
        " dispreferred_image_uid_10 string, caption_10 string, source_idx_10 long",
    )
    pairs = [r["pairs"] for r in assign.fold_pairs(df).collect()]
    assert [(p["pair_idx"], p["valid"], p["source_row_idx"]) for p in pairs[0]] == [(0, True, None), (10, False, 5)]
    assert [p["pair_key"] for p in pairs[1]] == ["support_0"]
    assert assign.explode_pairs(assign.fold_pairs(df)).count() == 2
    with pytest.raises(PySparkException, match="malformed pair"):
        assign.explode_pairs(assign.fold_pairs(df), strict=True).collect()


def test_embedding_checks(spark):
    nan = float("nan")
    cases = [[[1.0, 2.0]], [[1.0, 2.0], [1.0]], [[1.0]], [[1.0, nan]], [], None]
    got = each(spark, cases, "array<array<float>>", lambda v: S.embedding_ok(v, width=2))
    assert got == [None, "ragged_emb", "emb_width", "not_finite", "empty_emb", "missing_emb"]
    assert each(spark, [[[1.0], [2.0]], []], "array<array<float>>", S.last_token) == [[2.0], None]


def test_answers_and_scores(spark):
    m = "Prediction of user preference: "
    texts = [m + "1", m + "1 then " + m + " 2 ", "1", m + "+2\n", m + "1.0", m + "one", "", None]
    assert each(spark, texts, "string", J.parse_answer) == [1, 2, 1, 2, None, None, None, None]
    assert each(spark, ["2 or 1", "2", "x", None], "string", J.parse_answer_loose) == [1, 2, None, None]
    df = spark.createDataFrame(
        [(1, 2, False), (2, 1, False), (1, 1, False), (3, 2, False), (None, 1, False), (1, 2, True)], "a int, b int, f boolean"
    )
    score = J.score_pair(F.col("a"), F.col("b"), F.col("f"))
    assert [r[0] for r in df.select(score).collect()] == [1, 0, -1, -1, -2, -3]
    folded = J.score_pair(F.col("a"), F.col("b"), F.col("f"), fold_unparsed=True)
    assert [r[0] for r in df.select(folded).collect()] == [1, 0, -1, -1, -3, -3]


def test_profile_messages(spark):
    made = J.profile_messages(F.lit("likes cats"), F.lit("p"), F.lit("d"), swap=True)
    messages, valid = one(spark, made, J.messages_valid(made))
    assert valid and [p["image_uid"] for p in messages[1]["content"] if p["type"] == "image"] == ["d", "p"]
    assert messages[1]["content"][1]["text"] == "likes cats"


def test_tensor_expressions(spark):
    inf, nan = float("inf"), float("nan")
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, X.has_nan(arr(1, nan)), X.has_inf(arr(1, -inf)), X.all_finite(arr(1, nan)), X.all_finite(arr(1))) == (True, True, False, True)
    m = one(spark, X.pair_metrics(arr(3, 4), arr(0, 0)))[0]
    assert (m["l2_norm"], m["mean_abs_diff"], m["max_abs_diff"], m["cosine_similarity"]) == (5.0, 3.5, 4.0, 0.0)
    m = one(spark, X.pair_metrics(arr(1), arr(1, 2)))[0]
    assert (m["same_shape"], m["l2_norm"]) == (False, None)
    big = one(spark, X.neg_log_sigmoid(F.lit(-1000.0)), X.neg_log_sigmoid(F.lit(1000.0)), X.neg_log_sigmoid(F.lit(0.0)))
    assert big[0] == 1000.0 and big[1] == 0.0 and math.isclose(big[2], math.log(2))
    assert one(spark, X.true_class_rank(arr(1, 2, 2), F.lit(1)), X.true_class_rank(arr(1, 2, 2), F.lit(2)))== (1, 2)
    assert one(spark, X.top_classes(arr(1, 3, 3, 2), 3))[0] == [1, 2, 3]
    assert math.isclose(sum(one(spark, X.softmax(arr(1000, 1001, 999)))[0]), 1.0)


def test_contracts_and_policies(spark):
    df = spark.createDataFrame(
        [("u", [16, 24, 24], False, "stability_train_c_raw_effnet"), ("v", [1, 16, 24, 24], False, "stability_train_c_raw_effnet"),
         ("w", [16, 24, 24], None, "stability_train_c_raw_effnet"), (" ", [16, 24, 24], False, None)],
        "uid string, shape array<int>, scaled boolean, latent_semantics string",
    )
    assert [r[0] for r in df.select(L.contract_reason(df)).collect()] == [None, "shape", "scaled", "missing_uid"]
    assert L.contract_filter(df).count() == 1
    with pytest.raises(PySparkException, match="latent contract"):
        L.contract_filter(df, strict=True).collect()
    assert [r["shape_match"] for r in L.shape_check(df, (16, 24, 24), "none").collect()] == [True, False, True, True]
    with pytest.raises(PySparkException, match="shape mismatch for v"):
        L.shape_check(df, (16, 24, 24), "strict").collect()
    assert one(spark, L.expected_spatial(F.lit(1024), F.lit(1000), 42.67))[0].asDict() == {"h": 24, "w": 24}


def test_stored_statistics_must_be_whole(spark):
    df = spark.createDataFrame([((1.0, 2.0, None, 3.0), [1.0])], "stats struct<min:double,max_value:double,mean:double,std:double>, vals array<float>")
    with pytest.raises(PySparkException, match="lack mean"):
        df.select(L.bundle_stats(df)).collect()


def test_condition_grid(spark, rows):
    prompts = spark.createDataFrame([("a", 0), ("b", 1)], "prompt string, prompt_index long")
    grid = context.condition_grid(prompts, [1, 2], [1.0, 0.5, -2.0, 1234567.0], ["base", "real_user"])
    assert grid.count() == 2 * 2 * 4 * 2 and grid.select("sample_id").distinct().count() == 16
    last = grid.filter("prompt = 'b' and seed = 2 and condition = 'base'")
    assert rows(last, "sample_index", "sample_id") == [
        (12, "sample_12_scale_1"), (13, "sample_13_scale_0p5"), (14, "sample_14_scale_m2"), (15, "sample_15_scale_1p23457e+06"),
    ]


def test_manual_prompts_win(spark, rows):
    df = spark.createDataFrame([("e", [("cap",)])], "user_embedding_id string, query_pairs array<struct<caption:string>>")
    got = context.select_prompts(df, manual=["b", " b ", "a"], defaults=["a", "d"], extras=["", "x"])
    assert rows(got, "prompt_index", "prompt", "source") == [
        (0, "b", "manual"), (1, "a", "manual"), (2, "d", "default_extra"), (3, "x", "extra"),
    ]


@pytest.mark.parametrize("shift", [0.0, 1e8])
@pytest.mark.parametrize("parts", [1, 7])
def test_moments_merge_without_loss(spark, shift, parts):
    """Group, channel and position statistics equal numpy's however far the values are from zero."""
    rng = np.random.default_rng(3)
    tensors = [(("a", "b", None)[i % 3], (rng.standard_normal(2 * 3 * 4) + shift).tolist(), [2, 3, 4]) for i in range(50)]
    tensors += [("a", [], [1, 0, 0]), ("b", None, None), ("none", [float("nan"), float("inf")], [1, 1, 2])]
    df = spark.createDataFrame(tensors, "k string, vals array<double>, shape array<int>").repartition(parts)
    of = lambda k: np.array([v for key, v, _ in tensors if key == k and v and np.isfinite(v).all()])
    close = lambda a, b: abs(a - b) <= 1e-9 * max(abs(b), 1e-300)
    std = lambda v: (v - shift).std()  # the difference is exact
    got = {r.k: r for r in Q.group_stats(df, ["k"]).collect()}
    for k in ("a", "b", None):
        assert close(got[k].std_value, std(of(k))) and close(got[k].mean_value, of(k).mean()) and got[k].finite_count == of(k).size
    assert got["none"].std_value is None and got["none"].finite_count == 0 and got["none"].inf_count == 1
    whole = np.concatenate([of(k) for k in ("a", "b", None)])
    one = Q.group_stats(df).first()
    assert close(one.std_value, std(whole)) and one.finite_count == whole.size
    shaped = whole.reshape(-1, 2, 12)
    finite = df.where("k IS NULL OR k <> 'none'")
    for r in Q.channel_summary(finite).collect():
        assert close(r.channel_std, std(shaped[:, r.channel])) and close(r.channel_mean, shaped[:, r.channel].mean())
    for r in Q.spatial_summary(finite).collect():
        assert close(r.spatial_std, std(shaped[:, :, r.position]))
    # States merge again, in any grouping.
    states = df.select("k", X.moments(X.finite_only(F.col("vals"))).alias("m"))
    twice = Q.merge_moments(Q.merge_moments(states, ["k"]).select(F.struct("n", "mean", "m2", "rest").alias("m"))).select("n", Q.merged_std().alias("std")).first()
    assert twice.n == whole.size and close(twice.std, std(whole))


def test_stripped_texts_have_no_white_space_at_their_ends(spark):
    """Texts between visible characters are left alone; all others lose what the list of white space holds."""
    cores = ["", "a", "~", "!", "\u00e9", "a b", "\u00e9 x \u00e9", "\x7f", "\x00a", "a\u3000b", "\u200b"]
    texts = [a + c + b for c in cores for a in ("", *K.WHITE_SPACE, " \t") for b in ("", *K.WHITE_SPACE, "\n ")]
    df = spark.createDataFrame([(t,) for t in [None, *texts]], "t string").select("t", K.strip(F.col("t")).alias("s"))
    assert all(r["s"] == (r["t"] if r["t"] is None else r["t"].strip(K.WHITE_SPACE)) for r in df.collect())


def test_pool_texts_are_stripped_once(spark):
    """The tests and the rows of the pool share one stripped form of each of the five texts."""
    names = ["user_id", "caption", "image_0_uid", "image_1_uid", "best_image_uid"]
    df = spark.range(10).select(F.col("id").alias("row_idx"), F.lit("train").alias("split"), *[F.concat("id", F.lit(n)).alias(n) for n in names])
    plan = P.build_pool(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" trim(") == 5
