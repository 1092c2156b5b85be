"""Queries over latents, tensors, judge answers, classifiers and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.operators import assign, context, distribution as Q, judging as J, latents as L, metrics as R, samples as S
from pairloom.plans import derived as D
from pairloom.plans.registry import CTES, query, rounded
from pairloom.session import materialise

CTES["finite"] = "SELECT vec_id, pos, v FROM tensors WHERE isfinite(v)"
CTES["zeroed"] = "SELECT vec_id, pos, CASE WHEN isfinite(v) THEN v ELSE 0 END AS v FROM tensors"
CTES["emb_rows"] = """
    SELECT s.user_embedding_id, s.pos, a.vals FROM supports s JOIN latents a ON s.preferred_uid = a.uid"""
CTES["raw_cells"] = "SELECT vec_id, pos, CAST(v AS DOUBLE) AS v FROM cells"


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


# --- embeddings ----------------------------------------------------------------------------------


@query(
    "p17_embedding_validation",
    """SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'ragged_emb' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'empty_emb' WHEN 3 THEN 'emb_width'
                     WHEN 4 THEN 'missing_emb' END AS reason FROM latents""",
)
def p17(spark, sf):
    v = F.col("vals")
    kind = F.col("vec_id") % 6
    emb = (
        F.when(kind == 0, F.array(v, F.slice(v, 1, 3)))
        .when(kind == 1, F.array(v, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))))
        .when(kind == 2, F.array().cast("array<array<float>>"))
        .when(kind == 3, F.array(F.slice(v, 1, 3), F.slice(v, 2, 3)))
        .when(kind == 5, F.array(v, v))
    )
    rows = D.derive(spark, sf, "latents").withColumn("emb", emb)
    return rows.select("vec_id", S.embedding_ok(F.col("emb"), width=64).alias("reason"))


@query(
    "p18_last_token",
    """SELECT user_embedding_id, round(list_sum(CAST(arg_max(vals, pos) AS DOUBLE[])), 6) AS last_sum, count(*) AS emb_length
       FROM emb_rows GROUP BY ALL""",
)
def p18(spark, sf):
    rows = D.embedding_tensors(spark, sf)
    return rows.select(
        "user_embedding_id", F.round(X.total(S.last_token(F.col("emb"))), 6).alias("last_sum"), F.size("emb").alias("emb_length")
    )


@query(
    "w12_pad_and_mask",
    """SELECT user_embedding_id, batch_id, n AS mask_sum, max(n) OVER (PARTITION BY batch_id) AS padded_length,
              max(n) OVER (PARTITION BY batch_id) AS mask_length, round(s, 6) AS emb_sum
       FROM (SELECT e.user_embedding_id, (row_number() OVER (ORDER BY e.source_embedding_row_idx) - 1) // 8 AS batch_id, t.n, t.s
             FROM embs e JOIN (SELECT user_embedding_id, count(*) AS n, sum(list_sum(CAST(vals AS DOUBLE[]))) AS s FROM emb_rows GROUP BY ALL) t
             USING (user_embedding_id))""",
)
def w12(spark, sf):
    base = D.embeddings(spark, sf)
    ids = base.select("user_embedding_id", "source_embedding_row_idx")
    rows = D.embedding_tensors(spark, sf, base).join(ids, "user_embedding_id")
    rows = materialise(rows)
    padded = S.pad_and_mask(S.batch_ids(rows, "source_embedding_row_idx", 8))
    total = F.aggregate("emb", F.lit(0.0), lambda acc, row: acc + X.total(row))
    return padded.select(
        "user_embedding_id", "batch_id",
        F.aggregate("mask", F.lit(0), lambda acc, m: acc + m).alias("mask_sum"),
        F.size("emb").alias("padded_length"),
        F.size("mask").alias("mask_length"),
        F.round(total, 6).alias("emb_sum"),
    )


# --- latent manifests ----------------------------------------------------------------------------


@query(
    "p23_stored_statistics",
    f"""SELECT vec_id, {_r('CASE WHEN vec_id % 3 = 0 THEN -1.5 ELSE lo END', '"min"')}, {_r('CASE WHEN vec_id % 3 = 0 THEN 1.5 ELSE hi END', '"max"')},
               {_r('CASE WHEN vec_id % 3 = 0 THEN 0.25 ELSE m END', '"mean"')}, {_r('CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE s END', '"std"')}
        FROM (SELECT vec_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM raw_cells GROUP BY ALL)""",
)
def p23(spark, sf):
    stored = F.struct(F.lit(-1.5).alias("min_value"), F.lit(1.5).alias("max"), F.lit(0.25).alias("mean_value"), F.lit(0.5).alias("std"))
    rows = D.latents(spark, sf).withColumn("stats", F.when(F.col("vec_id") % 3 == 0, stored))
    out = rows.select("vec_id", L.bundle_stats(rows).alias("s")).select("vec_id", "s.*")
    return out.select("vec_id", *rounded("min", "max", "mean", "std"))


@query(
    "p24_bundle_fields",
    """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN concat('u', vec_id) ELSE uid END AS uid, uid AS file_uid,
              CASE WHEN vec_id % 3 = 0 THEN true WHEN vec_id % 3 = 1 THEN false END AS scaled,
              CASE WHEN vec_id % 4 = 0 THEN 'src' WHEN vec_id % 4 = 1 THEN 'orig' END AS source_image_path FROM latents""",
)
def p24(spark, sf):
    n = F.col("vec_id")
    rows = D.derive(spark, sf, "latents").select(
        "vec_id", "latent_path",
        F.when(n % 2 == 0, F.concat(F.lit("u"), n.cast("string"))).alias("uid"),
        F.when(n % 3 == 0, F.lit(" Yes")).alias("scaled"),
        F.when(n % 3 == 1, F.lit(0)).alias("apply_scaling"),
        F.when(n % 4 == 0, "src").alias("source_image_path"),
        F.when(n % 4 < 2, "orig").alias("original_image_path"),
    )
    return rows.select(
        "vec_id", L.resolve_uid(rows).alias("uid"), L.resolve_uid(rows, prefer_file_name=True).alias("file_uid"),
        L.resolve_scaled(rows).alias("scaled"), L.resolve_source_path(rows).alias("source_image_path"),
    )


@query(
    "a12_duplicate_uids",
    """SELECT uid, latent_path, min(latent_path) OVER (PARTITION BY uid) AS first_path,
              row_number() OVER (PARTITION BY uid ORDER BY latent_path) > 1 AS is_duplicate FROM latent_copies""",
)
def a12(spark, sf):
    return L.mark_duplicates(D.derive(spark, sf, "latent_copies")).select("uid", "latent_path", "first_path", "is_duplicate")


@query(
    "a12_latent_manifest",
    f"""SELECT l.uid, l.latent_path, '4x4x4' AS shape, l.scaled, l.latent_semantics, k.path AS uid_to_path_value, u.n AS num_occurrences,
               {_r('s.m', '"mean"')}, {_r('s.d', '"std"')}
        FROM latents l LEFT JOIN known_paths k USING (uid) LEFT JOIN uid_counts u USING (uid)
        JOIN (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS d FROM raw_cells GROUP BY ALL) s USING (vec_id)""",
)
def a12_manifest(spark, sf):
    from pairloom.operators import manifest as M

    paths = D.derive(spark, sf, "paths").filter(F.col("path").isNotNull())
    meta = M.compact_meta(M.uid_counts(M.sightings(D.derive(spark, sf, "prefs"))))
    rows = L.build_manifest(D.latents(spark, sf), paths, meta)
    return rows.select(
        "uid", "latent_path", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "scaled", "latent_semantics",
        "uid_to_path_value", F.col("uid_meta.num_occurrences").alias("num_occurrences"), *rounded("mean", "std"),
    )


_CONTRACT = {"shape": (4, 4, 4), "semantics": "raw_latent", "scaled": False}


@query(
    "p26_latent_contract",
    """SELECT vec_id, CASE WHEN scaled THEN 'scaled' WHEN latent_semantics <> 'raw_latent' THEN 'latent_semantics'
                     WHEN vec_id % 9 = 0 THEN 'shape' END AS reason FROM latents""",
)
def p26(spark, sf):
    shape = F.when(F.col("vec_id") % 9 == 0, F.array(F.lit(4), F.lit(16))).otherwise(F.col("shape"))
    rows = D.latents(spark, sf).withColumn("shape", shape)
    return rows.select("vec_id", L.contract_reason(rows, **_CONTRACT).alias("reason"))


@query(
    "p27_shape_policy",
    """SELECT vec_id, vec_id % 9 > 0 AS shape_match, CASE WHEN vec_id % 9 = 0 THEN 'shape mismatch for ' || uid END AS warning FROM latents""",
)
def p27(spark, sf):
    shape = F.when(F.col("vec_id") % 9 == 0, F.array(F.lit(4), F.lit(16))).otherwise(F.col("shape"))
    rows = D.latents(spark, sf).withColumn("shape", shape)
    return L.shape_check(rows, (4, 4, 4)).select("vec_id", "shape_match", "warning")


@query(
    "p28_expected_size",
    """SELECT event_id, CAST(ceil((256 + event_id % 900) / 42.67) AS BIGINT) AS h, CAST(ceil((256 + event_id % 700) / 42.67) AS BIGINT) AS w,
              CAST(32 * ceil((256 + event_id % 900) / 42.67) AS BIGINT) AS pre_h FROM events""",
)
def p28(spark, sf):
    n = F.col("event_id")
    height, width = 256 + n % 900, 256 + n % 700
    rows = D.table(spark, sf, "events").select(
        "event_id", L.expected_spatial(height, width, 42.67).alias("s"), L.preprocess_size(height, width, 42.67).alias("p")
    )
    return rows.select("event_id", "s.h", "s.w", F.col("p.h").alias("pre_h"))


# --- tensor statistics ----------------------------------------------------------------------------


@query(
    "a17_basic_stats",
    f"""SELECT vec_id, {_r('min(v)', '"min"')}, {_r('max(v)', '"max"')}, {_r('avg(v)', '"mean"')}, {_r('stddev_pop(v)', '"std"')}
        FROM raw_cells GROUP BY ALL""",
)
def a17(spark, sf):
    rows = D.latents(spark, sf).select("vec_id", L.basic_stats(F.col("vals")).alias("s")).select("vec_id", "s.*")
    return rows.select("vec_id", *rounded("min", "max", "mean", "std"))


@query(
    "a18_full_stats",
    f"""SELECT vec_id, count(*) AS numel, count(*) FILTER (isfinite(v)) AS finite_count, count(*) FILTER (isnan(v)) AS nan_count,
               count(*) FILTER (v = 'Infinity'::DOUBLE AND NOT isnan(v)) AS posinf_count, count(*) FILTER (v = '-Infinity'::DOUBLE) AS neginf_count,
               {_r("count(*) FILTER (isfinite(v)) / count(*)", 'finite_fraction')},
               {_r('avg(v) FILTER (isfinite(v))', '"mean"')}, {_r('stddev_pop(CASE WHEN isfinite(v) THEN v END)', '"std"')},
               {_r('min(v) FILTER (isfinite(v))', '"min"')}, {_r('max(v) FILTER (isfinite(v))', '"max"')},
               {_r('avg(abs(v)) FILTER (isfinite(v))', 'abs_mean')}, {_r('sqrt(avg(CASE WHEN isfinite(v) THEN v * v END))', 'rms')},
               {_r('sqrt(sum(CASE WHEN isfinite(v) THEN v * v END))', 'l2_norm')} FROM tensors GROUP BY ALL""",
)
def a18(spark, sf):
    rows = Q.with_full_stats(D.bad_tensors(spark, sf).select("vec_id", "vals"))
    return rows.select(
        "vec_id", "numel", "finite_count", "nan_count", "posinf_count", "neginf_count",
        *rounded("finite_fraction", "mean", "std", "min", "max", "abs_mean", "rms", "l2_norm"),
    )


@query(
    "a19_finite_flags",
    """SELECT vec_id, bool_or(isnan(v)) AS has_nan, bool_or(isinf(v)) AS has_inf, bool_and(isfinite(v)) AS all_finite FROM tensors GROUP BY ALL""",
)
def a19(spark, sf):
    return D.bad_tensors(spark, sf).select("vec_id", Q.finite_flags(F.col("vals")).alias("f")).select("vec_id", "f.*")


@query(
    "a20_quantiles",
    "SELECT label, "
    + ", ".join(_r(f"quantile_cont(v, {q})", n) for n, q in C.QUANTILES.items())
    + """ FROM (SELECT f.v, e.label::BIGINT AS label FROM finite f JOIN embeddings e USING (vec_id)) GROUP BY ALL""",
)
def a20(spark, sf):
    labels = D.table(spark, sf, "embeddings").select("vec_id", "label")
    rows = D.bad_tensors(spark, sf).select("vec_id", "vals").join(labels, "vec_id")
    return Q.quantiles(rows, ["label"]).select("label", *rounded(*C.QUANTILES))


@query(
    "a20_quantiles_per_tensor",
    "SELECT vec_id, " + ", ".join(_r(f"quantile_cont(v, {q})", n) for n, q in C.QUANTILES.items()) + " FROM finite GROUP BY ALL",
)
def a20_rows(spark, sf):
    return Q.with_quantiles(D.bad_tensors(spark, sf).select("vec_id", "vals")).select("vec_id", *rounded(*C.QUANTILES))


@query(
    "a21_channel_summary",
    f"SELECT pos // 16 AS channel, {_r('avg(v)', 'channel_mean')}, {_r('stddev_pop(v)', 'channel_std')} FROM zeroed GROUP BY ALL",
)
def a21_channel(spark, sf):
    return Q.channel_summary(D.bad_tensors(spark, sf)).select("channel", *rounded("channel_mean", "channel_std"))


@query(
    "a21_spatial_summary",
    f"SELECT pos % 16 AS position, {_r('avg(v)', 'spatial_mean')}, {_r('stddev_pop(v)', 'spatial_std')} FROM zeroed GROUP BY ALL",
)
def a21_spatial(spark, sf):
    return Q.spatial_summary(D.bad_tensors(spark, sf)).select("position", *rounded("spatial_mean", "spatial_std"))


@query(
    "a21_summary_of_channels",
    "SELECT "
    + ", ".join(
        _r(f"{fn}({c})", f"{c}_{n}")
        for c in ("channel_mean", "channel_std")
        for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
    )
    + " FROM (SELECT pos // 16 AS channel, avg(v) AS channel_mean, stddev_pop(v) AS channel_std FROM zeroed GROUP BY ALL)",
)
def a21_summary(spark, sf):
    out = Q.summary_of(Q.channel_summary(D.bad_tensors(spark, sf)), ["channel_mean", "channel_std"])
    return out.select(*rounded(*out.columns))


@query("a22_sample_norms", f"SELECT vec_id, {_r('sqrt(sum(v * v))', 'l2_norm')} FROM zeroed GROUP BY ALL")
def a22(spark, sf):
    return D.bad_tensors(spark, sf).select("vec_id", F.round(X.l2_norm(X.zero_bad(F.col("vals"))), 6).alias("l2_norm"))


_GROUPED = "(SELECT f.v, CASE WHEN e.label < 5 THEN 'prior' ELSE 'stored' END AS grp FROM finite f JOIN embeddings e USING (vec_id))"


@query(
    "a23_shared_histogram",
    f"""SELECT b.bin, {_r('lo + (hi - lo) / 80 * b.bin', 'bin_left')}, {_r('lo + (hi - lo) / 80 * (b.bin + 1)', 'bin_right')},
               coalesce(c.p, 0) AS prior_count, coalesce(c.s, 0) AS precomputed_count
        FROM (SELECT range AS bin FROM range(80)) b CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM {_GROUPED})
        LEFT JOIN (SELECT least(CAST(floor((v - lo) / (hi - lo) * 80) AS BIGINT), 79) AS bin, count(*) FILTER (grp = 'prior') AS p,
                          count(*) FILTER (grp = 'stored') AS s
                   FROM {_GROUPED} CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM {_GROUPED}) GROUP BY 1) c USING (bin)""",
)
def a23(spark, sf):
    labels = D.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") < 5, "prior").otherwise("stored").alias("grp"))
    rows = D.bad_tensors(spark, sf).select("vec_id", "vals").join(labels, "vec_id")
    out = Q.shared_histogram(rows, "grp", ("prior", "stored"))
    return out.select("bin", *rounded("bin_left", "bin_right"), "prior_count", "precomputed_count")


_RUNNING = f"""count(*) AS total_count, {_r('min(v)', 'min_value')}, {_r('max(v)', 'max_value')}, {_r('sum(v) / count(*)', 'mean_value')},
    {_r('sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) ** 2, 0))', 'std_value')}"""
_RUNNING_NAMES = ("min_value", "max_value", "mean_value", "std_value")


@query("a24_running_stats", f"SELECT e.label::BIGINT AS label, {_RUNNING} FROM raw_cells JOIN embeddings e USING (vec_id) GROUP BY 1")
def a24(spark, sf):
    labels = D.table(spark, sf, "embeddings").select("vec_id", "label")
    rows = D.latents(spark, sf).select("vec_id", "vals").join(labels, "vec_id")
    return Q.running_stats(rows, ["label"]).select("label", "total_count", *rounded(*_RUNNING_NAMES))


CTES["compared"] = """
    SELECT a.sample_id, concat(a.condition, '_vs_', b.condition) AS pair, CAST(a.vals AS DOUBLE[]) AS x, CAST(b.vals AS DOUBLE[]) AS y
    FROM conditions a JOIN conditions b USING (sample_id)
    JOIN (VALUES {pairs}) p(l, r) ON a.condition = p.l AND b.condition = p.r""".format(
    pairs=", ".join(f"('{a}', '{b}')" for a, b in C.CONDITION_PAIRS)
)
_PAIR_SQL = f"""
    SELECT sample_id, pair, true AS same_shape, {_r('list_distance(x, y)', 'l2_norm')},
           {_r('list_distance(x, y) / (sqrt(list_inner_product(x, x)) + 1e-12)', 'relative_delta_norm')},
           {_r('mad', 'mean_abs_diff')}, {_r('mx', 'max_abs_diff')}, {_r('list_distance(x, y) / sqrt(len(x))', 'rmse')},
           {_r('list_cosine_similarity(x, y)', 'cosine_similarity')}
    FROM (SELECT *, list_avg(d) AS mad, list_max(d) AS mx
          FROM (SELECT *, list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])) AS d FROM compared))"""


def _compared(spark, sf):
    return context.compare_conditions(D.derive(spark, sf, "conditions"))


@query("a25_pairwise_metrics", _PAIR_SQL)
def a25(spark, sf):
    return _compared(spark, sf).select(
        "sample_id", "pair", "same_shape",
        *rounded("l2_norm", "relative_delta_norm", "mean_abs_diff", "max_abs_diff", "rmse", "cosine_similarity"),
    )


@query("j16_condition_pairs", "SELECT pair, count(*) AS n_samples FROM compared GROUP BY ALL")
def j16(spark, sf):
    return _compared(spark, sf).groupBy("pair").agg(F.count(F.lit(1)).alias("n_samples"))


@query("a31_near_identical", f"SELECT sample_id, l2_norm FROM ({_PAIR_SQL}) WHERE pair = 'zero_user_vs_real_user' AND l2_norm <= 1.3")
def a31(spark, sf):
    return context.near_identical(_compared(spark, sf), threshold=1.3).select("sample_id", *rounded("l2_norm"))


@query(
    "a26_residual_summary",
    f"""SELECT coalesce(module_path, 'all') AS module_path, count(*) AS num_calls, {_r('max(residual_ratio)', 'max_residual_ratio')},
               {_r('avg(residual_ratio)', 'mean_residual_ratio')},
               CASE WHEN module_path IS NOT NULL THEN {_r('arg_max(checkpoint_user_scale, event_id)', 'x').replace(' AS x', '')} END AS checkpoint_user_scale,
               CASE WHEN module_path IS NOT NULL THEN {_r('arg_max(inference_user_scale, event_id)', 'x').replace(' AS x', '')} END AS inference_user_scale
        FROM residuals GROUP BY ROLLUP (module_path)""",
)
def a26(spark, sf):
    out = Q.residual_summary(D.derive(spark, sf, "residuals"), order="event_id")
    return out.select(
        "module_path", "num_calls", *rounded("max_residual_ratio", "mean_residual_ratio", "checkpoint_user_scale", "inference_user_scale")
    )


_MSE = lambda a: f"list_distance(CAST({a} AS DOUBLE[]), CAST(t AS DOUBLE[])) ** 2 / len(t)"
CTES["errors"] = f"""
    SELECT sample_id, {_MSE('a')} AS train_pref_err, {_MSE('b')} AS train_dispref_err, {_MSE('c')} AS ref_pref_err, {_MSE('d')} AS ref_dispref_err
    FROM (SELECT sample_id, any_value(vals) FILTER (condition = 'base') AS a, any_value(vals) FILTER (condition = 'branch_off') AS b,
                 any_value(vals) FILTER (condition = 'zero_user') AS c, any_value(vals) FILTER (condition = 'zero_user_zero_mask') AS d,
                 any_value(vals) FILTER (condition = 'real_user') AS t FROM conditions GROUP BY ALL)"""
CTES["scored_errors"] = """
    SELECT *, ln(1 + exp(-score)) AS loss FROM (
        SELECT *, (ref_pref_err - train_pref_err) - (ref_dispref_err - train_dispref_err) AS score FROM errors)"""
_ERRORS = ("train_pref_err", "train_dispref_err", "ref_pref_err", "ref_dispref_err", "score", "loss")


def _predictions(spark, sf):
    names = {"base": "train_pref", "branch_off": "train_dispref", "zero_user": "ref_pref", "zero_user_zero_mask": "ref_dispref", "real_user": "target"}
    rows = D.derive(spark, sf, "conditions").groupBy("sample_id").agg(
        *[F.any_value(F.when(F.col("condition") == c, F.col("vals")), True).alias(n) for c, n in names.items()]
    )
    return R.preference_errors(rows)


@query("a27_preference_scores", "SELECT sample_id, " + ", ".join(_r(c, c, 8) for c in _ERRORS) + " FROM scored_errors")
def a27(spark, sf):
    rows = R.with_preference_loss(_predictions(spark, sf))
    return rows.select("sample_id", *rounded(*_ERRORS, digits=8))


@query("a27_preference_loss", "SELECT count(*) AS n_samples, " + ", ".join(_r(f"avg({c})", c, 8) for c in _ERRORS) + " FROM scored_errors")
def a27_mean(spark, sf):
    return R.preference_loss(_predictions(spark, sf)).select("n_samples", *rounded(*_ERRORS, digits=8))


@query(
    "p35_scaling_variants",
    "SELECT vec_id, variant, "
    + _r("sum(x)", "total")
    + " FROM (SELECT vec_id, unnest([{ls}]) AS variant, unnest([{xs}]) AS x FROM (SELECT vec_id, (v + 1) / 42 AS s FROM raw_cells)) GROUP BY ALL".format(
        ls=", ".join(f"'{n}'" for n in ("scaled", "unscaled", "x42", "x10", "x2", "div2")), xs="s, s * 42 - 1, s * 42, s * 10, s * 2, s / 2"
    ),
)
def p35(spark, sf):
    rows = D.latents(spark, sf).select("vec_id", X.add_one_div_42(F.col("vals")).alias("vals"))
    cells = [F.struct(F.lit(n).alias("variant"), X.total(X.variant(F.col("vals"), n)).alias("total")) for n in X.VARIANTS]
    return rows.select("vec_id", F.inline(F.array(*cells))).select("vec_id", "variant", *rounded("total"))


CTES["channel_moments"] = """
    SELECT e.label < 5 AS is_target, pos // 16 AS channel, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS d
    FROM raw_cells JOIN embeddings e USING (vec_id) GROUP BY ALL"""


@query(
    "p36_channel_calibration",
    f"""SELECT r.vec_id, r.pos, {_r('(r.v - s.m) / s.d * t.d + t.m', 'v')} FROM raw_cells r
        JOIN (SELECT * FROM channel_moments WHERE NOT is_target) s ON s.channel = r.pos // 16
        JOIN (SELECT * FROM channel_moments WHERE is_target) t ON t.channel = r.pos // 16""",
)
def p36(spark, sf):
    rows = D.latents(spark, sf).join(D.table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    source = Q.channel_summary(rows.filter(F.col("label") >= 5))
    target = Q.channel_summary(rows.filter(F.col("label") < 5))
    moved = Q.calibrate_channels(rows.select("vec_id", "vals", "shape"), source, target)
    return moved.select("vec_id", F.posexplode("vals").alias("pos", "v")).select("vec_id", "pos", *rounded("v"))


# --- judge answers ---------------------------------------------------------------------------------

CTES["parsed"] = """
    SELECT *, TRY_CAST(trim(string_split(answer_first, 'Prediction of user preference: ')[-1]) AS BIGINT) AS first,
           TRY_CAST(trim(string_split(answer_second, 'Prediction of user preference: ')[-1]) AS BIGINT) AS second FROM judged"""
CTES["scored"] = """
    SELECT *, CASE WHEN answer_first IS NULL THEN -3 WHEN first IS NULL OR second IS NULL THEN -2 WHEN first = 1 AND second = 2 THEN 1
                   WHEN first = 2 AND second = 1 THEN 0 ELSE -1 END::BIGINT AS score FROM parsed"""


@query(
    "p30_parse_answers",
    """SELECT event_id, first AS choice_first, second AS choice_second,
              CASE WHEN answer_first LIKE '%1%' THEN 1 WHEN answer_first LIKE '%2%' THEN 2 END::BIGINT AS loose_first FROM parsed""",
)
def p30(spark, sf):
    return D.derive(spark, sf, "judged").select(
        "event_id",
        J.parse_answer(F.col("answer_first")).alias("choice_first"),
        J.parse_answer(F.col("answer_second")).alias("choice_second"),
        J.parse_answer_loose(F.col("answer_first")).alias("loose_first"),
    )


def _scored(spark, sf, **options):
    return J.score_answers(D.derive(spark, sf, "judged"), "answer_first", "answer_second", F.col("answer_first").isNull(), **options)


@query("p31_scores", "SELECT event_id, score, CASE WHEN score = -2 THEN -3 ELSE score END AS folded FROM scored")
def p31(spark, sf):
    rows = _scored(spark, sf)
    folded = J.score_pair(F.col("choice_first"), F.col("choice_second"), F.col("answer_first").isNull(), fold_unparsed=True)
    return rows.select("event_id", "score", folded.alias("folded"))


@query("a13_score_distribution", "SELECT split, score, count(*) AS n_rows FROM scored GROUP BY ALL")
def a13(spark, sf):
    return J.score_distribution(_scored(spark, sf), ["split"])


@query(
    "a13_win_rate",
    f"""SELECT split, count(*) AS n_rows, count(*) FILTER (score = 1) AS wins, count(*) FILTER (score = 0) AS losses,
               {_r("count(*) FILTER (score = 1) / nullif(count(*) FILTER (score IN (0, 1)), 0)", 'win_rate')},
               {_r("count(*) FILTER (score IN (0, 1)) / nullif(count(*) FILTER (score >= -1), 0)", 'consistent_share')} FROM scored GROUP BY ALL""",
)
def a13_rate(spark, sf):
    return J.win_rate(_scored(spark, sf), ["split"]).select("split", "n_rows", "wins", "losses", *rounded("win_rate", "consistent_share"))


def _coin(i: str) -> str:
    return f"substr(md5(concat_ws('|', '0', user_embedding_id, {i})), 1, 1) >= '8'"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_NL = "chr(10)"
_EXAMPLES = lambda body, last: f"(SELECT user_embedding_id, string_agg({body}, {_NL} || {_NL} ORDER BY pos) AS e FROM supports {last} GROUP BY ALL)"
_HEAD = f"'Pair ' || (pos + 1) || ':' || {_NL}"
_PLAIN = f"{_HEAD} || 'Caption: ' || caption || {_NL} || 'Preferred: <image>' || {_NL} || 'Dispreferred: <image>'"
_RANDOM = (
    f"{_HEAD} || 'Image 1: <image>' || {_NL} || 'Image 2: <image>' || {_NL} || '{C.ANSWER_MARKER}' || CASE WHEN {_coin('pos')} THEN '1' ELSE '2' END"
)
_QUESTION = f"{_sql_text(J.TASK)} || {_NL} || 'Image 1: <image>' || {_NL} || 'Image 2: <image>' || {_NL} || {_sql_text(J.ANSWER_FORMAT)}"
_GAP = f" || {_NL} || {_NL} || "


@query(
    "p32_few_shot_prompts",
    f"""SELECT user_embedding_id, {_sql_text(J.INTRO)}{_GAP}p.e AS plain,
               {_sql_text(J.INTRO)}{_GAP}q.e{_GAP}{_sql_text(J.REASONING)}{_GAP}{_QUESTION} AS randomised
        FROM {_EXAMPLES(_PLAIN, '')} p JOIN {_EXAMPLES(_RANDOM, 'WHERE pos < 3')} q USING (user_embedding_id)""",
)
def p32(spark, sf):
    pairs, key = F.col("support_pairs"), F.col("user_embedding_id")
    return D.embeddings(spark, sf).select(
        "user_embedding_id",
        J.few_shot_prompt(pairs, key).alias("plain"),
        J.few_shot_prompt(pairs, key, held_out=True, with_caption=False, reasoning=True, randomise=True).alias("randomised"),
    )


def _images(last: str) -> str:
    swap = f"pos = 3 AND {last}"
    return f"""string_agg(CASE WHEN ({swap}) OR (pos < 3 AND NOT {_coin('pos')}) THEN dispreferred_uid || ',' || preferred_uid
                               ELSE preferred_uid || ',' || dispreferred_uid END, ',' ORDER BY pos)"""


@query(
    "p33_both_order_messages",
    f"""SELECT user_embedding_id, 2::BIGINT AS n_messages, 1 + 5 * 3 + 2 + 3::BIGINT AS n_parts, {_images('false')} AS images_first,
               {_images('true')} AS images_second, string_agg(CASE WHEN pos < 3 THEN CASE WHEN {_coin('pos')} THEN '1' ELSE '2' END END, ',' ORDER BY pos) AS labels
        FROM supports GROUP BY ALL""",
)
def p33(spark, sf):
    pairs, key = F.col("support_pairs"), F.col("user_embedding_id")
    rows = D.embeddings(spark, sf).select(
        "user_embedding_id", J.judge_messages(pairs, key, False).alias("a"), J.judge_messages(pairs, key, True).alias("b")
    )
    parts = lambda m: F.element_at(m, 2)["content"]
    images = lambda m: F.array_join(F.transform(parts(F.col(m)), lambda p: p["image_uid"]), ",")
    labels = F.filter(F.transform(parts(F.col("a")), lambda p: p["text"]), lambda t: t.startswith(C.ANSWER_MARKER))
    return rows.select(
        "user_embedding_id", F.size("a").alias("n_messages"), F.size(parts(F.col("a"))).alias("n_parts"), images("a").alias("images_first"),
        images("b").alias("images_second"), F.array_join(F.transform(labels, lambda t: F.right(t, F.lit(1))), ",").alias("labels"),
    )


@query(
    "p34_message_validation",
    "SELECT user_embedding_id, true AS valid, false AS broken FROM supports GROUP BY ALL",
)
def p34(spark, sf):
    pairs, key = F.col("support_pairs"), F.col("user_embedding_id")
    rows = D.embeddings(spark, sf).select("user_embedding_id", J.judge_messages(pairs, key, False).alias("m"))
    spoilt = F.transform("m", lambda m: m.withField("content", F.transform(m["content"], lambda p: p.withField("text", F.lit("x")))))
    return rows.select("user_embedding_id", J.messages_valid(F.col("m")).alias("valid"), J.messages_valid(spoilt).alias("broken"))


# --- classifier -------------------------------------------------------------------------------------

CTES["logits"] = """
    SELECT vec_id, class_id::BIGINT AS class_id, batch_id, generate_subscripts(vals, 1) - 1 AS j, CAST(unnest(vals) AS DOUBLE) AS z FROM classified"""
CTES["class_rows"] = """
    SELECT vec_id, batch_id, ln(sum(exp(z))) - max(CASE WHEN j = class_id THEN z END) AS loss,
           max(CASE WHEN j = class_id THEN exp(z) END) / sum(exp(z)) AS desired_prob,
           1 + count(*) FILTER (z > own OR (z = own AND j < class_id)) AS rank
    FROM (SELECT *, max(CASE WHEN j = class_id THEN z END) OVER (PARTITION BY vec_id) AS own FROM logits) GROUP BY ALL"""


def _classified(spark, sf):
    rows = D.derive(spark, sf, "classified").withColumnRenamed("vals", "logits")
    return R.classifier_metrics(rows)


@query("a14_cross_entropy", f"SELECT vec_id, {_r('loss', 'loss')}, {_r('desired_prob', 'desired_prob')} FROM class_rows")
def a14(spark, sf):
    return _classified(spark, sf).select("vec_id", *rounded("loss", "desired_prob"))


@query(
    "a15_top_k_accuracy",
    "SELECT count(*) AS n_rows, " + ", ".join(_r(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)", f"top{k}") for k in C.TOP_K) + " FROM class_rows",
)
def a15(spark, sf):
    tops = [f"top{k}" for k in C.TOP_K]
    rows = _classified(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(t).alias(t) for t in tops])
    return rows.select("n_rows", *rounded(*tops))


@query(
    "a16_mean_of_batch_means",
    f"""SELECT count(*) AS num_batches, {_r('avg(loss)', 'loss')}, {_r('avg(top1)', 'top1')}, {_r('avg(desired_prob)', 'desired_prob')} FROM (
            SELECT batch_id, avg(loss) AS loss, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(desired_prob) AS desired_prob
            FROM class_rows GROUP BY batch_id ORDER BY batch_id LIMIT 10)""",
)
def a16(spark, sf):
    out = R.mean_of_batch_means(_classified(spark, sf), ["loss", "top1", "desired_prob"], max_batches=10)
    return out.select("num_batches", *rounded("loss", "top1", "desired_prob"))


@query(
    "a18_group_stats",
    f"""SELECT vec_id % 10 AS part, count(*) AS total_count, count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count,
              count(*) FILTER (isfinite(v)) AS finite_count, min(v) FILTER (isfinite(v)) AS min_value, max(v) FILTER (isfinite(v)) AS max_value,
              {_r('avg(v) FILTER (isfinite(v))', 'mean_value')}, {_r('stddev_pop(v) FILTER (isfinite(v))', 'std_value')},
              {_r('avg(abs(v)) FILTER (isfinite(v))', 'mean_abs')}, {_r('sqrt(sum(v * v) FILTER (isfinite(v)))', 'l2_norm')}
       FROM tensors GROUP BY ALL""",
)
def a18_group(spark, sf):
    rows = D.bad_tensors(spark, sf).withColumn("part", F.col("vec_id") % 10)
    out = Q.group_stats(rows, ["part"])
    exact = ["part", "total_count", "nan_count", "inf_count", "finite_count", "min_value", "max_value"]
    return out.select(*exact, *rounded("mean_value", "std_value", "mean_abs", "l2_norm"))


@query(
    "a18_shifted_stats",
    f"""SELECT label::BIGINT AS label, count(*) AS finite_count, {_r('avg(v)', 'mean_value')}, {_r('stddev_pop(v)', 'std_value')}
        FROM (SELECT label, unnest(embedding)::DOUBLE + 100000 * (1 + label) AS v FROM embeddings) GROUP BY label""",
)
def a18_shifted(spark, sf):
    shift = F.lit(100000.0) * (1 + F.col("label"))
    rows = D.table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double") + shift).alias("vals"))
    return Q.group_stats(rows, ["label"]).select("label", "finite_count", *rounded("mean_value", "std_value"))


@query(
    "p33_profile_messages",
    """SELECT row_idx, 6::BIGINT AS n_parts, true AS valid, concat('likes ', caption) AS description,
              CASE WHEN row_idx % 2 = 0 THEN concat(preferred_uid, ',', dispreferred_uid) ELSE concat(dispreferred_uid, ',', preferred_uid) END AS images
       FROM pool""",
)
def p33_profile(spark, sf):
    said = F.concat(F.lit("likes "), F.col("caption"))
    both = [J.profile_messages(said, F.col("preferred_uid"), F.col("dispreferred_uid"), swap) for swap in (False, True)]
    rows = D.pool(spark, sf).withColumn("m", F.when(F.col("row_idx") % 2 == 0, both[0]).otherwise(both[1]))
    parts = F.flatten(F.transform("m", lambda m: m["content"]))
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: p["image_uid"])
    return rows.select(
        "row_idx", F.size(parts).cast("bigint").alias("n_parts"), J.messages_valid(F.col("m")).alias("valid"),
        F.element_at(parts, 3)["text"].alias("description"), F.array_join(images, ",").alias("images"),
    )


@query(
    "l3_top_classes",
    """SELECT vec_id, string_agg(j, ',' ORDER BY z DESC, j) AS top FROM (
           SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, j) AS rn FROM logits) WHERE rn <= 4 GROUP BY ALL""",
)
def l3(spark, sf):
    top = F.array_join(X.top_classes(F.col("vals"), 4).cast("array<string>"), ",")
    return D.derive(spark, sf, "classified").select("vec_id", top.alias("top"))


# --- training log --------------------------------------------------------------------------------------


@query(
    "a28_step_windows",
    f"""SELECT (micro_step - 1) // 8 + 1 AS optimizer_step, count(*) AS accumulation_count, {_r('avg(loss)', 'loss', 9)},
               {_r('avg(grad_norm)', 'grad_norm', 9)} FROM steps GROUP BY 1""",
)
def a28(spark, sf):
    out = R.step_windows(D.derive(spark, sf, "steps"), 8, ["loss", "grad_norm"])
    return out.select("optimizer_step", "accumulation_count", *rounded("loss", "grad_norm", digits=9))


@query(
    "a29_validation_summary",
    f"""SELECT batch_size, count(*) AS val_batches, {_r('avg(loss)', 'val_loss', 9)} FROM (
            SELECT *, row_number() OVER (PARTITION BY batch_size ORDER BY micro_step) AS rn FROM steps) WHERE rn <= 20 GROUP BY ALL""",
)
def a29(spark, sf):
    out = R.validation_summary(D.derive(spark, sf, "steps"), ["loss"], "micro_step", 20, ["batch_size"])
    return out.select("batch_size", "val_batches", *rounded("val_loss", digits=9))


@query(
    "w8_running_best",
    """SELECT micro_step, round(loss, 6) AS val_loss, round(best, 6) AS best_before, best IS NULL OR loss < best AS improved FROM (
           SELECT *, min(loss) OVER (ORDER BY micro_step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
           FROM steps WHERE is_validation)""",
)
def w8(spark, sf):
    log = D.derive(spark, sf, "steps").filter("is_validation").select("micro_step", F.col("loss").alias("val_loss"))
    return R.running_best(log, "micro_step").select("micro_step", *rounded("val_loss", "best_before"), "improved")


@query(
    "w9_running_totals",
    """SELECT micro_step, CAST(sum(batch_size) OVER w AS BIGINT) AS samples_seen, max(grad_norm) OVER w AS max_grad_norm_observed,
              max(reserved_mb) OVER w AS max_mem_reserved_mb FROM steps WINDOW w AS (ORDER BY micro_step)""",
)
def w9(spark, sf):
    out = R.running_totals(D.derive(spark, sf, "steps"), "micro_step")
    return out.select("micro_step", "samples_seen", "max_grad_norm_observed", "max_mem_reserved_mb")
