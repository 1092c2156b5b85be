"""Queries that call a model or run as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import constants as C
from pairloom.functions import tensors as X
from pairloom.operators import classify, inference, judging as J, latents as L, manifest as M, metrics as R
from pairloom.plans import derived as D
from pairloom.plans.pairs import _ASSIGNED_SQL, _image_cells, _query_rows
from pairloom.plans.registry import CTES, query, rounded
from pairloom.plans.tensors import _EXAMPLES, _GAP, _NL, _PLAIN, _RUNNING, _RUNNING_NAMES, _r, _sql_text
from pairloom.session import scratch_path
from pairloom.sources.sinks import with_shard
from pairloom.streaming import incremental

CTES["open_pairs"] = """
    SELECT user_embedding_id, CAST(substr(preferred_uid, 5) AS BIGINT) AS p, CAST(substr(dispreferred_uid, 5) AS BIGINT) AS d
    FROM supports WHERE pos = 3"""


def _stub_judge():
    """A judge that likes the image with the higher number, and sometimes fails."""

    def ask(messages):
        left, right = [int(p["image_uid"][4:]) for p in messages[-1]["content"] if p["type"] == "image"][-2:]
        if (left + right) % 7 == 0:
            raise RuntimeError("call failed")
        if (left + right) % 11 == 0:
            return "no idea"
        return f"Higher is better. Prediction of user preference: {1 if left >= right else 2}"

    return ask


@query(
    "f1_judge_batch",
    """SELECT user_embedding_id, CASE WHEN (p + d) % 7 = 0 THEN 'Inference failed' WHEN (p + d) % 11 = 0 THEN 'no idea'
              ELSE 'Higher is better. Prediction of user preference: ' || CASE WHEN p >= d THEN 1 ELSE 2 END END AS text_pref_first,
              CASE WHEN (p + d) % 7 = 0 THEN -3 WHEN (p + d) % 11 = 0 THEN -2 WHEN p > d THEN 1 WHEN p < d THEN 0 ELSE -1 END::BIGINT AS score
       FROM open_pairs""",
)
def f1(spark, sf):
    pairs, key = F.col("support_pairs"), F.col("user_embedding_id")
    rows = D.embeddings(spark, sf).select(
        "user_embedding_id",
        J.judge_messages(pairs, key, False).alias("messages_first"),
        J.judge_messages(pairs, key, True).alias("messages_second"),
    )
    return inference.judge(rows, _stub_judge(), ["user_embedding_id"]).select("user_embedding_id", "text_pref_first", "score")


def _stub_embedder():
    def run(prompts):
        return [(f"profile of {len(p)} characters", [[float(len(p)), 1.0], [float(p.count("\n")), 2.0]]) for p in prompts]

    return run


@query(
    "f2_embed_batch",
    f"""SELECT user_embedding_id, 'profile of ' || length(prompt) || ' characters' AS text, 2::BIGINT AS emb_length,
               CAST(length(prompt) - length(replace(prompt, chr(10), '')) AS DOUBLE) AS last_value
        FROM (SELECT user_embedding_id, {_sql_text(J.INTRO)}{_GAP}p.e AS prompt FROM {_EXAMPLES(_PLAIN, '')} p)""",
)
def f2(spark, sf):
    prompt = J.few_shot_prompt(F.col("support_pairs"), F.col("user_embedding_id"))
    rows = D.embeddings(spark, sf).select("user_embedding_id", prompt.alias("prompt"))
    out = inference.embed(rows, _stub_embedder())
    last = F.element_at(F.element_at("emb", -1), 1).cast("double")
    return out.select("user_embedding_id", "text", F.size("emb").alias("emb_length"), last.alias("last_value"))


def _stub_encoder():
    def run(payloads):
        out = []
        for payload in payloads:
            data = bytes(payload)
            if len(data) % 13 == 0:
                raise ValueError("unlucky payload")
            out.append([[len(data), data[0]], [data[-1], 1.0]])
        return out

    return run


@query(
    "f3_encode_batch",
    f"""SELECT uid, CASE WHEN strlen(payload) % 13 = 0 THEN 'unlucky payload' END AS error,
               CASE WHEN strlen(payload) % 13 > 0 THEN '2x2' END AS shape,
               CASE WHEN strlen(payload) % 13 > 0 THEN round((strlen(payload) + ascii(payload) + ascii(right(payload, 1)) + 1) / 4, 6) END AS "mean"
        FROM (SELECT uid, arg_min(payload, (split_rank, row_idx, side)) AS payload FROM (
            SELECT *, CASE WHEN side = 0 AND row_idx % 3 > 0 THEN concat(caption, CAST(row_idx AS STRING)) END AS payload FROM sightings)
            WHERE payload IS NOT NULL GROUP BY uid)""",
)
def f3(spark, sf):
    images = M.materialise_images(_image_cells(spark, sf)).filter(F.col("payload").isNotNull())
    out = inference.encode(with_shard(images).select("uid", "payload"), _stub_encoder(), batch_size=1)
    stats = F.when(F.col("error").isNull(), L.basic_stats(F.col("vals")))
    shape = F.array_join(F.col("shape").cast("array<string>"), "x")
    return out.select("uid", "error", shape.alias("shape"), F.round(stats["mean"], 6).alias("mean"))


@query("f4_user_classifier")
def f4(spark, sf):
    rows = classify.with_features(D.derive(spark, sf, "classified"))
    train, test = classify.split_rows(rows, "vec_id")
    model = classify.train_classifier(train, 64, 10, hidden=[(16,), (32,)], max_iter=[15])
    scored = R.classifier_metrics(classify.predict_logits(model, test))
    return R.mean_of_batch_means(scored, ["loss", "desired_prob", "top1", "top2", "top4", "top8"])


# Least share of right answers on the test share, where guessing has a third.
LEARNED = 0.75


@query(
    "f4_learned_classes",
    """SELECT class_id::BIGINT AS class_id, count(*) FILTER (WHERE h >= 230584300921369408) AS n_train, count(*) FILTER (WHERE h < 230584300921369408) AS n_test,
              true AS learned, 0::BIGINT AS n_changed
       FROM (SELECT CASE WHEN embedding[1] >= greatest(embedding[2], embedding[3]) THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS class_id,
                    CAST(concat('0x', substr(md5('0|' || vec_id), 1, 15)) AS BIGINT) AS h FROM embeddings) GROUP BY class_id""",
)
def f4_learned(spark, sf):
    # Classes that the vectors tell: which of the first three values is the largest.
    e = [F.col("vals")[i] for i in range(3)]
    of = F.when(e[0] >= F.greatest(e[1], e[2]), 0).when(e[1] >= e[2], 1).otherwise(2)
    rows = D.derive(spark, sf, "classified").select("vec_id", "vals").withColumn("class_id", of)
    train, test = classify.split_rows(classify.with_features(rows), "vec_id")

    def guesses(name):
        scored = classify.predict_logits(classify.train_classifier(train, 64, 3, hidden=[(8,)], max_iter=[20]), test)
        return scored.select("vec_id", "class_id", (F.array_position("logits", F.array_max("logits")) - 1).alias(name))

    both = guesses("guess").join(guesses("again").drop("class_id"), "vec_id")
    right = F.avg((F.col("guess") == F.col("class_id")).cast("int")) >= LEARNED
    facts = both.agg(right.alias("learned"), F.count_if(F.col("guess") != F.col("again")).alias("n_changed"))
    sizes = train.select("class_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select("class_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = sizes.groupBy("class_id").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"))
    return counts.join(facts.withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(2)))), "class_id")


# --- streams ------------------------------------------------------------------------------------------


def _stream(spark, path: str):
    """Stream over the Parquet files at a path (a file or a folder)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


@query("x1_incremental_assignment", _ASSIGNED_SQL.format(k=1))
def x1(spark, sf):
    base = scratch_path(spark, "x1")
    rows, pool = D.base(spark, sf)
    rows.withColumn("part", F.col("shard_id") % 2).write.partitionBy("part").parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in")
    _finish(incremental.incremental_assignments(stream.drop("part"), pool, f"{base}/out", f"{base}/state"))
    return _query_rows(spark.read.parquet(f"{base}/out"))


@query("x2_running_tensor_stats", f"SELECT {_RUNNING} FROM raw_cells")
def x2(spark, sf):
    base = scratch_path(spark, "x2")
    stream = _stream(spark, f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vals")
    _finish(incremental.running_tensor_stats(stream, f"{base}/out", f"{base}/state"))
    return incremental.latest_tensor_stats(spark, f"{base}/out").select("total_count", *rounded(*_RUNNING_NAMES))


@query(
    "x3_metric_rollup",
    f"""SELECT (micro_step - 1) // 8 + 1 AS optimizer_step, count(*) AS accumulation_count, {_r('avg(loss)', 'loss', 9)} FROM steps GROUP BY 1""",
)
def x3(spark, sf):
    base = scratch_path(spark, "x3")
    events = _stream(spark, f"{sf}/events.parquet")
    log = events.select((F.col("event_id") + 1).alias("micro_step"), (F.col("value") / 100).alias("loss"))
    _finish(incremental.metric_rollup(log, 8, ["loss"], f"{base}/out", f"{base}/state"))
    return incremental.latest(spark, f"{base}/out", ["optimizer_step"]).select("optimizer_step", "accumulation_count", *rounded("loss", digits=9))


@query(
    "x2_running_quantiles",
    """SELECT point, true AS within, (SELECT count(*) FROM raw_cells) AS finite_count
       FROM (VALUES {points}) t(point)""".format(points=", ".join(f"('{n}')" for n in C.QUANTILES)),
)
def x2_quantiles(spark, sf):
    base = scratch_path(spark, "x2q")
    stream = _stream(spark, f"{sf}/embeddings.parquet").withColumnRenamed("embedding", "vals")
    _finish(incremental.running_quantiles(stream, f"{base}/out", f"{base}/state"))
    found = incremental.latest_quantiles(spark, f"{base}/out")
    entries = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(float(q)).alias("q"), F.col(n).alias("value")) for n, q in C.QUANTILES.items()])
    values = found.select("finite_count", F.inline(entries))
    # The rank of what the sketch says, counted over all values.
    cells = D.table(spark, sf, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    row = values.collect()
    counts = cells.agg(*[F.count_if(F.col("v") < r.value).alias(f"lo_{r.point}") for r in row], *[F.count_if(F.col("v") <= r.value).alias(f"hi_{r.point}") for r in row])
    listed = F.array(*[F.struct(F.lit(r.point).alias("name"), F.col(f"lo_{r.point}").alias("lo"), F.col(f"hi_{r.point}").alias("hi")) for r in row])
    ranks = counts.select(F.inline(listed))
    slack = incremental.RANK_ERROR * F.col("finite_count")
    place = F.col("q") * F.col("finite_count")
    within = (place >= F.col("lo") - slack) & (place <= F.col("hi") + slack)
    return values.join(ranks, F.col("point") == F.col("name")).select("point", within.alias("within"), "finite_count")
