"""The operators as registered queries, opN_<name>, and the plain SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.llm import bpe, chat, exact, packing, quality, secrets, sharding, simhash, spelling, suffix, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Constants of the quality rules as in quality.py; a document's windows and sketches are made by list functions.
OP1_SQL = r"""
WITH split AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^ \t-\r]')] AS lines,
           row_number() OVER () AS r
    FROM documents),
spans AS (SELECT r, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8),
windows AS (SELECT s.r, s.i, array_to_string(list_slice(w, s.i, s.i + 7), ' ') AS gram FROM spans s JOIN split USING (r)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) t(k) GROUP BY r),
counts AS (
    SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (r)),
based AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           CASE WHEN n_words > 0 THEN {'symbols': 1000 * n_symbols // n_words, 'dup_lines': 1000 * n_dup_lines // n_words,
                                       'word_length': 1000 * word_chars // n_words} END AS rates
    FROM counts),
points AS (
    SELECT lang, source, unnest(['symbols', 'dup_lines', 'word_length']) AS fence,
           unnest([rates.symbols, rates.dup_lines, rates.word_length]) AS v
    FROM based WHERE NOT base_failed),
low AS (
    SELECT lang, source, fence, CASE WHEN v < 64 THEN v
           ELSE CAST(pow(2, length(bin(v)) - 6) AS BIGINT) * (v // CAST(pow(2, length(bin(v)) - 6) AS BIGINT)) END AS v
    FROM points),
merged AS (
    SELECT 1 AS level, lang, source, fence, count(*) AS n, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.75) AS q75 FROM low GROUP BY ALL
    UNION ALL
    SELECT 2, lang, NULL, fence, count(*), quantile_disc(v, 0.25), quantile_disc(v, 0.75) FROM low GROUP BY ALL
    UNION ALL
    SELECT 3, NULL, NULL, fence, count(*), quantile_disc(v, 0.25), quantile_disc(v, 0.75) FROM low GROUP BY ALL),
pairs AS (SELECT DISTINCT lang, source, fence FROM low),
bounds AS (
    SELECT p.lang, p.source, p.fence, q25, q75, 8 * (q75 - q25) + CASE p.fence WHEN 'word_length' THEN 2500 ELSE 100 END AS reach
    FROM pairs p JOIN merged m ON m.fence = p.fence AND m.n >= 100
     AND (m.level = 3 OR m.lang IS NOT DISTINCT FROM p.lang AND (m.level = 2 OR m.source IS NOT DISTINCT FROM p.source))
    QUALIFY row_number() OVER (PARTITION BY p.lang, p.source, p.fence ORDER BY level) = 1),
out AS (
    SELECT r, count(*) AS n FROM based b JOIN bounds t ON t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source
    WHERE CASE fence WHEN 'symbols' THEN rates.symbols > q75 + reach WHEN 'dup_lines' THEN rates.dup_lines > q75 + reach
          ELSE rates.word_length > q75 + reach OR rates.word_length < q25 - reach END
    GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n IS NULL AS kept
FROM based LEFT JOIN out USING (r)
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query(
    "op2_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.with_secrets(docs).drop("text"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op10_warc")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url", "payload")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


# The added conversation holds what looks like marks and escapes.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

OP12_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (
    SELECT *, row_number() OVER same AS nth, role IS DISTINCT FROM lag(role) OVER same AS begins,
           length(replace(replace(text, '\', '\b'), '|', '\p')) AS chars,
           length(replace(replace(role, '\', '\b'), '|', '\p')) AS role_chars
    FROM rows WINDOW same AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '')) AS loss_sha256,
       sum(chars + CASE WHEN begins THEN role_chars + 17 ELSE 7 END)::BIGINT AS formatted_chars,
       sum(begins::INT)::BIGINT AS n_messages
FROM marked GROUP BY conv_id
"""


@query("op12_chat_format", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(probe)))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), slips=31)
