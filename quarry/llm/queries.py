"""The registered queries of this subpackage: each operator over its whole table, in its contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, exact_dedup, html_extract, mixing, near_dedup, secrets, substring_dedup, topk_search, toxicity, url_filter
from quarry.plans.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    text = lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    count = lambda kind: F.size(F.filter("certain", lambda p: p["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.CERTAIN],
        F.sha2(joined("certain"), 256).alias("base_sha256"),
        joined("findings").alias("spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.codec_for(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    got = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), codec, keep=["doc_id"])
    return got.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_toxicity": op3_toxicity,
        "op4_maxscore_search": op4_maxscore_search,
        "op5_url_filter": op5_url_filter,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_source_mix": op7_source_mix,
        "op8_html_extract": op8_html_extract,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_maxscore_search": topk_search.ORACLE_SQL, "op5_url_filter": url_filter.oracle_sql(), "op10_exact_dedup": OP10_SQL}
