"""Queries of the text-preparation operators: (spark, sf_dir) -> DataFrame, and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterproof.llm import (
    chat,
    decontaminate,
    exact_dedup,
    lm,
    merkle,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality,
    simhash,
    token_counts,
    toxicity,
)
from rosterproof.llm.sample import is_held_out

#: The demonstration's key; a user passes a secret of their own.
PII_KEY = b"demonstration key, not a secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lm.scores(docs, ~is_held_out(F.col("doc_id"), 5, 1))
    return found.withColumn("held_out", is_held_out(F.col("doc_id"), 5, 1)).withColumn(
        "bits_per_byte", -F.col("score") * 3.321928094887362 / F.col("n_bytes")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_documents(docs, labels, ~is_held_out(F.col("doc_id"), 4, 2))
    return quality.scored(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_documents(docs, labels, ~is_held_out(F.col("doc_id"), 5, 0))
    return toxicity.scored(docs, model).select(
        "doc_id",
        is_held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_segments(table(spark, sf_dir, "conversations"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_lm_score,
        op3_token_counts,
        op4_simhash,
        op5_exact_dedup,
        op6_packing,
        op7_quality,
        op8_toxicity,
        op9_quotation_linking,
        op10_pseudonyms,
        op11_merkle_manifest,
        op12_mixing,
        op13_prefix_trie,
    )
}

_TEXT = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

ORACLES = {
    "op5_exact_dedup": f"""
        with t as (select doc_id::bigint as doc_id, length(coalesce(text, '')) as points,
                          {_TEXT} as norm from documents),
             r as (select *, row_number() over (partition by norm order by points desc, doc_id nulls last) as k,
                          count(*) over (partition by norm) as group_size,
                          first_value(doc_id) over (partition by norm order by points desc, doc_id nulls last) as keep_id
                   from t)
        select doc_id, keep_id, group_size, k = 1 as kept, sha256(norm) as text_sha256 from r
    """,
    "op9_quotation_linking": chat.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
