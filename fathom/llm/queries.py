"""Check queries of the training-data operators: each applies one operator to
its whole table and derives the contract's columns from what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import (
    langid,
    manifest,
    merkle,
    mixing,
    packing,
    ppm,
    quotient,
    secret_scan,
    simhash,
    sql,
    surrogates,
    templates,
    toxicity,
    variants,
)
from fathom.llm.common import documents, training_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(documents(spark, sf_dir))


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=3).select("doc_id", "fingerprint", "component_id")


@register("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", F.map_keys("proportions").alias("languages"))


@register("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(documents(spark, sf_dir))


@register("op5_secret_scans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


@register("op6_mixing_to_targets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


@register("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_recurring_lines(documents(spark, sf_dir))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


@register("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("fathom.llm.surrogateKey", "check")  # a secret of the deployment
    out = surrogates.replace_pii(documents(spark, sf_dir), key)
    return out.select("doc_id", "text", *[f"n_{k}" for k in surrogates.KINDS])


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), capacity=2048, end_id=0)


@register("op10_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_duplicates(documents(spark, sf_dir)).drop("fp")


@register("op11_toxicity")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", training_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_tokens", "passages")


@register("op12_spelling_variants", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir), damage=199)


@register("op13_merkle_manifest", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir), tampered=training_fold("doc_id", 3, 0))
