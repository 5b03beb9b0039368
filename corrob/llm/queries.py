"""The registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrob.llm import decontaminate, langid, packing, quotes, rules, runs, secrets, sharding, simhash, sites, spelling, token_files, urls
from corrob.llm.sql import ORACLE
from corrob.sources.shared import clear_at_exit, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """The 50k byte-level BPE, and the same vocabulary as ranks (a test compares their ids)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer())


def op4_quality_rules(spark, sf_dir):
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("score").alias("anomaly"))


def op5_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark, sf_dir):
    return simhash.clusters(table(spark, sf_dir, "documents"))


def op8_quote_threads(spark, sf_dir):
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_site_quality(spark, sf_dir):
    return sites.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark, sf_dir):
    at = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), at, tokenizer()[0])
    clear_at_exit(spark, at)
    return token_files.digest(spark, at)


def op12_periodic_runs(spark, sf_dir):
    return runs.digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_url_filter, op3_best_fit_packing, op4_quality_rules, op5_language_id, op6_decontamination,
    op7_simhash, op8_quote_threads, op9_sharding, op10_site_quality, op11_token_files, op12_periodic_runs,
    op13_spelling_variants, pipeline,
)}
ORACLE_SQL = dict(ORACLE)
