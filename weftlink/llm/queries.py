"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.ngram_jaccard import ngram_jaccard_components

    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.language_id import held_out, identify_languages, train_language_model

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out("doc_id", 3, 1)
    model = train_language_model(docs, "doc_id", "text", "lang", ~held)
    return identify_languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.language_id import held_out
    from weftlink.llm.toxicity import score_toxicity, train_toxicity_model

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = held_out("doc_id", 4, 2)
    model = train_toxicity_model(docs, labels, ~held)
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.suffix_search import decontaminate

    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftlink.llm.piece_codec import encode_digests

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.cross_entropy import score_documents

    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), target)


def op7_projected_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.projected_knn import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.fm_index import fm_dedup

    return fm_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.difference_cover import suffix_array_dedup

    return suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftlink.llm.shards import materialise

    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), key=20240607)


def op11_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.scratch import Scratch
    from weftlink.llm.time_partitions import clicks_layout

    return clicks_layout(spark.read.parquet(f"{sf_dir}/clicks.parquet"), Scratch(spark, "time_partitions").root)


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.period_runs import collapse_runs, run_digests, with_planted_period

    return run_digests(collapse_runs(with_planted_period(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftlink.llm.source_mix import mix_sources

    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def llm_oracle_sql() -> dict[str, str]:
    from weftlink.llm.sql import BY_QUERY

    return dict(BY_QUERY)
