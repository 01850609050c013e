"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.quality_rules import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality_rules(docs, keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("source").alias("host"), F.round("shrunk_rate", 9).alias("shrunk_rate"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.language_id import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.quality_knn import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return classify(docs, labels, keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.mixing import mix_rows

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_rows(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.bpe import digests

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer("piece_bpe_32k.model"), keep_text=False)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from querymill.llm.ngram_join import jaccard_classes

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs, keep_text=False).select("doc_id", "n_shingles", "component_id")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_language_id,
        op3_url_filter,
        op4_quality_classifier,
        op5_substring_dedup,
        op6_mix_sources,
        op7_bpe,
        op8_token_counts,
        op9_nearest_neighbours,
        op10_jaccard_join,
    )
}
