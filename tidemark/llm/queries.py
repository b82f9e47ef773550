"""Queries over the driver's tables, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .html_template import extract
from .maxent_lm import lm_scores
from .media import text_media
from .piece_codec import encode_digests
from .pii_crf import find
from .quality import quality_scores
from .simhash import near_duplicates
from .suffix_dedup import dedup_digests
from .wavelet import token_files


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; imported late, since it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_html_template, op3_wavelet_tokens, op4_quality_ranking, op5_simhash_pivots, op6_pii_crf, op7_maxent_lm, op8_decontamination, op9_media_columns, op10_suffix_dedup)}

#: None of the ten can be said in SQL (hashes, models, files, byte-wise joins); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
