"""A training-corpus pipeline over the documents table: score, dedupe, decontaminate, mask, tokenize.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet in the shared folder and reads it again for the next one.
All stages but the last return the columns of documents; the last adds the token ids
and counts, in place of columns of those names. Null, empty, very long and repeated
texts and further columns are treated as each operator says: a null text is scored as
empty text, keeps its null, and goes on; of equal texts the smallest doc_id stays, and
of equal doc_ids the row with the least hash of its other columns. Empty documents
give an empty result; without labels every score is 0.5, so no document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, scratch, table
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.pii_crf import mask_documents
from tidemark.llm.piece_codec import append_ids
from tidemark.llm.quality import CUT, fit_quality, score_quality
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash import keep_representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker scores below the cut go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    score = fresh(docs, "score")
    return score_quality(docs, model, score).where(F.col(score) >= CUT).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind."""
    return mask_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids and n_tokens; the text is what the ids decode to."""
    return append_ids(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_pii", mask_pii), ("tokenize", tokenize)]

#: Models and merges are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
