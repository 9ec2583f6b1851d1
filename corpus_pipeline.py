"""A training-data pipeline over documents: language, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it again as the next one's docs. All but the last keep the columns of documents, whatever other columns there
are and whatever their names; an empty table goes through all stages and gives an empty result. Texts of any length are
handled whole. Nulls may stand in any column: what each stage does with them, and with repeated rows, it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, decontam, langid, neardup, secret_scan
from lexiloom.llm.common import dropped, scratch, written

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is recognised, that is whose words' labels are sure on average, in one language or in several.

    Null texts and texts without a letter go. A null lang is not learned from; repeated rows stay or go together.
    """
    return langid.accept(docs, langid.fit(langid.learnable(docs)), least=0.4)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (runs of five words, similarity 0.8 or more), that with the smallest id.

    Documents with a null id stay; rows that repeat an id stay or go together.
    """
    return neardup.deduplicate(docs, shingle=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that the benchmark holds too; a text that is all such spans goes. Repeated rows are treated alike."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; a null source counts as one unnamed owner, rows of one id as one repository."""
    return secret_scan.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text how many token ids it has, their digest, and that of the bytes they decode to; a row a row."""
    return bpe.round_trip(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's input, and what it wrote on the way, is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch() as made:
            out = written(stage(spark, docs, sf_dir))
            made.remove(out)
        dropped(docs)
        docs = out
    return docs
