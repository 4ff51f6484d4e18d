"""The corpus pipeline: documents pass five stages, each written as Parquet and reread.

language ID -> n-gram Jaccard join -> benchmark decontamination -> secret scans -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.llm import decontam, langid, packing, secrets, setjoin
from tradewire.llm.common import crc_mod, scratch

#: Below this calibrated probability a document's language counts as unknown.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and doubtful ones go."""
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    named = model.transform(docs, label_out="__lang", score_out="__score")
    return named.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts."""
    return setjoin.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", contamination),
    ("secret_scans", secret_scan),
    ("packing", pack),
]

#: Stages 1, 2, 3 and 5 cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
