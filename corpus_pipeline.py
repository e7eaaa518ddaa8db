"""A corpus pipeline over ``documents``: five stages, each over all rows that the one
before kept. ``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import materialize
from tidewright.llm.decontaminate import decontaminate
from tidewright.llm.langid import UNKNOWN, identify_language, learn_profiles
from tidewright.llm.secrets import scan_secrets
from tidewright.llm.segment import sample_segmentations
from tidewright.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose n-grams are farther from every language than this is in none of them.
LEAST_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that the corpus names. Texts without letters, null or
    empty, and texts unlike all of them go."""
    told = identify_language(docs, learn_profiles(docs), keep=COLUMNS)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles link at a similarity of 0.8 or more, counted
    exactly; fingerprints of 64 bits can't tell so distant pairs, see the README."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS, min_items=1)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with secrets replaced by marks and n_chars counted anew."""
    clean = scan_secrets(docs, keep=["doc_id", "lang", "source"], redacted="text")
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return sample_segmentations(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("segmentation", segmentation)]

#: SQL has no sampled segmentations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
