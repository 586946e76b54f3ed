"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; ``run`` writes each result as Parquet to the shared folder and reads it back as the next
stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import jaccard, packing, quality_model, quality_rules, repeats
from threadloom.llm.common import stage, table
from threadloom.session import configure

REPEAT_BYTES = 200  # less than any passage of 50 words of four letters and a space on average

def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more)."""
    return quality_model.filter_documents(docs, table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingle similarity of 0.8 or more, the smallest doc_id."""
    return jaccard.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEAT_BYTES bytes that occur more than once; ``n_chars`` follows the text."""
    return repeats.remove_repeats(docs, REPEAT_BYTES).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their text, bin, bin capacity and place in the bin."""
    return packing.pack_documents(docs, with_text=True)


def _configured(function):
    """The stage with the engine's session defaults (batches bounded by bytes) where the caller set none."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(configure(spark), docs, sf_dir)
    return run_stage


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("ngram_jaccard", drop_similar),
          ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack)]
STAGES = [(name, _configured(function)) for name, function in STAGES]

ORACLE_SQL = None  # the classifier's fit is not expressible in SQL; tests/llm/test_pipeline.py checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
