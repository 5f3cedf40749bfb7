"""A corpus pipeline: quality classifier, quality rules, near-duplicate join and
cost-balanced packing, each stage written as Parquet before the next reads it.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns
of ``documents``.

Nulls in any column are allowed: a null text has no words and goes at the rules
stage, a null id is a document like any other.  Repeated rows are one group of
copies, of which one stays.  Texts of any length are read whole.  Columns beyond
those of ``documents`` are carried along, whatever their names, and an empty table
gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoframe.llm.jaccard import keep_one
from echoframe.llm.packing import pack_balanced
from echoframe.llm.quality import keep_quality
from echoframe.llm.rules import keep_good
from echoframe.plans.scratch import settled, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not reject."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules' policy."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return keep_one(docs, n=5, threshold=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 4096 tokens."""
    return pack_balanced(docs, size=4096, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packing),
]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_pipeline.py
#: holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order.  Of what a stage writes on its way,
    only its result stays."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
