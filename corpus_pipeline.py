"""Corpus pipeline: quality rules, quality classifier, near-duplicate join, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All stages but the last return the columns of their
input; each works on all its predecessor kept.  Models and cutoffs are learned
from the labels and documents of `sf_dir`; decisions are made on `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import jaccard_join, packing, quality_cnn, quality_rules
from quire.llm.common import read_table
from quire.session import checkpoint_dir, ensure_defaults


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep, columns unchanged.  Null
    and empty texts have no words and go; repeated rows share their verdict;
    an empty table stays empty; without labels only the base rule rejects."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not score as junk, columns
    unchanged.  A null text counts as empty and is scored; repeated rows share
    their score; an empty table stays empty; where the labels hold one class
    only, the score is constant."""
    model = quality_cnn.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality_cnn.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by five-word
    shingles with Jaccard similarity of 0.8 or more, columns unchanged.  Null
    and empty texts are linked with nothing and stay; rows with one doc_id are
    one document; an empty table stays empty."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences of at most 1024 tokens.
    Null and empty texts are the end token alone; repeated rows are packed
    each; an empty table gives no rows; extra columns are not read."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("packing", pack)]

#: No SQL form: trained network, tokenizer, column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result is written as Parquet in the
    shared folder and read again as the next stage's input."""
    ensure_defaults(spark)
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
