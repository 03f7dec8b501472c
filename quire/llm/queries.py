"""Queries of the training-data operators: opN_<name>(spark, sf_dir).

Each applies its operator, with production parameters, to its whole table
and derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (bpe_codec, conversation_trie, hard_negatives, html_extract, jaccard_join, language_id, license_scan, packing, quality_cnn,
                       quality_rules, sharding, topk_search, url_filter)
from quire.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digest(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_rules.count_table(read_table(spark, sf_dir, "documents"))
    cut = quality_rules.learn_cutoffs(counts, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge(counts, cut).select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, read_table(spark, sf_dir, "labels")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.planted_confusions(read_table(spark, sf_dir, "embeddings")))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.write_filter(url_filter.rule_table(spark, url_filter.RULES), url_filter.word_table(spark, url_filter.BLOCK_WORDS))
    return url_filter.judge(read_table(spark, sf_dir, "pages"), listed)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turn_ids(read_table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.rebuild(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_html_extract, op3_topk_search, op4_bpe_codec, op5_quality_rules, op6_sharding, op7_quality_cnn,
    op8_jaccard_join, op9_packing, op10_license_scan, op11_hard_negatives, op12_url_filter, op13_conversation_trie, pipeline)}

ORACLES: dict[str, str] = {"op3_topk_search": topk_search.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE,
                           "op12_url_filter": url_filter.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
