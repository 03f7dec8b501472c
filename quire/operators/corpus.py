"""Corpus-level text jobs (T2r, T5, T6, T7, A6, A7, A9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import text as TX


def quality_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """T6 flattened: one row per document with the quality struct's fields."""
    return df.withColumn("_q", TX.text_quality(text_col)).select("*", "_q.*").drop("_q")


def quality_report(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """T6 report: documents per issue ('none' when valid), cross-tabulated
    with the quality/toxicity labels where a document has one.

    The labels table is joined on doc_id after the per-document step; Spark
    picks broadcast or sort-merge from its size."""
    q = quality_table(docs.select(id_col, "text"))
    x = q.select(id_col, F.explode(F.when(F.size("issues") == 0, F.array(F.lit("none")))
                                   .otherwise(F.col("issues"))).alias("issue"))
    if labels is not None:
        x = x.join(labels, id_col, "left")
    else:
        x = x.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    return x.groupBy("issue").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count("quality").alias("n_labelled"),
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n_quality_1"),
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n_toxic_1"))


def token_budget(docs: DataFrame, tenant_col: str = "tenant_id", text_col: str = "text") -> DataFrame:
    """T5 per tenant: token estimates summed, max and mean (partial
    aggregation before the shuffle)."""
    tok = TX.estimate_tokens(text_col)
    return (docs.select(tenant_col, tok.alias("tok")).groupBy(tenant_col)
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tok").alias("total_tokens"),
                 F.max("tok").alias("max_tokens"), TX.round6(F.avg("tok")).alias("avg_tokens")))


def word_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Highest word frequency per document, computed inside the row."""
    d = docs.select(id_col, TX.text_stats(text_col).alias("st"))
    n = F.coalesce(F.col("st.word_count"), F.lit(0))
    mx = F.coalesce(F.col("st.max_word_count"), F.lit(0))
    return d.select(id_col, n.alias("n_words"), mx.alias("max_word_count"),
                    F.when(n == 0, F.lit(None)).otherwise(TX.round6(mx / n)).alias("max_ratio"),
                    ((n > P.QUALITY_REPETITION_MIN_WORDS) & (mx > n * F.lit(P.QUALITY_REPETITION_RATIO)))
                    .alias("excessive_repetition"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents with the same content hash.  The shuffle
    carries (hash, id) only, pre-aggregated per partition."""
    return (docs.select(F.sha2(text_col, 256).alias("text_hash"), id_col)
            .groupBy("text_hash")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("first_doc_id"),
                 F.max(id_col).alias("last_doc_id"))
            .filter(F.col("n_docs") > 1))


def cleaning_report(docs: DataFrame, tenant_col: str = "tenant_id", text_col: str = "text") -> DataFrame:
    """T2r: per tenant and cleaning rule, rows the rule changed and
    characters it removed (negative = added, e.g. NFKD).

    A text's cleaning stages are one column each, so every rule runs once a
    row; a tenant's counts become rows after they are summed."""
    steps = TX.clean_steps()
    d = docs.select(tenant_col, F.coalesce(F.col(text_col), F.lit("")).alias("_before"))
    counts = []
    for i, (name, step) in enumerate(steps):
        before, after = F.col("_before"), step(F.col("_before"))
        if name in TX.CLEAN_MARKS:
            after = F.when(F.contains(before, F.lit(TX.CLEAN_MARKS[name])), after).otherwise(before)
        d = d.withColumn("_after", after).select(
            tenant_col, *counts, (F.col("_before") != F.col("_after")).cast("int").alias(f"_changed{i}"),
            (F.char_length("_before") - F.char_length("_after")).alias(f"_removed{i}"), F.col("_after").alias("_before"))
        counts += [f"_changed{i}", f"_removed{i}"]
    sums = d.groupBy(tenant_col).agg(*[F.sum(c).alias(c) for c in counts])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_changed{i}").alias("rows_changed"), F.col(f"_removed{i}").alias("chars_removed"))
                     for i, (name, _) in enumerate(steps)])
    return sums.select(tenant_col, F.explode(rows).alias("r")).select(tenant_col, "r.rule", "r.rows_changed", "r.chars_removed")


def ingest_records(docs: DataFrame, tenant_col: str = "tenant_id", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Cleaned text, its length and sha256, status text_extracted."""
    c = TX.clean_text_for_embedding(text_col)
    d = docs.select(id_col, tenant_col, c.alias("clean_text"))
    return d.select(F.col(id_col).alias("document_id"), tenant_col,
                    F.char_length("clean_text").alias("text_length"),
                    F.sha2("clean_text", 256).alias("text_hash"),
                    F.lit("text_extracted").alias("status"))
