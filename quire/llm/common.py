"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (local paths and stores alike)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (null ids count as text '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: later reads take only the
    columns they need."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_used_shuffles(spark: SparkSession) -> None:
    """From now on Spark removes the shuffle files of each finished execution
    (Spark 4.1 session setting).  Call it before the frames are made.  A plan
    that is cut by checkpoints needs none of them again; were one needed after
    all, Spark would run its stage once more."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(batch_iter: Iterable[pa.RecordBatch], text_col: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most `max_bytes` of text (a
    single longer row stays whole): bounds the working memory of a task."""
    for batch in batch_iter:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
