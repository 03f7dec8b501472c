"""Operator 6: sharding by a two-pass external shuffle (native).

Pass 1 scatters the records uniformly, by a seeded hash of their content, to
buckets of about `bucket_bytes` (an exchange whose partition number is the
bucket).  Pass 2 shuffles each bucket in memory with Fisher-Yates (Spark's
`shuffle`, seeded per partition, over the bucket in a fixed order).  The
buckets laid end to end are a uniform permutation; consecutive slices of it
are the shards, so their row counts differ by at most one (law `rows`).

Only the bucket counts (one row per bucket) are gathered for the offsets.  No
key is hot: the hash covers all columns, so any source, language or text may
hold a third of the rows, and of rows equal in every column more than
`equal_rows` are spread by the number of their copy.
A record larger than a bucket makes its bucket that much larger.

Rows: null text has size 8 and the crc32 of no bytes; empty texts likewise;
repeated rows are kept, each with a slot of its own; an empty table gives no
rows; extra columns travel along (`external_shuffle`, `write_shards`), also
when they are called like the columns added here (those then win).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
SEED = 20240607
BUCKET_BYTES = 8 << 20
ROW_BYTES = 8
BROADCAST_BUCKETS = 1_000_000
#: Rows equal in every column, above which their copies are told apart by number.
EQUAL_ROWS = 1_000


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _scattered(df: DataFrame, names: list[str], buckets: int, seed: int, equal_rows: int) -> DataFrame:
    """(_bucket, _order, _record) of every row.  A row's place is a hash of its
    columns.  Rows that occur more than `equal_rows` times are counted instead
    of moved (partially in every task), and each copy gets a place of its own
    from its number; they are laid out again in blocks of as many copies."""
    place = F.xxhash64(F.lit(seed), *names)

    def at(rows: DataFrame, where: Column) -> DataFrame:
        return rows.select(F.pmod(where, F.lit(buckets)).cast("int").alias("_bucket"), where.alias("_order"), F.struct(*names).alias("_record"))
    often = df.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > equal_rows).select("_place")
    found = often.limit(BROADCAST_BUCKETS + 1).count()  # at most rows / equal_rows
    if not found:
        return at(df, place)
    often = F.broadcast(often) if found <= BROADCAST_BUCKETS else often
    placed = df.withColumn("_place", place)
    seldom = placed.join(often, "_place", "left_anti")
    alike = placed.join(often, "_place", "left_semi").groupBy("_place", *names).agg(F.count(F.lit(1)).alias("_n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {equal_rows}")))
    blocks = alike.withColumn("_block", block).repartition("_place", "_block")
    first = F.col("_block") * equal_rows
    copies = blocks.withColumn("_copy", F.explode(F.sequence(first, F.least(first + equal_rows, F.col("_n")) - 1)))
    return at(seldom, F.col("_place")).unionByName(at(copies, F.xxhash64("_place", "_copy")))


def external_shuffle(df: DataFrame, text_col: str = "text", shards: int = SHARDS, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES, equal_rows: int = EQUAL_ROWS) -> DataFrame:
    """All columns of `df` with shard and slot (gapless from 0)."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*names)
    totals = df.select(F.sum(record_size(F.col(text_col))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows = totals["rows"]
    buckets = max(1, -(-(totals["bytes"] or 0) // bucket_bytes))
    scattered = _scattered(df, names, buckets, seed, equal_rows)
    counts = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    filled = scattered.repartitionById(buckets, "_bucket").groupBy("_bucket").agg(
        F.array_sort(F.collect_list(F.struct("_order", "_record"))).alias("_all"))
    mixed = filled.select("_bucket", F.shuffle("_all", seed).alias("_all"))
    if buckets <= BROADCAST_BUCKETS:  # known size: one small row per bucket; beyond it the join shuffles
        offsets = F.broadcast(offsets)
    return mixed.join(offsets, "_bucket").select("base", F.posexplode("_all").alias("_at", "_x")) \
        .select("_x._record.*", (F.col("base") + F.col("_at")).alias("_global")) \
        .withColumn("shard", F.expr(f"cast(_global * {shards} div {max(rows, 1)} as int)")) \
        .withColumn("slot", F.expr(f"_global - (cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")) \
        .select(*names, "shard", "slot")


def write_shards(df: DataFrame, path: str, **settings) -> None:
    """Write the shuffled records as `path`/shard=N, in slot order."""
    external_shuffle(df, **settings).repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_digest(df: DataFrame, **settings) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record,
    taken from the records as they come out of the shuffle."""
    out = external_shuffle(df.select("doc_id", "text"), **settings)
    return out.select("doc_id", record_size(F.col("text")).alias("size"),
                      F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
