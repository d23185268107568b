"""Sharding by weighted rendezvous hashing of stable record keys.

A record goes to the shard with the greatest -weight / ln(u), where u in (0, 1)
is a hash of its key and the shard's number.  Only key, weights and shard count
decide, so one more shard takes rows only into itself and takes its fair share.
All of it is built-in column functions.

Within a shard each row gets a gapless slot.  Rows are ranked in hash buckets of
bounded size and bucket counts are summed up, so no task ranks a whole shard.

Null keys are one key of their own; rows with equal keys share a shard, and equal
rows get neighbouring slots in any order.  Null texts have no bytes.  Extra
columns are ignored unless `keep` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, written

#: Rows that one rank window may hold before more buckets are used.
BUCKET_ROWS = 100_000
_UNITS = 1 << 52


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The number, from 0, of the shard that wins the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    bids = []
    for i, w in enumerate(weights):
        u = (F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), F.lit(i)), F.lit(_UNITS)).cast("double") + 0.5) / float(_UNITS)
        bids.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("bid"), F.lit(i).alias("shard")))
    return (bids[0] if len(bids) == 1 else F.greatest(*bids))["shard"]


def shard(docs: DataFrame, weights: list[float], *, key: str = "doc_id", text: str = "text", grown_weight: float | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per record: key, size (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard."""
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    grown = rendezvous(k, [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    rows = written(docs.select(k.alias("key"), (F.octet_length(t) + F.lit(1).cast("long")).alias("size"), F.crc32(t).alias("text_crc32"), rendezvous(k, weights).alias("shard"), grown.alias("grown_shard")))
    buckets = max(16, rows.count() // (bucket_rows * len(weights)))
    spread = F.xxhash64("key", "text_crc32", "size")
    rows = rows.withColumn("spread", spread).withColumn("bucket", F.pmod("spread", F.lit(buckets)).cast("int"))
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("spread", "key", "text_crc32", "size"))
    out = rows.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: list[float], path: str | None = None, *, key: str = "doc_id", files_per_shard: int = 8) -> str:
    """docs as Parquet, one folder per shard; large shards are several files."""
    path = path or shared_folder(docs.sparkSession)
    column = "shard"
    while column in docs.columns:
        column += "_"
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(files_per_shard))
    placed = docs.withColumn(column, rendezvous(F.col(f"`{key}`"), weights))
    placed.repartition(len(weights) * files_per_shard, column, part).write.partitionBy(column).parquet(path)
    return path


def op2(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 8, grown_weight=1.0)
    return out.withColumn("law", F.lit("key"))
