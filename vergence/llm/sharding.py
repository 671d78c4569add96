"""Sharding by a two-pass external shuffle.

The first pass scatters the records by a seeded hash into buckets that fit in a task's memory; the
second one lays each bucket out by a Fisher-Yates shuffle.  That is Spark's shuffle() function over
the numbers of a bucket's places, drawn in a small table of buckets whose partitions depend on
their number alone, and applied to the bucket's records in a fixed order: whatever the cluster and
whichever task is repeated, a record gets the same slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vergence.llm.common import cut, sized_broadcast

SHARDS = 40
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Bytes that a record has besides its text.
RECORD_BYTES = 16
#: Buckets whose orders one task draws.
ORDERS_AT_ONCE = 64


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is the highest; one more shard takes keys only into itself."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("weight"), F.lit(s).alias("shard")) for s in range(shards)]
    return F.array_max(F.array(*weights))["shard"]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns of docs with shard, slot, record_bytes and grown_shard after them.

    The id and the number of shards alone decide a row's shard; grown_shard is its shard if there
    were one more.  Slots are gapless from 0 within a shard, in random order.  A null text counts
    no bytes; a null id is a key like any other.  Rows that repeat an id share its shard but their
    texts scatter them over its buckets; rows equal in both share a bucket.  A very long text fills
    its bucket beyond the average.  Columns of docs with
    one of these names are replaced.  An empty table gives no rows."""
    added = ["shard", "slot", "record_bytes", "grown_shard"]
    own = docs.drop(*added)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES
    total = docs.select(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    salt = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    now = shard_of(F.col(id_col), shards, seed)
    grown = F.greatest(F.struct(F.xxhash64(F.lit(seed), F.lit(shards), F.col(id_col)), F.lit(True)), F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col)), F.lit(False)) for s in range(shards)])))["col2"]
    row = F.struct(*[F.col(f"`{c}`") for c in own.columns])
    scattered = own.select(row.alias("row"), now.alias("shard"), F.pmod(salt, F.lit(buckets)).cast("int").alias("bucket"), size.alias("record_bytes"), F.when(grown, shards).otherwise(now).cast("int").alias("grown_shard"))

    counts = cut(scattered.groupBy("shard", "bucket").agg(F.count("*").alias("records")))
    most = counts.agg(F.max("records")).first()[0] or 1
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # as many rows as a shard has buckets
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start"))

    record = F.struct("row", "record_bytes", "grown_shard")
    numbers = docs.sparkSession.range(0, shards * buckets, 1, math.ceil(shards * buckets / ORDERS_AT_ONCE))
    # a random order of more places holds one of fewer
    orders = numbers.select(F.floor(F.col("id") / buckets).cast("int").alias("shard"), (F.col("id") % buckets).cast("int").alias("bucket"), F.shuffle(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(seed)).alias("order"))
    in_order = F.array_sort(F.collect_list(record))
    laid = scattered.groupBy("shard", "bucket").agg(in_order.alias("sorted")).join(sized_broadcast(orders, shards * buckets * most), ["shard", "bucket"])
    laid = laid.select("shard", "bucket", F.transform(F.filter("order", lambda i: i < F.size("sorted")), lambda i: F.get("sorted", i)).alias("records"))
    placed = laid.join(sized_broadcast(starts, shards * buckets), ["shard", "bucket"])
    out = placed.select("shard", "start", F.posexplode("records").alias("at", "record"))
    return out.select("record.row.*", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "record.record_bytes", "record.grown_shard")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes each shard as a folder of its own, its records in the order of their slots."""
    placed = shard(docs, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
