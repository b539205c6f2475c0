"""Operator 7: two-pass external shuffle into shards.

Pass 1 scatters every record into a bucket by a seeded hash of its place in the input's files. The number of buckets
follows the input's bytes, so that a bucket has about ``bucket_bytes`` whatever the size of the corpus (beyond
``MAX_BUCKETS`` of them buckets grow instead: with 24 MB that is beyond 6 TB, and 100 TB make 400 MB each). A bucket is a
partition of its own, so no two share a task. Pass 2 holds one bucket at a time, applies a Fisher-Yates permutation seeded
by (seed, bucket) and writes it: texts are shuffled once. The global order is the concatenation of the buckets; a shard is
a contiguous run of it, so row counts of shards differ by one at most. Where buckets begin is a table of ``MAX_BUCKETS``
rows at most, so it is broadcast.

Because the hash takes the row's place and not a value of the row, no key, source or group of equal texts can fill a
bucket. A row's place is its file and number there, so a task that runs again deals out its rows as before, and the same
files give the same order for the same seed, however they are split.

Defined results: null texts have size 0 (digest size 1, crc 0); empty tables give no rows; repeated rows are placed
one by one; texts of any length stay whole, one larger than a bucket fills it alone; columns of the input that clash with
added ones (``ADDED``) are replaced by them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import new_path, remove, with_address

ADDED = ("bucket", "place", "shard", "slot", "address_file", "address_row")
BUCKET_BYTES = 24 << 20
MAX_BUCKETS = 1 << 18


def _permute_buckets(seed: int):
    """Arrow batches sorted by bucket in, the same rows out, each bucket in Fisher-Yates order with its place."""

    def run(batches):
        import numpy as np

        held: list[pa.RecordBatch] = []
        current = None

        def flush():
            table = pa.Table.from_batches(held)
            rng = np.random.Generator(np.random.PCG64([seed, current]))
            order = np.arange(table.num_rows)
            rng.shuffle(order)  # Fisher-Yates
            table = table.drop_columns(["address_file", "address_row", "place"]).take(pa.array(order))
            table = table.append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))
            yield from table.to_batches(max_chunksize=2048)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column("bucket"))
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if current is not None and bucket[lo] != current:
                    yield from flush()
                    held.clear()
                current = int(bucket[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    return run


def write_shuffled(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Both passes: writes ``docs`` to ``path`` in shuffled order with ``bucket`` and ``place``; returns the number of buckets."""
    docs, paths = with_address(spark, docs.drop(*ADDED), "address_file", "address_row")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(64)).alias("b")).first()["b"] or 0
    buckets = min(MAX_BUCKETS, max(1, math.ceil(total / bucket_bytes)))
    scattered = (
        docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "address_file", "address_row"), F.lit(buckets)).cast("int"))
        .withColumn("place", F.lit(0).cast("long"))
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "address_file", "address_row")
    )
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in ADDED], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    scattered.mapInArrow(_permute_buckets(seed), schema).write.option("compression", "zstd").parquet(path)
    remove(spark, *paths)
    return buckets


def assign_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """The written rows with ``shard`` and ``slot``: shard k holds the global places from ceil(k*N/shards) on."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    # MAX_BUCKETS rows at most, for the window and for the broadcast
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.col("start") + F.col("place")
    # shard = floor(g * shards / N); the first place of shard s is ceil(s * N / shards)
    return (
        rows.join(F.broadcast(starts), "bucket")
        .withColumn("shard", F.expr(f"cast((start + place) * {shards} div total as int)"))
        .withColumn("slot", at - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
        .drop("start", "total")
    )


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, shards: int = 16, path: str | None = None, text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The whole operator: texts written in shuffled order below ``path``, returned with ``shard`` and ``slot``."""
    path = path or new_path(spark, "shards")
    write_shuffled(spark, docs, path, text, seed, bucket_bytes)
    return assign_shards(spark, path, shards)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the shards: law ``rows``, 16 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shuffle_into_shards(spark, docs.select("doc_id", "text"), 16)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
