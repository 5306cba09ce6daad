"""Sharding by extendible hashing, with native functions only.

A row's address is the bit string of a hash of its key.  The directory holds one bucket for every
prefix that is needed: a bucket whose rows exceed the byte limit is split on its next bit, all others
stay, so depths differ.  Splitting needs no pass for each bit: the bytes of fine prefixes are summed
once, every prefix above them gets its sum, and a row's bucket is the shortest of its prefixes that
fits.  Only rows of prefixes that don't fit even at that depth go through another round with further
bits, and rows of one key, which no bit of its hash can part, get bits of a hash of their own place in
the input.

Edge cases: a null text has no bytes; a row larger than the limit is a shard of its own (``over``);
null keys share one address and are parted as rows of one key are; an empty table has no shards; extra
columns are kept; the limit counts the texts' UTF-8 bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaris.llm.common import scratch_path, store

#: Bits of one hash, and bits that a round looks at beyond those that an even split would need.
HASH_BITS, EXTRA_BITS = 60, 4
MAX_BYTES = 2 << 20


def hash_bits(value: Column) -> Column:
    """The first HASH_BITS bits of the MD5 of a string."""
    digits = F.substring(F.md5(value.cast("binary")), 1, HASH_BITS // 4)
    return F.lpad(F.conv(digits, 16, 2), HASH_BITS, "0")


def extendible_shards(df: DataFrame, *, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, max_rounds: int = 40) -> DataFrame:
    """df with shard string (the bucket's hash prefix), depth int (its bits), n_bytes long,
    shard_bytes long, shard_rows long and over boolean. df must give the same rows each time it is read."""
    made = ["shard", "depth", "n_bytes", "shard_bytes", "shard_rows", "over"]
    rows = df.select(*[c for c in df.columns if c not in made], F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("__bits", F.concat(hash_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))), hash_bits(F.concat(F.lit("place "), F.monotonically_increasing_id().cast("string")))))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    step = max(EXTRA_BITS, math.ceil(math.log2(max(total, 1) / max_bytes + 1)) + EXTRA_BITS)
    done, low = None, 0
    for _ in range(max_rounds):
        high = min(low + step, 2 * HASH_BITS)
        cells = store(_cells(rows, low, high, max_bytes), "cells")
        placed = rows.join(cells, F.substring("__bits", 1, high) == F.col("__cell"))
        fits = placed.where("depth is not null").select(*rows.columns, "shard", "depth", "shard_bytes", "shard_rows")
        done = fits if done is None else done.unionByName(fits)
        if high == 2 * HASH_BITS or cells.where("depth is null").isEmpty():
            break
        rows, low = store(placed.where("depth is null").select(*rows.columns), "split-on"), high
    return done.withColumn("over", F.col("shard_bytes") > max_bytes).drop("__bits").select(*[c for c in df.columns if c not in made], *made)


def _cells(rows: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """(__cell, shard, depth, shard_bytes, shard_rows) of every prefix of high bits: its bucket, null
    where none of its prefixes of low to high bits fits."""
    fine = rows.groupBy(F.substring("__bits", 1, high).alias("__cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    above = fine.withColumn("d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.substring(F.col("__cell"), F.lit(1), F.col("d")))
    sums = above.groupBy("shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    # at the last bit what is left stays together
    fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") == 1) | (F.length("shard") == 2 * HASH_BITS)
    whole = sums.where(fits)
    first = above.join(whole, "shard").groupBy("__cell").agg(F.min(F.struct(F.col("d").alias("depth"), "shard", "shard_bytes", "shard_rows")).alias("x"))
    return fine.select("__cell").join(first, "__cell", "left").select("__cell", "x.*")


def write_shards(sharded: DataFrame, path: str | None = None) -> DataFrame:
    """Write one folder of Parquet for each shard and read it back; rows of a shard go through one
    task, which its byte limit bounds."""
    path = path or scratch_path(sharded.sparkSession, "shards")
    sharded.withColumn("part", F.concat(F.lit("s"), F.col("shard"))).repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return sharded.sparkSession.read.parquet(path)
