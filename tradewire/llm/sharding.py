"""Sharding by extendible hashing, in DataFrame functions only.

A document's shard is a bucket of a directory over the leading bits of the key's hash. Buckets
start as one; a bucket above the byte limit splits on its next bit, the others stay, until every
bucket fits. The directory is worked out from sums of bytes over hash prefixes, ``step`` bits at a
time: only what is still too large is refined, so the work follows the data and no row moves more
than once a step. A single row above the limit has a shard of its own.

The hash is the first 60 bits of the key's MD5; rows with equal keys (repeated rows, null keys)
are told apart by a second hash over a row number, which serves the bits after the 60th.

Defined cases: a null text has no bytes; null keys hash as the empty string; an empty table
gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.llm.common import scratch

BITS = 60


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(level_bits: int) -> Column:
    """The leading bits as text of ones and zeros, which orders and nests as the directory does."""
    return F.substring("path", 1, level_bits)


def assign(df: DataFrame, limit: int, *, key: str = "doc_id", text: str = "text", step: int = 10) -> DataFrame:
    """(key, n_bytes, shard, depth) of each row; shard: the bucket's prefix of zeros and ones."""
    bits = lambda h: F.lpad(F.bin(h), BITS, "0")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    path = F.concat(bits(_hash60(F.coalesce(F.col("key").cast("string"), F.lit("")))), bits(_hash60(F.concat(F.lit("row "), F.col("uid").cast("string")))))
    active = scratch(rows.withColumn("path", path))
    out = None
    for done in range(0, 2 * BITS, step):
        cells = active.groupBy(_prefix(done + step).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        cells = scratch(cells)
        at = cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(done + step))))
        at = at.withColumn("shard", F.expr("substring(cell, 1, depth)"))
        sums = at.groupBy("depth", "shard").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
        fits = (F.col("n_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == 2 * BITS)
        # Only the first step's cells have a bound, 2**step; the later ones grow with the data.
        sent = "broadcast" if done == 0 and step <= 12 else "merge"
        fitting = at.drop("n_bytes", "n").join(sums.where(fits).hint(sent), ["depth", "shard"])
        bucket = scratch(fitting.groupBy("cell").agg(F.min("depth").alias("depth")))
        placed = active.withColumn("cell", _prefix(done + step)).join(bucket.hint(sent), "cell", "left")
        placed = scratch(placed.drop("cell"))
        some = placed.where(F.col("depth").isNotNull()).select("key", "n_bytes", F.expr("substring(path, 1, depth)").alias("shard"), F.col("depth").cast("long").alias("depth"))
        out = some if out is None else out.unionByName(some)
        active = placed.where(F.col("depth").isNull()).drop("depth")
        if active.isEmpty():
            break
    return out.withColumnRenamed("key", key)


SHARD_BYTES = 1 << 20


def op6(spark, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text over all documents."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SHARD_BYTES)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), {BITS}, '0') AS path
  FROM documents
),
b(doc_id, n_bytes, path, depth, total, n) AS (
  SELECT doc_id, n_bytes, path, CAST(0 AS BIGINT), sum(n_bytes) OVER (), count(*) OVER () FROM d
  UNION ALL
  SELECT doc_id, n_bytes, path, depth + 1, sum(n_bytes) OVER (PARTITION BY substr(path, 1, depth + 1)),
         count(*) OVER (PARTITION BY substr(path, 1, depth + 1))
  FROM b WHERE total > {SHARD_BYTES} AND n > 1
)
SELECT doc_id, n_bytes, substr(path, 1, depth) AS shard, depth FROM b WHERE total <= {SHARD_BYTES} OR n = 1
"""
