"""Sharding by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import text_of
from fieldlens.scale import durable

BITS = 60  # 15 hexadecimal digits of the key's digest


def hash_bits(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def prefix(key: Column, depth: Column) -> Column:
    """The first ``depth`` bits."""
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def split_round(cells: DataFrame, depth: int, step: int, limit_bytes: int) -> DataFrame:
    """Leaf of the directory for every cell: the shortest prefix of depth ``depth`` .. ``depth + step`` that fits.

    ``cells`` has one row per prefix of ``depth + step`` bits, so a bucket of the directory meets at most ``2 ** step`` rows.
    """
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(depth + step))))
    levels = levels.withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(depth + step) - F.col("depth")).cast("int")))
    whole = Window.partitionBy("depth", "bucket")
    levels = levels.select(
        "cell", "depth", "bucket", F.sum("bytes").over(whole).alias("shard_bytes"), F.sum("rows").over(whole).alias("shard_docs"),
        (F.min("low").over(whole) == F.max("high").over(whole)).alias("single"),
    )
    fits = (F.col("shard_bytes") <= limit_bytes) | F.col("single")
    leaf = F.struct("depth", "bucket", "shard_bytes", "shard_docs")
    return levels.groupBy("cell").agg(F.min(F.when(fits, leaf)).alias("leaf"))


def extendible_shards(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit_bytes: int = 1 << 20, step: int = 8,
) -> DataFrame:
    """Deal documents to shards of at most ``limit_bytes`` of UTF-8 text.

    The directory is indexed by the leading bits of the key's hash.  A bucket above the limit splits on the next bit, the
    others stay as they are.  Buckets are sized ``step`` bits at a time from sums per prefix; only rows of buckets that are
    still too large take part in the next round.

    One row per input row: ``id_col``, n_bytes, shard (the bucket's bits), depth, page, shard_bytes, shard_docs, oversized.
    A bucket whose rows all share one hash cannot split: it is cut into overflow pages of at most the limit (rows in order of
    size), and only a single text above the limit makes an oversized page.  shard_bytes and shard_docs describe the bucket.
    A null text has 0 bytes, a null key hashes like an empty one, repeated rows share a hash, an empty table gives an empty
    result, other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col)).alias("key"), F.octet_length(text_of(text)).cast("bigint").alias("n_bytes")
    )
    rest, depth, done = durable(sized), 0, []
    while True:
        step = min(step, BITS - depth)
        rest = rest.withColumn("cell", prefix(F.col("key"), F.lit(depth + step)))
        cells = rest.groupBy("cell").agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        placed = durable(rest.join(split_round(cells, depth, step, limit_bytes), "cell").drop("cell"))
        done.append(placed.filter(F.col("leaf").isNotNull()))
        rest, depth = placed.filter(F.col("leaf").isNull()).drop("leaf"), depth + step
        if depth == BITS or rest.isEmpty():
            break
    shards = done[0]
    for more in done[1:]:
        shards = shards.unionByName(more)
    shards = shards.select("doc_id", "n_bytes", "key", "leaf.*")
    fits = F.col("shard_bytes") <= limit_bytes
    pages = Window.partitionBy("key").orderBy("n_bytes")
    before = F.sum("n_bytes").over(pages.rowsBetween(Window.unboundedPreceding, -1))
    # a page starts a new one before it would pass the limit: half the limit of earlier bytes per page leaves room for the row
    small = F.col("n_bytes") * 2 <= limit_bytes
    page = F.when(small, F.floor(F.coalesce(before, F.lit(0)) * 2 / limit_bytes)).otherwise(
        F.floor(F.coalesce(F.sum(F.when(small, F.col("n_bytes"))).over(Window.partitionBy("key")), F.lit(0)) * 2 / limit_bytes)
        + F.sum(F.when(~small, 1)).over(pages.rowsBetween(Window.unboundedPreceding, 0))
    )
    chained = shards.filter(~fits).withColumn("page", page.cast("bigint"))
    shards = shards.filter(fits).withColumn("page", F.lit(0).cast("bigint")).unionByName(chained)
    return shards.select(
        F.col("doc_id").alias(id_col), "n_bytes", F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0")).alias("shard"),
        F.col("depth").cast("bigint").alias("depth"), "page", "shard_bytes", "shard_docs",
        (F.col("n_bytes") > limit_bytes).alias("oversized"),
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS key, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
split AS (
  SELECT doc_id, key, n_bytes, 0 AS depth, sum(n_bytes) OVER () AS bytes, count(*) OVER () AS docs,
    min(key) OVER () = max(key) OVER () AS single FROM d
  UNION ALL
  SELECT doc_id, key, n_bytes, depth + 1, sum(n_bytes) OVER bucket, count(*) OVER bucket, min(key) OVER bucket = max(key) OVER bucket
  FROM split WHERE bytes > 1048576 AND NOT single
  WINDOW bucket AS (PARTITION BY key >> (59 - depth)))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(key >> (60 - depth)), depth, '0') END AS shard, depth::BIGINT AS depth,
  0::BIGINT AS page, bytes::BIGINT AS shard_bytes, docs::BIGINT AS shard_docs, n_bytes > 1048576 AS oversized
FROM split WHERE bytes <= 1048576 OR single
"""
