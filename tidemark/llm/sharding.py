"""Proportional stratified interleaving of rows into shards.

Every source's rows are shuffled by a seeded hash and ranked; rank r of n rows
becomes the fractional rank (r + u) / n, where u in [0, 1) is a hash of the
source: many small sources, which would else all have a row at 1 / 2n, are
spread evenly. Ordering all rows by fractional rank interleaves the sources in
proportion, so any contiguous cut holds the corpus mixture to within a row a
source. Law ``rows``: shard sizes differ by one row at most.

Both global orders are ranked in buckets (hash range, then fractional-rank
range), so no source, however hot, is ordered by one task, and no rank is
taken from partition numbers that a recomputation could change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import bucket_count, bucketed_rank, materialize

SEED = 20_240_229


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = SEED, rows_per_bucket: int = 20_000) -> DataFrame:
    """Deal the rows of ``docs`` (doc_id, text, source; others ignored) into shards.

    Returns doc_id, source, size (UTF-8 bytes of text plus 1; null text: 1),
    text_crc32 (null text: as the empty text), law, shard, slot (0-based place
    in the shard) and grown_shard (null: law ``rows`` gives no such promise).
    Rows are never merged: repeated rows and repeated or null doc_ids are rows
    of their own (which of several equal rows comes first is open); a null
    source is a stratum. Very long texts count by their bytes. Ties of the hash
    go by doc_id, checksum and size. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", text).alias("key"),
    )
    slim = materialize(slim, "shard-rows")
    n = slim.count()
    buckets = bucket_count(n, rows_per_bucket)
    # The hash is uniform, so equal ranges of it are even buckets that follow its order.
    slim = slim.withColumn("_b", (F.shiftrightunsigned("key", 34) * F.lit(buckets) / F.lit(2**30)).cast("long"))
    # shiftrightunsigned orders negatives last; order by the same unsigned view.
    order = [F.shiftrightunsigned("key", 1), "key", "doc_id", "text_crc32", "size"]
    ranked = bucketed_rank(slim, ["source"], "_b", order, "rank")
    sizes = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_source"))
    ranked = ranked.alias("r").join(sizes.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    shift = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "r.source"), 11) / F.lit(2.0**53)
    fraction = ((F.col("rank") + shift) / F.col("n_source")).alias("fraction")
    ranked = ranked.select("r.doc_id", "r.source", "size", "text_crc32", "key", fraction)
    ranked = ranked.withColumn("_b", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    ranked = materialize(ranked, "shard-ranks")
    order = ["fraction", "source", F.shiftrightunsigned("key", 1), "key", "doc_id", "text_crc32", "size"]
    placed = bucketed_rank(ranked, [], "_b", order, "position") if n else ranked.withColumn("position", F.lit(0).cast("long"))
    # shard s holds positions ceil(s n / k) .. ceil((s + 1) n / k) - 1.
    shard = F.expr(f"(position * {n_shards}L) div {max(n, 1)}L")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
