"""Shared helpers: durable intermediates, distributed ranks, components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.storage import new_path, remove, scratch, shared_dir  # noqa: F401

#: Rows handed to Python at once. Long documents make Spark's default of
#: 10,000 rows hundreds of megabytes, so the operators lower it.
ARROW_ROWS = 500


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage at a place that survives the loss of executors.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        remove(df.sparkSession, path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: str, right: str, columns: list[str]):
    """Null-safe equality of equally named columns under two aliases."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def bucketed_rank(df: DataFrame, groups: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Add ``out``: the row's 0-based rank within ``groups`` by (bucket, order).

    ``bucket`` splits each group into pieces that follow the order, so that a
    hot group is ranked by many tasks. ``df`` is read twice: pass a table.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    joined = local.alias("l").join(offsets.alias("o"), same("l", "o", keys))
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col("_before") + F.col("_rn")).alias(out))


def bucket_count(n_rows: int, rows_per_bucket: int = 20_000) -> int:
    return max(1, math.ceil(n_rows / rows_per_bucket))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long).

    Alternates large-star and small-star steps until the edges are stars, each
    round written to the shared folder. Returns (node, component): one row for
    every node that has an edge; ``component`` is its smallest reachable node.
    No step gathers a component in one task: minima are partial aggregates,
    and the joins on a node are ordinary joins that AQE can split.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        low = now.groupBy("hi").agg(F.min("lo").alias("m"))
        large = (
            now.join(low.withColumnRenamed("hi", "lo"), "lo", "left")
            .select("hi", F.coalesce("m", "lo").alias("lo"))
            .distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialize(low.select("hi", F.col("m").alias("lo")).union(moved).distinct(), "edges")
        discard(now)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1]
