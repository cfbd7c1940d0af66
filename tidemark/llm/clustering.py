"""Centroid clustering with kd-tree filtering, on whole numbers.

The vectors are stored once in blocks, each in the order of a kd-tree (halves
along the widest component), so that a tree node is a range of rows. In every
round a task reads its blocks, takes each node's count, component sums and
bounding box, and walks the tree from the top with the set of centroids that
may still be nearest: a centroid goes where the box's corner that is best for
it is strictly nearer to another one. A node with one centroid left is assigned
as a whole by its count and sums; rows of leaves with several are compared one
by one. All is whole-number arithmetic, so the result doesn't depend on blocks
or partitions. What leaves a task are counts and sums by centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches
from .lattice import FOLDED, as_long, folded, lists, moved, products, rows_of, tally, whole

SCALE, SIZE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
BLOCK_ROWS = 4096
LEAF_ROWS = 32


def levels(n: int) -> list[np.ndarray]:
    """Edges of the node ranges of each level: halves, down to some LEAF_ROWS rows."""
    out = [np.array([0, n])]
    while n > LEAF_ROWS:
        e = out[-1]
        both = np.empty(2 * len(e) - 1, dtype=np.int64)
        both[::2], both[1::2] = e, (e[:-1] + e[1:]) // 2
        out.append(both)
        n = -(-n // 2)
    return out


def kd_order(x: np.ndarray) -> np.ndarray:
    """Row order in which the ranges of :func:`levels` are the nodes of a kd-tree."""
    order, edges = np.arange(len(x)), levels(len(x))
    for above, below in zip(edges[:-1], edges[1:], strict=True):
        for a, m, b in zip(above[:-1], below[1::2], above[1:], strict=True):
            part = x[order[a:b]]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            order[a:b] = order[a:b][np.argpartition(part[:, axis], m - a)]
    return order


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row of a block in kd order (ties: the smaller
    number), and counts and sums by centroid, added by whole nodes where possible."""
    n, k = len(x), len(centroids)
    norms = (centroids**2).sum(axis=1)
    running = np.concatenate([np.zeros((1, x.shape[1]), dtype=np.int64), np.cumsum(x, axis=0)])
    out, counts, sums = np.full(n, -1), np.zeros(k, dtype=np.int64), np.zeros((k, x.shape[1]), dtype=np.int64)
    node, allowed = np.array([0]), np.ones((1, k), dtype=bool)
    edges = levels(n)
    for depth, e in enumerate(edges):
        low, high = np.minimum.reduceat(x, e[:-1])[node], np.maximum.reduceat(x, e[:-1])[node]
        # Any centroid may serve as the judge; the one nearest to the box's middle removes most.
        middle = norms[None] - products(low + high, centroids)
        judge = np.where(allowed, middle, np.iinfo(np.int64).max).argmin(axis=1)
        way = centroids[None] - centroids[judge][:, None]
        best = np.where(way > 0, high[:, None], low[:, None])
        ahead = norms[None] - norms[judge][:, None] - 2 * (best * way).sum(axis=2)
        allowed &= ahead <= 0
        one = allowed.sum(axis=1) == 1
        for i, c in zip(node[one], allowed[one].argmax(axis=1), strict=True):
            a, b = e[i], e[i + 1]
            out[a:b] = c
            counts[c] += b - a
            sums[c] += running[b] - running[a]
        node, allowed = node[~one], allowed[~one]
        if depth + 1 < len(edges):
            node, allowed = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([allowed, allowed])
    if len(node):
        sizes = edges[-1][node + 1] - edges[-1][node]
        at = np.concatenate([np.arange(edges[-1][i], edges[-1][i + 1]) for i in node])
        far = norms[None] - 2 * products(x[at], centroids)
        own = np.where(np.repeat(allowed, sizes, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)
        out[at] = own
        c, s = tally(own, x[at], k)
        counts, sums = counts + c, sums + s
    return out, counts, sums


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = 0

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, x = pa.concat_arrays([p.column("vec_id") for p in parts]), np.concatenate([rows_of(p) for p in parts])
        order = kd_order(x)
        number = (TaskContext.get().partitionId() << 32) + made
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x), number)), ids.take(pa.array(order)), lists(x[order].astype(np.int32), pa.int32())], ["block", "vec_id", "v"]
        )

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK_ROWS - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == BLOCK_ROWS:
                yield block(held)
                held, n, made = [], 0, made + 1
    if held:
        yield block(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Runs of rows of one block: its ids and its matrix. A run may be a part of a block; its boxes are its own."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("block")[0].as_py() != int(number[a]):
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    return pa.concat_arrays([p.column("vec_id") for p in parts]), np.concatenate([rows_of(p) for p in parts])


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded(assign(x, centroids)[1:] for _, x in _blocks(batches))

    return run


def _last(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            own = assign(x, centroids)[0]
            far = ((x - centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Clusters of ``vectors`` (vec_id, embedding), and the final centroids.

    Kept are vectors of ``size`` components, none null or non-finite (nor
    beyond lattice.MOST / scale). Each component x becomes floor(scale * x).
    The first centroids are the kept vectors with the smallest hexadecimal
    SHA-256 of "seed:vec_id", in that order; a round assigns every vector to the
    nearest centroid and moves each to the floor of its mean. Returns (vec_id,
    cluster, distance) a kept row, the distance squared and to the final
    centroid. Ties go to the smaller number. Repeated rows are vectors of their
    own; rows that share a vec_id but not the vector start in the order of
    their components. A row without a vec_id takes part but starts no centroid
    unless there are fewer than k others. With fewer than k vectors there are
    fewer centroids; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    kept = whole(vectors, scale).where(F.size("v") == size).select("vec_id", "v")
    blocks = materialize(kept.mapInArrow(_order, "block long, vec_id long, v array<int>"), "kd-blocks")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = blocks.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    now = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), size)
    if len(now):
        for _ in range(rounds):
            now = moved(blocks.select("block", "v", "vec_id").mapInArrow(_round(now), FOLDED), now)
    found = blocks.mapInArrow(_last(now), "vec_id long, cluster int, distance long")
    return materialize(found, "clusters"), now


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = as_long(sum(sums.values()))
    told = [
        (c, as_long(s), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()
    ]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")  # a row a centroid
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "cells AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"""r0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
          SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}))""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
              SELECT t.rid, r.c, CAST(sum((t.x - r.x) * (t.x - r.x)) AS BIGINT) AS d FROM cells t JOIN r{n} r ON r.i = t.i GROUP BY ALL) GROUP BY rid)"""
        )
        if n < rounds:
            parts.append(
                f"""r{n + 1} AS MATERIALIZED (SELECT r.c, r.i, coalesce(m.x, r.x) AS x FROM r{n} r LEFT JOIN (
                  SELECT a.c, t.i, CAST((sum(t.x) - ((sum(t.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                  FROM a{n} a JOIN cells t ON t.rid = a.rid GROUP BY ALL) m ON m.c = r.c AND m.i = r.i)"""
            )
    return f"""WITH {", ".join(parts)}
    SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
    FROM a{rounds} a JOIN kept k ON k.rid = a.rid JOIN (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS s FROM r{rounds} GROUP BY c) h ON h.c = a.c"""


OP11_SQL = _sql()
