"""Vector code compression: a product code found by annular norm pruning.

Vectors of whole numbers are cut into equal parts, and every part position has a
codebook. The entries of a codebook are sorted by norm. For each part the entry
nearest in norm gives a first distance d; no entry whose norm differs by more
than d can be nearer (nor equally near), so a binary search of the sorted norms
gives the range that is left, and its ends count. Only that annulus is compared,
by exact whole-number distances, and it shrinks as nearer entries are found.
Codebooks are moved to the floors of their parts' means in rounds; a task sends
counts and sums by entry, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches
from .lattice import FOLDED, folded, moved, rows_of, tally, whole

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry (ties: the lower
    index), and the number of distances taken."""
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    sorted_norms, own = norms[order], np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    right = np.minimum(np.searchsorted(sorted_norms, own), len(order) - 1)
    left = np.maximum(right - 1, 0)
    guess = np.where(np.abs(sorted_norms[left] - own) <= np.abs(sorted_norms[right] - own), left, right)
    best = order[guess].astype(np.int64)
    far = ((x - entries[best]) ** 2).sum(axis=1)
    taken = len(x)

    def reach(d: np.ndarray) -> np.ndarray:
        # A little wider than the root, as norms and roots are rounded: that only compares more.
        return np.sqrt(d.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + own * 1e-6)

    low, high = np.searchsorted(sorted_norms, own - reach(far)), np.searchsorted(sorted_norms, own + reach(far), side="right")
    for place, entry in enumerate(order.tolist()):
        at = np.flatnonzero((low <= place) & (place < high) & (guess != place))
        at = at[np.abs(sorted_norms[place] - own[at]) <= reach(far)[at]]
        if not len(at):
            continue
        d = ((x[at] - entries[entry]) ** 2).sum(axis=1)
        taken += len(at)
        nearer = (d < far[at]) | ((d == far[at]) & (entry < best[at]))
        far[at[nearer]], best[at[nearer]] = d[nearer], entry
    return best, far, taken


def _each(x: np.ndarray, books: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width, k = x.shape[1] // parts, len(books) // parts
    for p in range(parts):
        part = x[:, p * width : (p + 1) * width]
        best, far, _ = nearest(part, books[p * k : (p + 1) * k])
        yield p, part, best, far


def _round(books: np.ndarray, parts: int):
    k = len(books) // parts

    def tallies(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        both = [tally(best, part, k) for _, part, best, _ in _each(rows_of(batch), books, parts)]
        return np.concatenate([n for n, _ in both]), np.concatenate([s for _, s in both])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded(tallies(b) for b in batches if b.num_rows)

    return run


def _last(books: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.empty((batch.num_rows, parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p, _, best, far in _each(rows_of(batch), books, parts):
                codes[:, p] = best
                error += far
            text = codes.tobytes().hex()
            texts = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), texts, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Product codes of ``vectors`` (vec_id, embedding, label), and the codebooks
    as rows by part and entry.

    Vectors that are null or hold a null or non-finite component (or one beyond
    lattice.MOST / scale) go. Each component x becomes floor(scale * x). A
    codebook starts as its part of the vectors with the smallest vec_ids (null
    ones last; of rows that share an id, in the order of their components);
    fewer vectors make fewer entries. Returns (vec_id, label, code, error): two hexadecimal
    digits a part, and the squared distances summed. Distance ties go to the
    lower index; repeated rows are vectors of their own. The vectors' length is
    that of the first one that can be cut into ``parts``; rows of another length
    come out with null code and error. An empty table gives no rows. Other
    columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    small_batches(vectors.sparkSession)
    kept = materialize(whole(vectors, scale), "whole-vectors")
    order = (F.col("vec_id").asc_nulls_last(), "v")
    one = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).select("v").first()
    size = len(one["v"]) if one else parts
    own = kept.where(F.size("v") == size)
    first = np.array([r["v"] for r in own.orderBy(*order).limit(entries).collect()], dtype=np.int64).reshape(-1, size)
    books = np.concatenate([first[:, p * size // parts : (p + 1) * size // parts] for p in range(parts)])
    if len(books):
        for _ in range(rounds):
            books = moved(own.select("v").mapInArrow(_round(books, parts), FOLDED), books)
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    found = own.mapInArrow(_last(books, parts), schema)
    rest = kept.where(F.size("v") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return materialize(found.unionByName(rest), "codes"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    # Sums beyond a long are null. A stored table: Spark broadcasts it only if it is small.
    summed = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    summed = materialize(summed.select(F.col("label").alias("of"), F.expr("try_cast(s AS long)").alias("label_error")), "label-errors")
    joined = found.join(summed, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    ctes = [
        f"""kept AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cells AS MATERIALIZED (SELECT rid, (i - 1) // w AS p, (i - 1) % w AS i, x FROM (
          SELECT rid, len(v) // {parts} AS w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept))""",
        f"""b0 AS MATERIALIZED (SELECT e, p, i, x FROM cells JOIN (
          SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < {entries}) USING (rid))""",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"""n{n} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
              SELECT t.rid, t.p, b.e, CAST(sum((t.x - b.x) * (t.x - b.x)) AS BIGINT) AS d FROM cells t JOIN b{n} b ON b.p = t.p AND b.i = t.i GROUP BY ALL) GROUP BY ALL)"""
        )
        if n < rounds:
            ctes.append(
                f"""b{n + 1} AS MATERIALIZED (SELECT b.e, b.p, b.i, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
                  SELECT a.e, a.p, t.i, CAST((sum(t.x) - ((sum(t.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
                  FROM n{n} a JOIN cells t ON t.rid = a.rid AND t.p = a.p GROUP BY ALL) m ON m.e = b.e AND m.p = b.p AND m.i = b.i)"""
            )
    return f"""WITH {", ".join(ctes)}, made AS (
      SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY rid)
    SELECT k.vec_id, m.code, m.error, CAST(sum(m.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256 FROM made m JOIN kept k ON k.rid = m.rid"""


OP13_SQL = _sql()
