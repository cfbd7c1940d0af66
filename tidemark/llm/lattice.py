"""Vectors of whole numbers: what the clustering and the code compression share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Whole components are at most this large, so that a squared distance fits a long.
MOST = 2**27


def sound(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): each component x, as a double, becomes floor(scale * x).

    Vectors that are null or hold a null or non-finite component go, and so do
    those with a component beyond MOST / scale, whose squared distances no
    long holds. Other columns, whatever their names, are ignored.
    """
    has_label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), has_label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    base = base.where(sound(F.col("x")) & ~F.exists("x", lambda x: F.abs(x) > MOST / scale))
    return base.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def rows_of(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """The equally long lists of ``column`` as the rows of a matrix."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def lists(x: np.ndarray, kind) -> pa.ListArray:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1), kind))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x times y transposed, exactly: in doubles where these hold all sums."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), dtype=np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2**52:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def tally(groups: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and componentwise sums of each of the groups 0 .. k - 1."""
    counts, sums = np.bincount(groups, minlength=k), np.zeros((k, x.shape[1]), dtype=np.int64)
    order = np.argsort(groups, kind="stable")
    some = np.flatnonzero(counts)
    if len(some):
        sums[some] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[some])
    return counts, sums


def folded(partials: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One task's counts and sums, added up over its batches: (slot, n, sums) of the slots in use."""
    counts = sums = None
    for n, s in partials:
        counts, sums = (n.copy(), s.copy()) if counts is None else (counts + n, sums + s)
    if counts is not None and counts.any():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists(sums[used], pa.int64())], ["slot", "n", "sums"])


FOLDED = "slot long, n long, sums array<long>"


def moved(partials: DataFrame, now: np.ndarray) -> np.ndarray:
    """The rows of ``now`` replaced by floor(sum / count) of their slots; rows without any stay.

    The driver receives one number for each component of ``now``, whose size
    is a parameter of the method and doesn't grow with the table.
    """
    cells = partials.select("slot", "n", F.posexplode("sums").alias("i", "s"))
    wide = "decimal(38,0)"
    found = cells.groupBy("slot", "i").agg(F.sum(F.col("s").cast(wide)).alias("s"), F.sum("n").alias("n")).collect()
    out = now.copy()
    for r in found:
        out[r["slot"], r["i"]] = int(r["s"]) // r["n"]
    return out


def as_long(value) -> int | None:
    """A whole sum as a long, null where it doesn't fit."""
    return None if value is None or abs(int(value)) >= 2**63 else int(value)
