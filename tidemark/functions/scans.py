"""Running values of long groups by blocks: a group is many tasks' work.

A group's rows are cut into blocks along their order. Each block's total is one
row; the totals of the blocks before a block are its carry, which is joined
back to the running values inside it. No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block.
BLOCK = 4096
#: By kind: the aggregate of a block, and how a carry and a running value inside a block combine.
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
    "max": (F.max, F.greatest),
}


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each of its null-safe ``keys``."""
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(other, cond).drop(*[f"_of_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], at: str, values: dict[str, tuple[str, Column]], block: int = BLOCK, bucket: Column | None = None) -> DataFrame:
    """Add running values up to and with each row: {name: (kind, column)}, kinds "sum", "product", "max".

    ``at`` orders the rows of a key; blocks are ranges of ``block`` of its values,
    or ``bucket``, which must not decrease with it. Nulls are passed over. ``df`` is read twice.
    """
    df = df.withColumn("_block", F.floor(F.col(at) / block) if bucket is None else bucket)
    own = [*keys, "_block"]
    totals = df.groupBy(*own).agg(*[KINDS[kind][0](v).alias(f"_{name}") for name, (kind, v) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    carries = totals.select(*own, *[KINDS[kind][0](f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in values.items()])
    inside = Window.partitionBy(*own).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({name: KINDS[kind][0](v).over(inside) for name, (kind, v) in values.items()})
    joined = _matched(local, carries, own)
    out = joined.withColumns({name: KINDS[kind][1](F.col(f"_{name}"), F.col(name)) for name, (kind, _) in values.items()})
    return out.drop("_block", *[f"_{name}" for name in values])


def numbered(df: DataFrame, keys: list[str], at: str, out: str, block: int = BLOCK, bucket: Column | None = None) -> DataFrame:
    """Add ``out``: the 0-based number of each row among its key's by ``at``."""
    found = running(df, keys, at, {out: ("sum", F.lit(1))}, block, bucket)
    return found.withColumn(out, (F.col(out) - 1).cast("int"))


def blocked(df: DataFrame, at: str, block: int, overlap: int) -> DataFrame:
    """Cut rows numbered by ``at`` into blocks together with the ``overlap`` rows
    before each; ``own`` marks those a block answers for."""
    own = F.floor(F.col(at) / block)
    reach = F.sequence(own, F.floor((F.col(at) + overlap) / block))
    return df.withColumn("block", F.explode(reach)).withColumn("own", F.col("block") == own)
