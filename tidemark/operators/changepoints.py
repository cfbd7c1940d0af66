"""Change-points: the optimal penalised segmentation of a series under a Gaussian kernel.

Segments begin and end at multiples of ``jump`` (the series may end anywhere)
and hold ``min_size`` values or more. A segment of m values costs m minus the
mean of its m rows of kernel sums; each segment but the first costs ``penalty``
more. The kernel's width is the median squared difference of all pairs, and
scaled squares are held between two bounds. Among equal costs the earlier start
wins.

A series of up to ``WHOLE`` values is one task's work. Longer ones are cut into
blocks that are segmented in rounds: whatever start lies in an earlier block,
its cost at all ends of the current block is known from block against block
kernel sums, each pair of blocks a task of its own, so only the minima by end
reach the task that goes through the current block. Starts that can't win any
more are dropped from the carried table after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scans import numbered
from ..sources import storage

#: Values of a series that one task segments, and of a block of a longer one.
WHOLE, BLOCK = 32_768, 4_096
# Bounds of the scaled squares.
LEAST, MOST = 1e-2, 1e2


def _ranked_gap(ordered: np.ndarray, rank: int) -> float:
    """The ``rank``-th smallest (from 1) distance between two of the sorted values, without all the pairs."""
    at = np.arange(len(ordered))

    def within(gap: float) -> int:
        return int((np.searchsorted(ordered, ordered + gap, side="right") - at - 1).sum())

    if within(0.0) >= rank:
        return 0.0
    low, high = 0.0, 2 * float(ordered[-1] - ordered[0])
    while low < (middle := (low + high) / 2) < high and high - low > 1e-15 * high:
        low, high = (low, middle) if within(middle) >= rank else (middle, high)
    return high


def median_square(x: np.ndarray) -> float:
    """Median of the squared differences of all pairs."""
    ordered, pairs = np.sort(x), len(x) * (len(x) - 1) // 2
    one = _ranked_gap(ordered, (pairs + 1) // 2)
    two = one if pairs % 2 else _ranked_gap(ordered, pairs // 2 + 1)
    return (one * one + two * two) / 2


def kernel(squares: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-np.clip(squares / width, LEAST, MOST))


def cell_sums(a: np.ndarray, b: np.ndarray, width: float, jump: int) -> np.ndarray:
    """Kernel sums of the cells of ``jump`` values of ``a`` (rows) against those of ``b``, a strip of ``b`` at a time."""
    rows, out = np.arange(0, len(a), jump), []
    for first in range(0, len(b), 64 * jump):
        strip = b[first : first + 64 * jump]
        table = kernel((a[:, None] - strip[None, :]) ** 2, width)
        out.append(np.add.reduceat(np.add.reduceat(table, rows, axis=0), np.arange(0, len(strip), jump), axis=1))
    return np.concatenate(out, axis=1)


def own_sums(x: np.ndarray, width: float, jump: int) -> np.ndarray:
    """:func:`cell_sums` of a block against itself; a value's kernel with itself is one."""
    out = cell_sums(x, x, width, jump)
    sizes = np.minimum(jump, len(x) - np.arange(len(out)) * jump)
    out[np.diag_indices(len(out))] += sizes * (1 - np.exp(-LEAST))
    return out


def _check(min_size: int, penalty: float, jump: int) -> None:
    if min_size < 1 or penalty <= 0 or jump < 1:
        raise ValueError("min_size and jump must be at least 1 and penalty positive")


def segment_block(
    x: np.ndarray, first: int, edge: float, outside: np.ndarray, outside_from: np.ndarray, width: float, min_size: int, penalty: float, jump: int, probe: int
) -> tuple[np.ndarray, ...]:
    """Go through the ends of one block that begins at ``first``.

    ``edge`` is the best cost of what lies before it; ``outside`` and
    ``outside_from`` are the least costs of segments from earlier blocks to each
    end, and their starts. Returns the best cost and start by end; then for the
    block's own starts their kernel sums up to the block's end and their costs
    at end number ``probe`` (minus infinity where that is too near).
    """
    sums = own_sums(x, width, jump)
    cells = len(sums)
    starts = first + np.arange(cells) * jump
    ends = np.minimum(starts + jump, first + len(x))
    inside, best, last = np.zeros(cells), np.full(cells, np.inf), np.zeros(cells, dtype=np.int64)
    before, told = np.concatenate([[edge], np.empty(cells - 1)]), np.full(cells, -np.inf)
    for m in range(cells):
        column = sums[: m + 1, m]
        inside[: m + 1] += 2 * column[::-1].cumsum()[::-1] - column[m]
        # Starts at least min_size before this end.
        ready = min(m + 1, max(0, (int(ends[m]) - min_size - first) // jump + 1))
        best[m], last[m] = outside[m], outside_from[m]
        if ready:
            size = ends[m] - starts[:ready]
            values = before[:ready] + size - inside[:ready] / size
            i = int(values.argmin())
            if values[i] < best[m]:
                best[m], last[m] = values[i], starts[i]
            if m == probe:
                told[:ready] = values
        best[m] += penalty
        if m + 1 < cells:
            before[m + 1] = best[m]
    return best, last, before, inside, told


def traced(last: np.ndarray, n: int, jump: int) -> list[int]:
    """First positions of the segments after the first, from the best start of each end."""
    found, b = [], n
    while (b := int(last[-(-b // jump) - 1])) > 0:
        found.append(b)
    return found[::-1]


def change_points(x: np.ndarray, min_size: int = 20, penalty: float = 3.0, jump: int = 5) -> list[int]:
    """The first positions of new segments of one series; none for fewer than twice ``min_size`` values.

    Memory is linear: the kernel sums of all open segments are carried from end
    to end. A start whose cost at some end exceeds the best one there with its
    penalty can't win from ``min_size`` values later on, and is dropped then.
    """
    _check(min_size, penalty, jump)
    n = len(x)
    if n < 2 * min_size:
        return []
    width = median_square(x) or 1.0
    cells = -(-n // jump)
    inside, before, last = np.zeros(cells), np.full(cells, np.inf), np.zeros(cells, dtype=np.int64)
    before[0], until, open_ = -penalty, np.full(cells, np.iinfo(np.int64).max), np.array([0])
    for m in range(cells):
        end, low = min((m + 1) * jump, n), int(open_[0]) if len(open_) else m
        piece = x[m * jump : end]
        column = cell_sums(x[low * jump : end], piece, width, jump)[:, 0]
        column[-1] += len(piece) * (1 - np.exp(-LEAST))
        inside[low : m + 1] += 2 * column[::-1].cumsum()[::-1] - column[-1]
        open_ = open_[until[open_] > end]
        ready = open_[open_ * jump <= end - min_size]
        best = np.inf
        if len(ready):
            size = end - ready * jump
            values = before[ready] + size - inside[ready] / size
            i = int(values.argmin())
            best, last[m] = values[i] + penalty, ready[i] * jump
            beaten = ready[values > best]
            until[beaten] = np.minimum(until[beaten], end + min_size)
        if m + 1 < cells:
            before[m + 1] = best
            if np.isfinite(best):
                open_ = np.append(open_, m + 1)
    return traced(last, n, jump)


def _long_points(rows: DataFrame, sizes: DataFrame, min_size: int, penalty: float, jump: int, block: int) -> DataFrame:
    """(symbol, i) of the change-points of the series in ``rows`` (symbol, i, v), of any length, in rounds of blocks.

    ``sizes`` is (symbol, n). The width's median and the way back along the
    best starts each read a series as one column of numbers in one task (8 and 2 bytes
    or so a value at the default ``jump``); kernel sums, costs and the
    carried table are spread over blocks.
    """
    spark = rows.sparkSession
    block = -(-max(block, 2 * min_size) // jump) * jump

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "width": [median_square(pdf["v"].to_numpy()) or 1.0]})

    widths = rows.select("symbol", "v").groupBy("symbol").applyInPandas(measured, "symbol string, width double")
    told = storage.stored(sizes.join(widths, "symbol"), "segment-sizes")
    one = rows.groupBy("symbol", F.floor(F.col("i") / block).cast("int").alias("j")).agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("x"))
    blocks = storage.stored(one.join(told, "symbol"), "segment-blocks")
    rounds = (told.agg(F.max("n")).first()[0] or 0) + block - 1

    def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                x, now = np.asarray(r.x), np.asarray(r.now)
                if r.j < r.k:
                    out.append(cell_sums(x, now, r.width, jump).sum(axis=0).cumsum())
                else:
                    square = own_sums(now, r.width, jump).cumsum(axis=0).cumsum(axis=1)
                    out.append(np.diagonal(square) / 2)
            yield pd.DataFrame({"symbol": pdf["symbol"], "j": pdf["j"], "t": out})

    def costs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                now, t = np.asarray(r.now), np.asarray(r.t)
                s = np.array([z["s"] for z in r.starts])
                before, inside = np.array([z["before"] for z in r.starts]), np.array([z["inside"] for z in r.starts])
                across = cell_sums(np.asarray(r.x), now, r.width, jump)[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)
                across = inside[:, None] + 2 * (across[(s - r.j * block) // jump] + t[None, :])
                ends = np.minimum(r.k * block + (np.arange(len(t)) + 1) * jump, r.k * block + len(now))
                size = ends[None, :] - s[:, None]
                values = np.where(size >= min_size, before[:, None] + size - across / np.maximum(size, 1), np.inf)
                i, probe = values.argmin(axis=0), values[:, min(r.probe, len(t) - 1)]
                probe = np.where(np.isfinite(probe), probe, -np.inf)
                out.append((r.symbol, r.j, values[i, np.arange(len(t))], s[i], [(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(s, before, across[:, -1], probe)]))
            yield pd.DataFrame(out, columns=["symbol", "j", "least", "at", "next"])

    def steps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                x = np.asarray(r.x)
                cells = -(-len(x) // jump)
                outside, at = np.full(cells, np.inf), np.zeros(cells, dtype=np.int64)
                for z in r.least if r.least is not None else ():
                    outside[z["m"]], at[z["m"]] = z["low"]["value"], z["low"]["s"]
                edge = -penalty if r.j == 0 else r.edge
                best, last, before, inside, probe = segment_block(x, r.j * block, edge, outside, at, r.width, min_size, penalty, jump, r.probe)
                own = [(r.j * block + q * jump, float(b), float(c), float(d)) for q, (b, c, d) in enumerate(zip(before, inside, probe)) if np.isfinite(b)]
                out.append((r.symbol, r.j, best, last, own))
            yield pd.DataFrame(out, columns=["symbol", "j", "best", "last", "next"])

    # The last end of a block that lies min_size before the first one of the next.
    probe = F.lit((block + jump - min_size) // jump - 1)
    next_type = "array<struct<s bigint, before double, inside double, probe double>>"
    ends, starts, spent = [], None, []
    for k in range(rounds // block):
        now = blocks.where(F.col("j") == k)
        if k:
            # Sums are needed from the first block that still has a start.
            since = starts.groupBy("symbol").agg(F.min("j").alias("since"))
            reach = F.explode(F.sequence(F.coalesce("since", F.lit(k)), F.lit(k))).alias("j")
            pairs = now.join(since, "symbol", "left").select("symbol", F.col("x").alias("now"), F.lit(k).alias("k"), reach)
            pairs = blocks.join(pairs, ["symbol", "j"])
            t = pairs.mapInPandas(totals, "symbol string, j int, t array<double>")
            after = t.select("symbol", "j", F.posexplode("t").alias("m", "t"))
            # The sums of the blocks between each block and the current one, and half the current one's own.
            nearer = Window.partitionBy("symbol", "m").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
            later = after.withColumn("t", F.coalesce(F.sum("t").over(nearer), F.lit(0.0)))
            later = later.groupBy("symbol", "j").agg(F.sort_array(F.collect_list(F.struct("m", "t")))["t"].alias("t"))
            rows_ = pairs.join(starts, ["symbol", "j"]).join(later, ["symbol", "j"]).withColumn("probe", probe)
            spent.append(storage.new_path(spark, "segment-costs"))
            costed = rows_.mapInPandas(costs, f"symbol string, j int, least array<double>, at array<bigint>, next {next_type}")
            found = storage.stored(costed, "segment-costs", spent[-1])
            low = found.select("symbol", F.posexplode(F.arrays_zip("least", "at")).alias("m", "z")).where("z.least < double('inf')")
            low = low.groupBy("symbol", "m").agg(F.min(F.struct(F.col("z.least").alias("value"), F.col("z.at").alias("s"))).alias("low"))
            least = low.groupBy("symbol").agg(F.collect_list(F.struct("m", "low")).alias("least"))
            edge = ends[-1].select("symbol", F.element_at("best", -1).alias("edge"))
            now = now.join(edge, "symbol").join(least, "symbol", "left")
        else:
            now = now.withColumns({"edge": F.lit(0.0), "least": F.lit(None).cast("array<struct<m int, low struct<value double, s bigint>>>")})
        done = now.withColumn("probe", probe).mapInPandas(steps, f"symbol string, j int, best array<double>, last array<bigint>, next {next_type}")
        ends.append(storage.stored(done, "segment-ends"))
        own = ends[-1].select("symbol", "j", "next")
        bound = ends[-1].select("symbol", F.get("best", probe).alias("bound"))
        carried = (found.select("symbol", "j", "next").unionByName(own) if k else own).join(bound, "symbol")
        kept = F.filter("next", lambda z: F.col("bound").isNull() | (z["probe"] <= F.col("bound")))
        carried = carried.select("symbol", "j", kept.cast(next_type).alias("next")).where(F.size("next") > 0)
        carried = carried.select("symbol", "j", F.transform("next", lambda z: z.dropFields("probe")).alias("starts"))
        home = storage.new_path(spark, "segment-starts")
        starts = storage.stored(carried, "segment-starts", home)
        for path in spent:
            storage.remove(spark, path)
        spent = [home]

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        last, n = np.concatenate([np.asarray(v) for v in pdf.sort_values("j")["last"]]), int(pdf["n"].iat[0])
        found = traced(last, n, jump)
        return pd.DataFrame({"symbol": pdf["symbol"].iat[0], "i": np.array(found, dtype=np.int32)}, columns=["symbol", "i"])

    none = spark.createDataFrame([], "symbol string, i int")
    if not ends:
        return none
    path = ends[0].select("symbol", "j", "last")
    for e in ends[1:]:
        path = path.unionByName(e.select("symbol", "j", "last"))
    return path.join(told.select("symbol", "n"), "symbol").groupBy("symbol").applyInPandas(back, "symbol string, i int")


def annotate_change_points(df: DataFrame, value: str = "return_1d", min_size: int = 20, penalty: float = 3.0, jump: int = 5, whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """(symbol, pos, is_changepoint) of the known values (no nulls, NaN or infinite ones)."""
    _check(min_size, penalty, jump)
    known = df.select("symbol", "pos", F.col(value).cast("double").alias("v")).where("abs(v) < double('inf')")
    known = numbered(known, ["symbol"], "pos", "i")
    sizes = known.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    known = storage.stored(known.join(sizes, "symbol"), "change-values")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = change_points(pdf.sort_values("i")["v"].to_numpy(), min_size, penalty, jump)
        return pd.DataFrame({"symbol": pdf["symbol"].iat[0], "i": np.array(found, dtype=np.int32)}, columns=["symbol", "i"])

    short = known.where((F.col("n") <= whole) & (F.col("n") >= 2 * min_size)).select("symbol", "i", "v")
    found = short.groupBy("symbol").applyInPandas(run, "symbol string, i int")
    longer = known.where((F.col("n") > whole) & (F.col("n") >= 2 * min_size))
    if not longer.isEmpty():
        found = found.unionByName(_long_points(longer.select("symbol", "i", "v"), longer.select("symbol", "n").distinct(), min_size, penalty, jump, block))
    flags = found.withColumn("is_changepoint", F.lit(True))
    return known.join(flags, ["symbol", "i"], "left").select("symbol", "pos", F.coalesce("is_changepoint", F.lit(False)).alias("is_changepoint"))
