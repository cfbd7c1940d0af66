"""Rolling indicators. All share one (symbol, pos) window order: one shuffle, one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.windows import by_symbol, guarded, quotient, ratio, trailing
from ..sources.bars import require

EMA_BLOCK = 1000


def sma(column: str, n: int) -> Column:
    return guarded(F.avg(column).over(trailing(n)), F.col(column), trailing(n), n)


def compensated_sma(column: str, n: int) -> Column:
    """:func:`sma` from a compensated sum, so that what is compared with it doesn't hang on the order in which values are added."""

    def add(acc: Column, x: Column) -> Column:
        before, total = acc["total"], acc["total"] + x
        lost = F.when(F.abs(before) >= F.abs(x), (before - total) + x).otherwise((x - total) + before)
        return F.struct(total.alias("total"), (acc["lost"] + lost).alias("lost"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    total = F.aggregate(F.collect_list(column).over(trailing(n)), start, add, lambda acc: acc["total"] + acc["lost"])
    return guarded(total / n, F.col(column), trailing(n), n)


def zscore(column: str, n: int) -> Column:
    """Distance from the rolling mean in sample deviations; null where the deviation is zero."""
    x = ratio(F.col(column) - F.avg(column).over(trailing(n)), F.stddev_samp(column).over(trailing(n)))
    return guarded(x, F.col(column), trailing(n), n)


def with_ema(df: DataFrame, n: int, out: str) -> DataFrame:
    """Exponential mean seeded with the first close, as a closed form by blocks.

    ema[t] = b^t x[0] + a sum b^(t-i) x[i]. Powers are taken within blocks of
    EMA_BLOCK bars; a block's carry is the block before's last value, whose own
    carry has decayed below double precision (b^1000 is under 1e-22 for n <= 38).
    """
    a, b = 2 / (n + 1), (n - 1) / (n + 1)
    if b**EMA_BLOCK > 1e-18:
        raise ValueError("ema window too long for its block size")
    df = df.withColumn("_block", F.floor(F.col("pos") / EMA_BLOCK)).withColumn("_off", F.col("pos") % EMA_BLOCK)
    weight = F.when(F.col("pos") == 0, F.col("close")).otherwise(a * F.col("close")) * F.pow(F.lit(b), -F.col("_off"))
    inside = Window.partitionBy("symbol", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_own", F.pow(F.lit(b), F.col("_off")) * F.sum(weight).over(inside))
    last = F.when(F.col("_off") == EMA_BLOCK - 1, F.col("_own"))
    carry = F.last(last, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    value = F.col("_own") + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(b), F.col("_off") + 1)
    return df.withColumn(out, F.when(F.col("pos") >= n - 1, value)).drop("_block", "_off", "_own")


def add_indicators(bars: DataFrame) -> DataFrame:
    """Append the indicator columns to ``bars``; null until a window is full."""
    require(bars, "symbol", "pos", "open", "high", "low", "close", "volume")
    w = by_symbol()
    close, before = F.col("close"), F.lag("close").over(w)
    df = with_ema(bars, 20, "ema_20")
    df = df.withColumn(
        "_tr",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
    ).withColumn("_move", close - before)
    df = df.withColumn("_gain", F.greatest("_move", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_move"), F.lit(0.0)))
    for n in (1, 5, 10):
        df = df.withColumn(f"return_{n}d", quotient(close, F.lag("close", n).over(w)) - 1)
    f14, f20 = trailing(14), trailing(20)
    gain, loss = F.avg("_gain").over(f14), F.avg("_loss").over(f14)
    # A window without gains is 0 even when it has no losses either.
    rsi = F.when(gain == 0, 0.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    df = df.withColumns(
        {
            "sma_20": sma("close", 20),
            "sma_50": sma("close", 50),
            "sma_200": sma("close", 200),
            "atr_14": sma("_tr", 14),
            "rsi_14": F.when((F.count("_move").over(f14) == 14), rsi),
            "bb_width_20": guarded(ratio(4 * F.stddev_samp("close").over(f20), F.avg("close").over(f20)), close, f20, 20),
            "realized_vol_20": guarded(F.stddev_samp("return_1d").over(f20) * (252**0.5), F.col("return_1d"), f20, 20),
            "volume_zscore_20": zscore("volume", 20),
        }
    )
    df = df.withColumns({f"dist_to_sma_{n}": ratio(close - F.col(f"sma_{n}"), F.col("atr_14")) for n in (20, 50, 200)})
    return df.drop("_tr", "_move", "_gain", "_loss")
