"""Features of the path that led to a bar, change-point pauses, analogues, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scans import BLOCK, running
from ..functions.windows import by_symbol, prior


def path_features(df: DataFrame, path: int = 3, velocity: int = 5, memory: int = 20, block: int = BLOCK) -> DataFrame:
    """state_age, prior_state, prior_path, entry_velocity and failed_breakouts of (symbol, pos, close, state).

    The velocity is measured where a run of a state begins and then carried
    forward over all later bars, also past a beginning without a value.
    """
    w, c = by_symbol(), F.col
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(~c("state").eqNullSafe(F.lag("state").over(w)), F.lit(True)) | (F.lag("pos").over(w).isNull())
    df = df.withColumn("_begins", begins.cast("int"))
    df = running(df, ["symbol"], "pos", {"_run": ("sum", F.col("_begins"))}, block)
    past = F.lag("close", velocity).over(w)
    moved = F.when(c("_begins") == 1, F.abs(c("close") - past) / F.nullif(past, F.lit(0.0)))
    prior_path = F.concat_ws(">", *[F.lag("state", k).over(w).cast("string") for k in range(path, 0, -1)])
    df = df.withColumns(
        {
            "state_age": F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("pos")),
            "prior_state": F.lag("state").over(w),
            "prior_path": F.when(F.row_number().over(w) > path, prior_path),
            "_moved": moved,
            "failed_breakouts": F.coalesce(F.sum(F.when(c("state") == 9, 1).otherwise(0)).over(prior(memory)), F.lit(0)),
        }
    )
    df = df.withColumn("entry_velocity", F.last("_moved", ignorenulls=True).over(so_far))
    return df.drop("_begins", "_run", "_moved")


def pause_after(df: DataFrame, flag: str, bars: int) -> DataFrame:
    """Whether a change-point lies within the last ``bars`` bars, the current one included."""
    seen = F.max(F.col(flag).cast("int")).over(by_symbol().rowsBetween(-(bars - 1), 0))
    return df.withColumn("pause_active", F.coalesce(seen, F.lit(0)) == 1)


def path_index(df: DataFrame, key: str, window: int = 5) -> DataFrame:
    """Every run of ``window`` keys: (symbol, path, start)."""
    frame = by_symbol().rowsBetween(0, window - 1)
    keyed = df.select("symbol", F.col("pos").alias("start"), F.collect_list(F.col(key).cast("string")).over(frame).alias("path"))
    return keyed.where(F.size("path") == window)


def analogues(queries: DataFrame, index: DataFrame, top_n: int = 5) -> DataFrame:
    """The first ``top_n`` starts of each query path (symbol, path) in its symbol's index."""
    first = Window.partitionBy("symbol", "path").orderBy("start")
    kept = index.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top_n)
    return queries.distinct().join(kept, ["symbol", "path"])


def analogue_outcomes(found: DataFrame, returns: DataFrame, horizon: int = 5) -> DataFrame:
    """The value at start + horizon of each match: counted from the path's start, null past the end."""
    later = returns.select("symbol", (F.col("pos") - horizon).alias("start"), F.col("value").alias("outcome"))
    return found.join(later, ["symbol", "start"], "left")


def asset_features(bars: DataFrame) -> DataFrame:
    """How each symbol behaves: volatility, persistence, reversals, volume stability, mean return."""
    w = by_symbol()
    df = bars.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("before", F.lag("r").over(w))
    turns = df.where("r <> 0").withColumn("_s", F.signum("r"))
    turns = turns.withColumn("_t", (F.col("_s") != F.lag("_s").over(w)).cast("double")).groupBy("symbol").agg(F.avg("_t").alias("reversal_frequency"))
    spread = F.stddev_pop("volume") / F.nullif(F.avg("volume"), F.lit(0.0))
    base = df.groupBy("symbol").agg(
        (F.stddev_pop("r") * 252**0.5).alias("realized_volatility"),
        # A pair needs both returns.
        F.corr(F.when(F.col("before").isNotNull(), F.col("r")), F.col("before")).alias("trend_persistence"),
        F.when(F.count("volume") >= 2, 1 / (1 + spread)).alias("volume_stability"),
        F.avg("r").alias("average_return"),
    )
    return base.join(turns, "symbol", "left")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """The symbols of each cluster, in order, as one text."""
    names = F.array_join(F.array_sort(F.collect_list("symbol")), ", ")
    return clusters.groupBy("cluster").agg(names.alias("symbols"), F.count(F.lit(1)).alias("n"))


def cluster_assets(features: DataFrame, k: int = 3) -> DataFrame:
    """Equal slices of the symbols by volatility, then reversal frequency."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.orderBy("realized_volatility", "reversal_frequency", "symbol")  # one row a symbol
    rank, n = F.row_number().over(order) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    cluster = F.least(F.floor(rank * k / n), F.lit(k - 1)).cast("int")
    return features.withColumn("cluster", cluster)
