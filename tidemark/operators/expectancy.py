"""What bars return after each state: expectancy tables, walk-forward values, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import COST_BPS, HORIZONS
from ..functions.windows import by_symbol, quotient


def forward_return(h: int, close: str = "close") -> Column:
    if h < 1:
        raise ValueError("horizon must be at least 1")
    return quotient(F.lead(close, h).over(by_symbol()), F.col(close)) - 1


def with_horizons(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per bar and horizon with its forward return ``r`` (bars without one are left out).

    All horizons are ``lead`` on one sort; the rows are multiplied only afterwards.
    """
    pairs = [F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("r")) for h in horizons]
    df = df.withColumns({f"_r{h}": forward_return(h) for h in horizons})
    df = df.withColumn("_p", F.explode(F.array(*pairs)))
    df = df.withColumns({"horizon": F.col("_p.horizon"), "r": F.col("_p.r")})
    return df.drop("_p", *[f"_r{h}" for h in horizons]).where("r IS NOT NULL")


def state_stats(cost_bps: float = COST_BPS) -> list[Column]:
    """Aggregates of forward returns ``r``; a zero return is neither win nor loss."""
    r, n = F.col("r"), F.count("r")
    mean, half = F.avg("r"), 1.96 * F.stddev_samp("r") / F.sqrt(n)
    return [
        n.alias("n"),
        mean.alias("mean_return"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
        (mean - half).alias("ci_low"),
        (mean + half).alias("ci_high"),
        (mean - cost_bps / 1e4).alias("ev_after_cost"),
    ]


def expectancy(df: DataFrame, keys: list[str], horizons: tuple[int, ...] = HORIZONS, cost_bps: float = COST_BPS) -> DataFrame:
    """Long expectancy table by ``keys`` and horizon. ``df``: symbol, pos, close
    and the keys; rows with a null key count for no group."""
    found = with_horizons(df, horizons).dropna(subset=keys)
    return found.groupBy(*keys, "horizon").agg(*state_stats(cost_bps))


def expectancy_wide(long: DataFrame, keys: list[str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The long table with a set of columns for each horizon."""
    values = [F.first(c).alias(c) for c in ("n", "mean_return", "win_rate", "ev_after_cost")]
    wide = long.groupBy(*keys).pivot("horizon", list(horizons)).agg(*values)
    return wide.select(*keys, *[F.col(f"{h}_{c}").alias(f"{c}_{h}") for h in horizons for c in ("n", "mean_return", "win_rate", "ev_after_cost")])


def expected_value(probs: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Probability-weighted value of a forecast (keys, state, p) over a payoff
    table (keys, state, ev_after_cost). States without a value are left out and
    the rest is not scaled up: ``coverage`` says how much was counted."""
    joined = probs.join(table.where("ev_after_cost IS NOT NULL"), [*keys, "state"], "left")
    known = F.col("ev_after_cost").isNotNull()
    return joined.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("ev_after_cost")).alias("expected_value"),
        F.coalesce(F.sum(F.when(known, F.col("p"))), F.lit(0.0)).alias("coverage"),
    )


def walkforward(df: DataFrame, horizon: int = 5, lookback: int = 252, min_samples: int = 5, cost_bps: float = COST_BPS) -> DataFrame:
    """Each bar's expected value from earlier bars of its own state.

    The training bars of position p are p - horizon - lookback .. p - horizon - 1,
    whose forward returns were known at p. One range window over (symbol, state)
    does it; no bar is joined to its history.
    """
    df = df.withColumn("r", forward_return(horizon))
    frame = Window.partitionBy("symbol", "state").orderBy("pos").rangeBetween(-(horizon + lookback), -(horizon + 1))
    out = df.where("state IS NOT NULL").withColumns(
        {"train_count": F.count("r").over(frame), "train_mean": F.avg("r").over(frame)}
    )
    value = F.when(F.col("train_count") >= min_samples, F.col("train_mean") - cost_bps / 1e4)
    return out.where(F.col("pos") >= horizon + min_samples).withColumn("ev_after_cost", value).drop("r", "train_mean")


def sensitivity_summary(grid: DataFrame, metric: str = "sharpe") -> DataFrame:
    """How a metric spreads over a parameter grid, per symbol."""
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75)))
    return grid.groupBy("symbol").agg(
        F.count(metric).alias("n"),
        F.median(metric).alias("median"),
        F.stddev_samp(metric).alias("spread"),
        (q[1] - q[0]).alias("iqr"),
        F.min(metric).alias("lowest"),
        F.max(metric).alias("highest"),
        F.avg((F.col(metric) < 0).cast("double")).alias("share_negative"),
    )
