"""Support and resistance levels, bar states and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.constants import STATE_LABELS
from ..functions.windows import by_symbol, guarded, prior, ratio
from ..sources.bars import bars, require
from .indicators import add_indicators

NEEDED = (
    "close", "sma_20", "sma_50", "atr_14", "bb_width_20", "nearest_support", "nearest_resistance",
    "support_zone_low", "support_zone_high", "resistance_zone_low", "resistance_zone_high",
    "dist_to_support_atr", "dist_to_resistance_atr",
)


def detect_levels(df: DataFrame, lookback: int = 126, atr_mult: float = 0.5) -> DataFrame:
    """Highest high and lowest low of the ``lookback`` bars before, with zones around them."""
    if lookback < 1 or atr_mult < 0:
        raise ValueError("lookback must be at least 1 and atr_mult at least 0")
    require(df, "high", "low", "close", "atr_14")
    frame, half = prior(lookback), atr_mult * F.col("atr_14")
    df = df.withColumns(
        {
            "nearest_resistance": guarded(F.max("high").over(frame), F.col("high"), frame, lookback),
            "nearest_support": guarded(F.min("low").over(frame), F.col("low"), frame, lookback),
        }
    )
    return df.withColumns(
        {
            "resistance_zone_low": F.col("nearest_resistance") - half,
            "resistance_zone_high": F.col("nearest_resistance") + half,
            "support_zone_low": F.col("nearest_support") - half,
            "support_zone_high": F.col("nearest_support") + half,
            "dist_to_resistance_atr": ratio(F.col("nearest_resistance") - F.col("close"), F.col("atr_14")),
            "dist_to_support_atr": ratio(F.col("close") - F.col("nearest_support"), F.col("atr_14")),
        }
    )


def label_states(df: DataFrame, proximity: float = 1.0, compression: float = 0.06, memory: int = 5) -> DataFrame:
    """Append ``state``: the first rule that holds, from the most telling down."""
    require(df, *NEEDED)
    w, c = by_symbol(), F.col
    broke = F.coalesce((c("close") > c("resistance_zone_high")).cast("int"), F.lit(0))
    df = df.withColumn("_broke", broke)
    df = df.withColumns(
        {
            "_recent": F.coalesce(F.max("_broke").over(prior(memory)), F.lit(0)) == 1,
            "_was_below": F.lag(c("close") < c("support_zone_low")).over(w),
        }
    )
    missing = c(NEEDED[0]).isNull()
    for name in NEEDED[1:]:
        missing = missing | c(name).isNull()
    trend = (c("close") > c("sma_20")) & (c("sma_20") >= c("sma_50"))
    in_resistance = c("close").between(c("resistance_zone_low"), c("resistance_zone_high"))
    near_top = c("dist_to_resistance_atr").between(0, proximity)
    rules = [
        (missing, 11),
        (c("close") < c("support_zone_low"), 4),
        (F.coalesce(c("_was_below"), F.lit(False)), 3),
        (c("_recent") & (c("close") < c("resistance_zone_low")), 9),
        (c("_recent") & in_resistance, 8),
        (c("_recent") & (c("close") > c("resistance_zone_high")) & trend, 10),
        (c("close") > c("resistance_zone_high"), 7),
        (c("close").between(c("support_zone_low"), c("support_zone_high")), 2),
        ((c("close") < c("resistance_zone_low")) & near_top & (c("bb_width_20") <= compression), 6),
        (near_top, 5),
        (c("dist_to_support_atr").between(0, proximity), 1),
    ]
    state = F.when(*_rule(rules[0]))
    for rule in rules[1:]:
        state = state.when(*_rule(rule))
    return df.withColumn("state", state.otherwise(0).cast("int")).drop("_broke", "_recent", "_was_below")


def _rule(rule):
    return rule[0], F.lit(rule[1])


def enrich(df: DataFrame, lookback: int = 126) -> DataFrame:
    return label_states(detect_levels(add_indicators(df), lookback))


def labelled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard labelled bars of the test tables."""
    return enrich(bars(spark, sf_dir))


def state_names(df: DataFrame, state: str = "state", out: str = "label") -> DataFrame:
    names = F.create_map(*[x for k, v in STATE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.try_element_at(names, F.col(state)))


def state_frequency(df: DataFrame) -> DataFrame:
    """Count and share of every state of a symbol, in percent to 4 places."""
    counts = df.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("symbol"))
    return state_names(counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 4)))


def rare_states(df: DataFrame, min_count: int = 30) -> DataFrame:
    """States seen fewer than ``min_count`` times in a symbol."""
    return df.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_count)
