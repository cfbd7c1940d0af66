"""The registry: one query for each operator, with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import N_STATES, STATE_LABELS, VOL_LABELS
from ..functions.windows import by_symbol, quotient
from ..operators import backtest, changepoints, expectancy, markov, monitoring, paths, positions, regimes, states
from ..operators import forecast as fc
from ..operators import statistics as stats
from ..operators.indicators import add_indicators, compensated_sma
from ..sources.bars import bars, clean_bars, hourly_bars, missing_report
from ..sources.storage import stored
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_LABELLED: dict[tuple[str, str], DataFrame] = {}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled bars, kept for the session: most queries start from them, and
    those that join them to themselves would otherwise derive them again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LABELLED:
        columns = ("symbol", "date", "pos", "open", "close", "volume", "sma_50", "realized_vol_20", "state")
        _LABELLED[key] = states.labelled_bars(spark, sf_dir).select(*columns).persist()
    return _LABELLED[key]


def forget(spark: SparkSession) -> None:
    """Drop what :func:`labelled` keeps."""
    for df in _LABELLED.values():
        df.unpersist()
    _LABELLED.clear()


LAB = (o.BARS, o.INDICATORS, o.LABELLED)


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Bars and indicators


@register("daily_bars", o.query("SELECT * FROM bars", o.BARS))
def _(spark, sf):
    return bars(spark, sf)


@register(
    "hourly_bars",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL""",
)
def _(spark, sf):
    return hourly_bars(spark.read.parquet(f"{sf}/events.parquet"))


INDICATOR_COLUMNS = (
    "sma_20", "sma_50", "sma_200", "ema_20", "atr_14", "rsi_14", "bb_width_20", "return_1d", "return_5d", "return_10d",
    "realized_vol_20", "volume_zscore_20", "dist_to_sma_20", "dist_to_sma_50", "dist_to_sma_200",
)


@register("indicators", o.query(f"SELECT symbol, date, pos, {', '.join(f'round({c}, 8) AS {c}' for c in INDICATOR_COLUMNS)} FROM ind", o.BARS, o.INDICATORS))
def _(spark, sf):
    return rounded(add_indicators(bars(spark, sf)).select("symbol", "date", "pos", *INDICATOR_COLUMNS), *INDICATOR_COLUMNS, places=8)


LEVEL_COLUMNS = (
    "nearest_support", "nearest_resistance", "support_zone_low", "support_zone_high", "resistance_zone_low",
    "resistance_zone_high", "dist_to_support_atr", "dist_to_resistance_atr",
)


@register("levels", o.query(f"SELECT symbol, date, pos, {_r(*LEVEL_COLUMNS)} FROM lv", o.BARS, o.INDICATORS, o.LABELLED))
def _(spark, sf):
    df = states.detect_levels(add_indicators(bars(spark, sf)))
    return rounded(df.select("symbol", "date", "pos", *LEVEL_COLUMNS), *LEVEL_COLUMNS)


@register("bar_states", o.query("SELECT symbol, date, pos, close, state FROM lab", *LAB))
def _(spark, sf):
    return labelled(spark, sf).select("symbol", "date", "pos", "close", "state")


LABEL_CASE = "CASE state " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATE_LABELS.items()) + " END"


@register(
    "state_frequency",
    o.query(
        f"""SELECT symbol, state, n, round(100.0 * n / sum(n) OVER (PARTITION BY symbol), 4) AS percent, {LABEL_CASE} AS label
        FROM (SELECT symbol, state, count(*) AS n FROM lab GROUP BY ALL)""",
        *LAB,
    ),
)
def _(spark, sf):
    return states.state_frequency(labelled(spark, sf))


@register("rare_states", o.query("SELECT symbol, state, count(*) AS n FROM lab GROUP BY ALL HAVING count(*) < 30", *LAB))
def _(spark, sf):
    return states.rare_states(labelled(spark, sf))


# Cleaning and provider checks


def vendor_rows(spark, sf):
    """Order days as vendor rows: repeated dates, a late row without a close."""
    b = bars(spark, sf)
    first = b.withColumn("ingest_seq", F.lit(1).cast("long"))
    again = b.where("pos % 7 = 0").withColumns({"ingest_seq": F.lit(2).cast("long"), "close": F.col("close") + 1})
    empty = b.where("pos % 21 = 0").withColumns({"ingest_seq": F.lit(3).cast("long"), "close": F.lit(None).cast("double")})
    return first.unionByName(again).unionByName(empty).drop("pos")


VENDOR = """
vendor AS (
  SELECT symbol, date, open, high, low, close, volume, 1 AS seq FROM bars
  UNION ALL SELECT symbol, date, open, high, low, close + 1, volume, 2 FROM bars WHERE pos % 7 = 0
  UNION ALL SELECT symbol, date, open, high, low, NULL, volume, 3 FROM bars WHERE pos % 21 = 0
)"""


@register(
    "clean_bars",
    o.query(
        """SELECT upper(trim(symbol)) AS symbol, date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS pos,
        open, high, low, close, volume FROM (
          SELECT * FROM vendor QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1) WHERE close IS NOT NULL""",
        o.BARS,
        VENDOR,
    ),
)
def _(spark, sf):
    return clean_bars(vendor_rows(spark, sf))


@register(
    "missing_report",
    o.query(
        """SELECT symbol, count(*) AS n_rows, 5 AS n_columns, count(*) - count(close) AS total_missing, CAST(0 AS BIGINT) AS missing_open,
        CAST(0 AS BIGINT) AS missing_high, CAST(0 AS BIGINT) AS missing_low, count(*) - count(close) AS missing_close,
        CAST(0 AS BIGINT) AS missing_volume FROM vendor GROUP BY symbol""",
        o.BARS,
        VENDOR,
    ),
)
def _(spark, sf):
    return missing_report(vendor_rows(spark, sf), ["open", "high", "low", "close", "volume"])


@register(
    "source_summary",
    o.query(
        """SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(*) - count(close) AS missing_close,
        count(*) AS missing_vwap FROM vendor GROUP BY symbol""",
        o.BARS,
        VENDOR,
    ),
)
def _(spark, sf):
    return monitoring.summarize_source(vendor_rows(spark, sf), ["close", "vwap"])


def second_provider(spark, sf):
    b = bars(spark, sf).where("pos % 10 <> 3")
    moved = F.when(F.col("pos") % 5 == 0, F.col("close") + 0.5).otherwise(F.col("close"))
    return b.select("symbol", F.date_add("date", F.when(F.col("pos") % 50 == 7, 5000).otherwise(0)).alias("date"), moved.alias("close"), (F.col("volume") + (F.col("pos") % 2)).alias("volume"))


@register(
    "provider_comparison",
    o.query(
        """SELECT coalesce(a.symbol, b.symbol) AS symbol, count(*) FILTER (a.date IS NOT NULL AND b.date IS NOT NULL) AS overlap,
        count(*) FILTER (b.date IS NULL) AS left_only, count(*) FILTER (a.date IS NULL) AS right_only,
        count(*) FILTER (abs(a.close - b.close) > 0.01) AS close_mismatches, count(*) FILTER (abs(a.volume - b.volume) > 0) AS volume_mismatches,
        round(max(abs(a.close - b.close)), 6) AS max_close_diff, round(avg(abs(a.close - b.close)), 6) AS mean_close_diff
        FROM bars a FULL OUTER JOIN other b ON a.symbol = b.symbol AND a.date = b.date GROUP BY 1""",
        o.BARS,
        """other AS (SELECT symbol, CAST(date + CASE WHEN pos % 50 = 7 THEN 5000 ELSE 0 END AS DATE) AS date,
           CASE WHEN pos % 5 = 0 THEN close + 0.5 ELSE close END AS close, volume + pos % 2 AS volume FROM bars WHERE pos % 10 <> 3)""",
    ),
)
def _(spark, sf):
    return rounded(monitoring.compare_sources(bars(spark, sf), second_provider(spark, sf)), "max_close_diff", "mean_close_diff")


# Expectancy

STATS_SQL = """count(r) AS n, round(avg(r), 6) AS mean_return, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round(avg(r) FILTER (r > 0), 6) AS avg_win, round(avg(r) FILTER (r < 0), 6) AS avg_loss,
  round(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(r)), 6) AS ci_low, round(avg(r) + 1.96 * stddev_samp(r) / sqrt(count(r)), 6) AS ci_high,
  round(avg(r) - 0.0005, 6) AS ev_after_cost"""
STAT_COLUMNS = ("mean_return", "win_rate", "avg_win", "avg_loss", "ci_low", "ci_high", "ev_after_cost")


@register("state_expectancy", o.query(f"SELECT symbol, state, horizon, {STATS_SQL} FROM fwd GROUP BY ALL", *LAB, o.FORWARD))
def _(spark, sf):
    return rounded(expectancy.expectancy(labelled(spark, sf), ["symbol", "state"]), *STAT_COLUMNS)


WIDE_SQL = ", ".join(
    f"""count(r) FILTER (horizon = {h}) AS n_{h}, round(avg(r) FILTER (horizon = {h}), 6) AS mean_return_{h},
    round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (horizon = {h}), 6) AS win_rate_{h},
    round(avg(r) FILTER (horizon = {h}) - 0.0005, 6) AS ev_after_cost_{h}"""
    for h in (1, 5, 10, 20)
)


@register("state_expectancy_wide", o.query(f"SELECT state, {WIDE_SQL} FROM fwd GROUP BY state", *LAB, o.FORWARD))
def _(spark, sf):
    long = expectancy.expectancy(labelled(spark, sf), ["state"])
    wide = expectancy.expectancy_wide(long, ["state"])
    return rounded(wide, *[c for c in wide.columns if c[:2] in ("me", "wi", "ev")]).na.fill(0, [f"n_{h}" for h in (1, 5, 10, 20)])


@register(
    "conditioned_expectancy",
    o.query(
        f"SELECT f.symbol, vol_state, f.state, horizon, {STATS_SQL} FROM fwd f JOIN vol v ON f.symbol = v.symbol AND f.pos = v.pos GROUP BY ALL",
        *LAB, o.VOL, o.FORWARD,
    ),
)
def _(spark, sf):
    df = regimes.volatility_state(labelled(spark, sf))
    return rounded(expectancy.expectancy(df, ["symbol", "vol_state", "state"]), *STAT_COLUMNS)


FEATURES_SQL = """
ret AS (SELECT symbol, pos, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r FROM bars),
ret2 AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY pos) AS b FROM ret),
turns AS (
  SELECT symbol, avg(CASE WHEN s <> p THEN 1.0 ELSE 0.0 END) FILTER (p IS NOT NULL) AS reversal_frequency FROM (
    SELECT symbol, sign(r) AS s, lag(sign(r)) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM ret WHERE r <> 0) GROUP BY symbol
), feats AS (
  SELECT symbol, stddev_pop(r) * sqrt(252) AS realized_volatility, corr(r, b) FILTER (b IS NOT NULL) AS trend_persistence,
         1 / (1 + stddev_pop(volume) / avg(volume)) AS volume_stability, avg(r) AS average_return FROM ret2 GROUP BY symbol
), clus AS (
  SELECT f.*, reversal_frequency, CAST(least(floor((row_number() OVER (ORDER BY realized_volatility, reversal_frequency, f.symbol) - 1) * 3 / count(*) OVER ()), 2) AS INTEGER) AS cluster
  FROM feats f JOIN turns t ON f.symbol = t.symbol
)"""
FEATURE_COLUMNS = ("realized_volatility", "trend_persistence", "volume_stability", "average_return", "reversal_frequency")


@register("asset_clusters", o.query(f"SELECT symbol, {_r(*FEATURE_COLUMNS)}, cluster FROM clus", o.BARS, FEATURES_SQL))
def _(spark, sf):
    return rounded(paths.cluster_assets(paths.asset_features(bars(spark, sf))), *FEATURE_COLUMNS)


@register(
    "cluster_pooled_expectancy",
    o.query(f"SELECT cluster, state, horizon, {STATS_SQL} FROM fwd f JOIN clus c ON f.symbol = c.symbol GROUP BY ALL", *LAB, o.FORWARD, FEATURES_SQL),
)
def _(spark, sf):
    clusters = paths.cluster_assets(paths.asset_features(bars(spark, sf))).select("symbol", "cluster")
    pooled = labelled(spark, sf).join(clusters, "symbol")
    return rounded(expectancy.expectancy(pooled, ["cluster", "state"]), *STAT_COLUMNS)


# Regimes


@register("volatility_states", o.query("SELECT symbol, pos, round(vol_rank, 6) AS vol_rank, vol_state FROM vol", *LAB, o.VOL))
def _(spark, sf):
    return rounded(regimes.volatility_state(labelled(spark, sf)).select("symbol", "pos", "vol_rank", "vol_state"), "vol_rank")


def macro(spark, sf):
    """One symbol as the index; its scaled volatility, on most of its dates, as the volatility index."""
    one = add_indicators(bars(spark, sf)).where("symbol = '1-URGENT'")
    vix = one.where("pos % 3 <> 1").select("date", (F.col("realized_vol_20") * 100).alias("vix"))
    return regimes.macro_regime(one.select("date", "close"), vix)


MACRO = """
spy AS (SELECT date, close, CASE WHEN pos % 3 <> 1 THEN realized_vol_20 * 100 END AS v FROM ind WHERE symbol = '1-URGENT'),
filled AS (
  SELECT date, close, last_value(v IGNORE NULLS) OVER (ORDER BY date) AS vix,
         CASE WHEN count(close) OVER w = 200 THEN avg(close) OVER w END AS ma FROM spy WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)
), macro AS (
  SELECT date, close, vix, CAST(CASE WHEN ma IS NULL THEN NULL WHEN close < ma OR coalesce(vix >= 25, false) THEN 1
         WHEN close > ma AND coalesce(vix <= 15, false) THEN 0 ELSE 2 END AS INTEGER) AS macro_regime FROM filled
)"""


@register("macro_regime", o.query("SELECT date, close, round(vix, 6) AS vix, macro_regime FROM macro", o.BARS, o.INDICATORS, MACRO))
def _(spark, sf):
    return rounded(macro(spark, sf), "vix")


@register(
    "macro_distribution",
    o.query("SELECT macro_regime, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM (SELECT macro_regime, count(*) AS n FROM macro GROUP BY 1)", o.BARS, o.INDICATORS, MACRO),
)
def _(spark, sf):
    return regimes.distribution(macro(spark, sf), "macro_regime")


@register("macro_filter", o.query("SELECT date, coalesce(macro_regime, -1) IN (0, 2) AS allowed FROM macro", o.BARS, o.INDICATORS, MACRO))
def _(spark, sf):
    return macro(spark, sf).select("date", regimes.regime_allowed(F.col("macro_regime"), [0, 2]).alias("allowed"))


def all_days(spark, sf):
    """Days of orders and events, and those of orders moved to another century and another decade."""
    days = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("day"))
    moved = days.select(F.explode(F.array(F.date_add("day", 36525), F.date_sub("day", 9000))))
    return days.union(moved).union(spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts"))).distinct()


def _calendar_sql() -> str:
    import datetime

    from ..functions.constants import EVENT_DATES

    def listed(days):
        return ", ".join(f"DATE '{d}'" for d in days)

    one = datetime.timedelta(days=1)
    near = sorted({d + s * one for d in regimes.holidays(1969, 2101) for s in (-1, 1) if (d + s * one).weekday() < 5})
    return f"""
    WITH days AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(ts AS DATE) FROM events
                  UNION SELECT CAST(o_orderdate AS DATE) + 36525 FROM orders UNION SELECT CAST(o_orderdate AS DATE) - 9000 FROM orders),
    cal AS (
      SELECT date_trunc('month', x)::DATE AS month, x FROM (SELECT CAST(unnest(generate_series(DATE '1969-01-01', DATE '2101-12-31', INTERVAL 1 DAY)) AS DATE) AS x)
    ), opex AS (SELECT month, x AS friday FROM (SELECT month, x, row_number() OVER (PARTITION BY month ORDER BY x) AS k FROM cal WHERE isodow(x) = 5) WHERE k = 3),
    ends AS (SELECT x FROM (SELECT x, row_number() OVER (PARTITION BY month ORDER BY x DESC) AS k FROM cal WHERE isodow(x) < 6) WHERE k <= 3),
    fomc AS (SELECT unnest([{listed(EVENT_DATES["FOMC"])}]) AS x), cpi AS (SELECT unnest([{listed(EVENT_DATES["CPI"])}]) AS x)
    SELECT day, CASE WHEN EXISTS (SELECT 1 FROM fomc WHERE abs(day - x) <= 1) THEN 'FOMC_WINDOW'
      WHEN EXISTS (SELECT 1 FROM cpi WHERE day - x IN (0, -1)) THEN 'CPI_WINDOW'
      WHEN EXISTS (SELECT 1 FROM opex WHERE day BETWEEN friday - 4 AND friday) THEN 'OPEX_WEEK'
      WHEN day IN (SELECT x FROM ends) THEN 'MONTH_END'
      WHEN day IN ({listed(near)}) THEN 'HOLIDAY_LIQUIDITY' ELSE 'NONE' END AS calendar_state FROM days"""


@register("calendar_states", _calendar_sql())
def _(spark, sf):
    return regimes.with_calendar_state(all_days(spark, sf), "day")


def risk_inputs(spark, sf):
    df = add_indicators(bars(spark, sf))
    return df.withColumn("gap", F.col("open") / F.lag("close", 2).over(by_symbol()) - 1)


RISK = """
risk AS (SELECT *, open / lag(close, 2) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS gap FROM ind),
liq AS (
  SELECT *, CASE WHEN coalesce(volume_zscore_20 > 4, false) OR coalesce(realized_vol_20 > 0.06, false) OR coalesce(abs(gap) > 0.05, false) THEN 'PANIC_LIQUIDITY'
    WHEN coalesce(volume_zscore_20 > 2.5, false) OR coalesce(realized_vol_20 > 0.04, false) OR coalesce(abs(gap) > 0.03, false) THEN 'STRESSED_LIQUIDITY'
    WHEN coalesce(volume_zscore_20 < -1, false) OR coalesce(realized_vol_20 > 0.025, false) THEN 'THIN_LIQUIDITY' ELSE 'NORMAL_LIQUIDITY' END AS liquidity_state
  FROM risk
)"""


@register(
    "liquidity_and_costs",
    o.query(
        """SELECT symbol, pos, liquidity_state, CASE liquidity_state WHEN 'NORMAL_LIQUIDITY' THEN 5.0 WHEN 'THIN_LIQUIDITY' THEN 12.0 WHEN 'STRESSED_LIQUIDITY' THEN 30.0 ELSE 80.0 END AS round_trip_bps,
        CASE liquidity_state WHEN 'NORMAL_LIQUIDITY' THEN 2.5 WHEN 'THIN_LIQUIDITY' THEN 6.0 WHEN 'STRESSED_LIQUIDITY' THEN 15.0 ELSE 40.0 END AS entry_bps,
        liquidity_state = 'PANIC_LIQUIDITY' AS blocked,
        round(return_1d - CASE liquidity_state WHEN 'NORMAL_LIQUIDITY' THEN 5.0 WHEN 'THIN_LIQUIDITY' THEN 12.0 WHEN 'STRESSED_LIQUIDITY' THEN 30.0 ELSE 80.0 END / 1e4, 6) AS net_return FROM liq""",
        o.BARS, o.INDICATORS, RISK,
    ),
)
def _(spark, sf):
    df = risk_inputs(spark, sf)
    df = df.withColumn("liquidity_state", regimes.liquidity_state(F.col("volume_zscore_20"), F.col("realized_vol_20"), F.col("gap")))
    s = F.col("liquidity_state")
    return df.select(
        "symbol", "pos", "liquidity_state",
        regimes.cost_bps(s).alias("round_trip_bps"),
        regimes.cost_bps(s, F.lit("entry")).alias("entry_bps"),
        regimes.entry_blocked(s).alias("blocked"),
        F.round(F.col("return_1d") - regimes.cost_bps(s) / 1e4, 6).alias("net_return"),
    )


@register(
    "stress_and_tail_risk",
    o.query(
        """SELECT symbol, pos, CASE WHEN coalesce(realized_vol_20 * 60 > 40, false) OR coalesce(bb_width_20 * 40 > 8, false) OR coalesce(abs(volume_zscore_20) > 3, false) THEN 'PANIC'
          WHEN coalesce(realized_vol_20 * 60 > 28, false) OR coalesce(bb_width_20 * 40 > 5.5, false) OR coalesce(abs(volume_zscore_20) > 2, false) THEN 'STRESS'
          WHEN coalesce(realized_vol_20 * 60 > 20, false) OR coalesce(bb_width_20 * 40 > 4, false) OR coalesce(abs(volume_zscore_20) > 1.5, false) THEN 'ELEVATED' ELSE 'CALM' END AS stress,
        round(0.35 * least(greatest(coalesce(realized_vol_20, 0) / 0.6, 0), 1) + 0.30 * least(abs(coalesce(volume_zscore_20, 0)) / 4, 1)
          + 0.20 * least(abs(coalesce(gap, 0)) / 0.05, 1) + 0.15 * least(abs(coalesce(return_10d, 0)) / 0.3, 1), 6) AS tail_risk,
        round(0.25 * least(abs(coalesce(return_1d, 0)) / 0.05, 1) + 0.35 * least(abs(coalesce(volume_zscore_20, 0)) / 4, 1)
          + 0.20 * least(abs(coalesce(return_5d, 0)), 1) + 0.20 * least(greatest((coalesce(rsi_14, 0) / 10 - 3) / 10, 0), 1), 6) AS reflexivity FROM risk""",
        o.BARS, o.INDICATORS, RISK,
    ),
)
def _(spark, sf):
    c = F.col
    return risk_inputs(spark, sf).select(
        "symbol", "pos",
        regimes.cross_asset_stress(c("realized_vol_20") * 60, c("bb_width_20") * 40, c("volume_zscore_20")).alias("stress"),
        regimes.tail_risk(c("realized_vol_20"), c("volume_zscore_20"), c("gap"), c("return_10d")).alias("tail_risk"),
        regimes.reflexivity(c("return_1d"), c("volume_zscore_20"), c("return_5d"), c("rsi_14") / 10).alias("reflexivity"),
    )


@register(
    "position_size",
    o.query("SELECT symbol, pos, round(100000 * 0.01 / (atr_14 * 2), 6) AS units FROM ind WHERE atr_14 > 0", o.BARS, o.INDICATORS),
)
def _(spark, sf):
    df = add_indicators(bars(spark, sf)).where("atr_14 > 0")
    units = regimes.position_size(F.lit(100000.0), F.lit(0.01), F.col("atr_14"), F.lit(2.0))
    return df.select("symbol", "pos", F.round(units, 6).alias("units"))


# Paths


@register(
    "path_features",
    o.query(
        """SELECT symbol, pos, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY pos) AS INTEGER) AS state_age, prior_state,
        CASE WHEN pos >= 3 THEN prior_path END AS prior_path,
        CAST(coalesce(sum(CASE WHEN state = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS failed_breakouts,
        round(last_value(moved IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos), 6) AS entry_velocity FROM runs""",
        *LAB,
        """begun AS (
          SELECT symbol, pos, state, close, lag(state) OVER w AS prior_state, lag(close, 5) OVER w AS past, lag(state) OVER w IS DISTINCT FROM state AS b,
                 concat_ws('>', lag(state, 3) OVER w, lag(state, 2) OVER w, lag(state, 1) OVER w) AS prior_path
          FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY pos)
        ), runs AS (
          SELECT *, sum(b::INT) OVER (PARTITION BY symbol ORDER BY pos) AS run, CASE WHEN b THEN abs(close - past) / nullif(past, 0) END AS moved FROM begun
        )""",
    ),
)
def _(spark, sf):
    df = paths.path_features(labelled(spark, sf))
    cols = ["symbol", "pos", "state_age", "prior_state", "prior_path", "failed_breakouts", "entry_velocity"]
    return rounded(df.select(*cols), "entry_velocity").withColumn("failed_breakouts", F.col("failed_breakouts").cast("long"))


ANALOGUE_SQL = """
idx AS (
  SELECT * FROM (SELECT symbol, pos AS start, list(CAST(state AS VARCHAR)) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS path FROM lab)
  WHERE len(path) = 5
), asked AS (SELECT symbol, path FROM idx QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start DESC) = 1),
hit AS (SELECT i.symbol, i.path, i.start, row_number() OVER (PARTITION BY i.symbol, i.path ORDER BY i.start) AS rank FROM idx i JOIN asked a ON i.symbol = a.symbol AND i.path = a.path)"""


@register(
    "analogues",
    o.query(
        """SELECT h.symbol, array_to_string(h.path, '>') AS path, h.start, CAST(h.rank AS INTEGER) AS rank, round(r.r, 6) AS outcome FROM hit h
        LEFT JOIN (SELECT symbol, pos, lead(close) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS r FROM lab) r ON r.symbol = h.symbol AND r.pos = h.start + 5
        WHERE h.rank <= 5""",
        *LAB, ANALOGUE_SQL,
    ),
)
def _(spark, sf):
    from pyspark.sql import Window

    df = labelled(spark, sf)
    index = paths.path_index(df, "state")
    last = Window.partitionBy("symbol").orderBy(F.col("start").desc())
    asked = index.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("symbol", "path")
    returns = df.select("symbol", "pos", expectancy.forward_return(1).alias("value"))
    out = paths.analogue_outcomes(paths.analogues(asked, index), returns)
    return out.select("symbol", F.array_join("path", ">").alias("path"), "start", "rank", F.round("outcome", 6).alias("outcome"))


# Markov


@register("transition_matrix", o.query("SELECT symbol, src, dst, CAST(n AS BIGINT) AS n, round(p, 6) AS p FROM mat", *LAB, o.PAIRS, o.MATRIX))
def _(spark, sf):
    return rounded(markov.matrix(markov.transitions(labelled(spark, sf))), "p")


@register(
    "transition_matrix_smoothed",
    o.query("SELECT symbol, src, dst, CAST(n AS BIGINT) AS n, round((n + 0.5) / sum(n + 0.5) OVER (PARTITION BY symbol, src), 6) AS p FROM mat", *LAB, o.PAIRS, o.MATRIX),
)
def _(spark, sf):
    return rounded(markov.matrix(markov.transitions(labelled(spark, sf)), alpha=0.5), "p")


@register(
    "markov_forecast",
    o.query(
        """SELECT a.symbol, a.src, c.dst, round(sum(a.p * b.p * c.p), 6) AS p FROM mat a JOIN mat b ON a.symbol = b.symbol AND a.dst = b.src
        JOIN mat c ON b.symbol = c.symbol AND b.dst = c.src GROUP BY ALL""",
        *LAB, o.PAIRS, o.MATRIX,
    ),
)
def _(spark, sf):
    return rounded(markov.forecast(markov.matrix(markov.transitions(labelled(spark, sf))), 3), "p")


@register(
    "forecast_expected_value",
    o.query(
        """SELECT m.symbol, src, round(sum(p * ev), 6) AS expected_value, round(coalesce(sum(p) FILTER (ev IS NOT NULL), 0), 6) AS coverage
        FROM mat m LEFT JOIN (SELECT symbol, state, avg(r) - 0.0005 AS ev FROM fwd WHERE horizon = 5 GROUP BY ALL) e ON m.symbol = e.symbol AND m.dst = e.state GROUP BY ALL""",
        *LAB, o.PAIRS, o.MATRIX, o.FORWARD,
    ),
)
def _(spark, sf):
    df = labelled(spark, sf)
    probs = markov.matrix(markov.transitions(df)).select("symbol", "src", F.col("dst").alias("state"), "p")
    table = expectancy.expectancy(df, ["symbol", "state"], (5,)).select("symbol", "state", "ev_after_cost")
    each = probs.select("symbol", "src").distinct().join(table, "symbol")
    return rounded(expectancy.expected_value(probs, each, ["symbol", "src"]), "expected_value", "coverage")


@register(
    "conditional_transitions",
    o.query(
        """SELECT c.symbol, c.vol_state, round(sum(d), 6) AS total_l1, round(max(d), 6) AS max_row_l1 FROM (
          SELECT c.symbol, c.vol_state, c.src, sum(abs(c.p - m.p)) AS d FROM cmat c JOIN mat m ON c.symbol = m.symbol AND c.src = m.src AND c.dst = m.dst GROUP BY ALL) c GROUP BY ALL""",
        *LAB, o.VOL, o.PAIRS, o.MATRIX,
        """cpairs AS (SELECT * FROM (SELECT symbol, vol_state, state AS src, lead(state) OVER (PARTITION BY symbol, vol_state ORDER BY pos) AS dst FROM vol) WHERE dst IS NOT NULL),
        ccells AS (SELECT symbol, vol_state, src, dst, count(*) AS n FROM cpairs GROUP BY ALL),
        cmat AS (
          SELECT k.symbol, k.vol_state, g.src, g.dst, (coalesce(n, 0) + 1e-6) / sum(coalesce(n, 0) + 1e-6) OVER (PARTITION BY k.symbol, k.vol_state, g.src) AS p
          FROM (SELECT DISTINCT symbol, vol_state FROM cpairs) k JOIN grid g ON g.symbol = k.symbol
          LEFT JOIN ccells c ON c.symbol = k.symbol AND c.vol_state = k.vol_state AND c.src = g.src AND c.dst = g.dst
        )""",
    ),
)
def _(spark, sf):
    df = regimes.volatility_state(labelled(spark, sf))
    keys = ("symbol", "vol_state")
    conditional = markov.matrix(markov.transitions(df, keys), keys, alpha=1e-6)
    plain = markov.matrix(markov.transitions(df))
    return rounded(markov.compare_conditional(conditional, plain, "vol_state"), "total_l1", "max_row_l1")


def rolling_sql(step: int) -> str:
    return ROLLING.replace("% 40", f"% {step}")


ROLLING = """
anch AS (SELECT symbol, k AS anchor FROM known WHERE k + 1 >= 120 AND (k + 1 - 120) % 40 = 0),
roll AS (
  SELECT a.symbol, a.anchor, p.src, p.dst, count(*) AS n FROM anch a JOIN pairs p ON p.symbol = a.symbol AND p.k + 1 <= a.anchor AND p.k + 1 > a.anchor - 119 GROUP BY ALL
), rollp AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol, anchor, src) AS p FROM roll)"""


@register("rolling_transitions", o.query("SELECT symbol, anchor, src, dst, n, round(p, 6) AS p FROM rollp", *LAB, o.PAIRS, ROLLING))
def _(spark, sf):
    df = rounded(markov.rolling_matrices(labelled(spark, sf), 120, 40), "p")
    return df.withColumn("anchor", F.col("anchor").cast("long"))


@register("rolling_transitions_daily", o.query("SELECT symbol, anchor, src, dst, n, round(p, 6) AS p FROM rollp", *LAB, o.PAIRS, rolling_sql(1)))
def _(spark, sf):
    df = rounded(markov.rolling_matrices(labelled(spark, sf), 120), "p")
    return df.withColumn("anchor", F.col("anchor").cast("long"))


STABILITY = """
mv AS (
  SELECT a.symbol, a.anchor, CAST(s.s AS INTEGER) AS src FROM anch a, range(12) s(s) WHERE a.anchor > (SELECT min(anchor) FROM anch b WHERE b.symbol = a.symbol)
), diff AS (
  SELECT coalesce(x.symbol, y.symbol) AS symbol, coalesce(x.anchor, y.anchor + 40) AS anchor, coalesce(x.src, y.src) AS src,
         sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))) AS l1
  FROM rollp x FULL OUTER JOIN rollp y ON x.symbol = y.symbol AND x.anchor = y.anchor + 40 AND x.src = y.src AND x.dst = y.dst GROUP BY ALL
), stab AS (
  SELECT m.symbol, m.anchor, m.src, 1 - 0.5 * coalesce(l1, 0) AS stability FROM mv m LEFT JOIN diff d ON m.symbol = d.symbol AND m.anchor = d.anchor AND m.src = d.src
)"""


@register("transition_stability", o.query("SELECT symbol, anchor, round(avg(stability), 6) AS stability FROM stab GROUP BY ALL", *LAB, o.PAIRS, ROLLING, STABILITY))
def _(spark, sf):
    per = markov.stability(markov.rolling_matrices(labelled(spark, sf), 120, 40), 40)
    return rounded(markov.stability_score(per), "stability").withColumn("anchor", F.col("anchor").cast("long"))


@register(
    "unstable_states",
    o.query("SELECT symbol, src, round(avg(stability), 6) AS mean_stability FROM stab GROUP BY ALL HAVING avg(stability) < 0.97", *LAB, o.PAIRS, ROLLING, STABILITY),
)
def _(spark, sf):
    per = markov.stability(markov.rolling_matrices(labelled(spark, sf), 120, 40), 40)
    return rounded(markov.unstable_states(per, 0.97), "mean_stability")


@register(
    "walkforward_forecasts",
    o.query(
        """SELECT symbol, pos, CAST(1 AS INTEGER) AS horizon, dst, round(p, 6) AS p FROM (
          SELECT q.symbol, q.pos, x.dst, x.n / sum(x.n) OVER (PARTITION BY q.symbol, q.pos) AS p FROM known q JOIN cnt x ON x.symbol = q.symbol AND x.k = q.k
          UNION ALL SELECT q.symbol, q.pos, q.state, 1.0 FROM known q WHERE k >= 252 AND NOT EXISTS (SELECT 1 FROM cnt x WHERE x.symbol = q.symbol AND x.k = q.k))""",
        *LAB, o.PAIRS,
        """cnt AS (
          SELECT q.symbol, q.k, p.dst, count(*) AS n FROM known q JOIN pairs p ON p.symbol = q.symbol AND p.src = q.state AND p.k BETWEEN q.k - 252 AND q.k - 2
          WHERE q.k >= 252 GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    return rounded(markov.walkforward_forecasts(labelled(spark, sf), 252, (1,)), "p")


@register(
    "walkforward_forecasts_steps",
    o.query(
        "SELECT s.symbol, q.pos, CAST(step AS INTEGER) AS horizon, dst, round(p + 1e-10, 6) AS p FROM steps s JOIN asked q ON q.symbol = s.symbol AND q.k = s.k WHERE step IN (1, 5, 10, 20) AND p > 0",
        *LAB, o.PAIRS, "asked AS (SELECT symbol, pos, k, state, k - 252 AS a, k AS b FROM known WHERE k >= 252)", o.STEPS.replace("{steps}", "20"), recursive=True,
    ),
)
def _(spark, sf):
    # Products of small fractions lie on ties of the sixth digit; the nudge, far below it, rounds them alike everywhere.
    return rounded(markov.walkforward_forecasts(labelled(spark, sf), 252).withColumn("p", F.col("p") + 1e-10), "p")


def _markov_value_sql(body: str, horizon: int) -> str:
    return o.query(
        body,
        *LAB, o.PAIRS,
        f"asked AS (SELECT symbol, pos, k, state, greatest(0, k - {horizon} - 252) AS a, k - {horizon} AS b FROM known WHERE k >= {horizon} + 5)",
        o.STEPS.replace("{steps}", str(horizon)),
        f"""payoff AS (
          SELECT q.symbol, q.k, l.state AS dst, count(r) AS n, avg(r) - 0.0005 AS ev FROM asked q
          JOIN (SELECT symbol, pos, state, lead(close, {horizon}) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS r FROM lab) l
          ON l.symbol = q.symbol AND l.pos >= q.a AND l.pos < q.b GROUP BY ALL HAVING count(r) >= 5
        ), valued AS (
          SELECT s.symbol, s.k, sum(s.p * f.ev) AS markov_ev, sum(s.p) AS coverage, sum(s.p * f.n) AS weighted_samples FROM steps s
          JOIN payoff f ON f.symbol = s.symbol AND f.k = s.k AND f.dst = s.dst WHERE step = {horizon} GROUP BY ALL
        ), markov_values AS (
          SELECT q.symbol, q.pos, q.state, CASE WHEN any_f THEN coalesce(markov_ev, 0) END AS markov_ev, coalesce(coverage, 0) AS coverage, coalesce(weighted_samples, 0) AS weighted_samples
          FROM asked q LEFT JOIN valued v ON v.symbol = q.symbol AND v.k = q.k LEFT JOIN (SELECT DISTINCT symbol, k, true AS any_f FROM payoff) f ON f.symbol = q.symbol AND f.k = q.k
        )""",
        recursive=True,
    )


@register("walkforward_markov_value", _markov_value_sql("SELECT symbol, pos, state, round(markov_ev, 9) AS markov_ev, round(coverage, 9) AS coverage, round(weighted_samples, 9) AS weighted_samples FROM markov_values", 5))
def _(spark, sf):
    return rounded(markov.walkforward_markov_value(labelled(spark, sf)), "markov_ev", "coverage", "weighted_samples", places=9)


@register("stationary_distribution")
def _(spark, sf):
    return rounded(markov.stationary(markov.matrix(markov.transitions(labelled(spark, sf)), alpha=1e-6)), "p")


# Walk-forward and backtests


@register("walkforward_expectancy", o.query("SELECT symbol, date, pos, state, train_count, round(ev_after_cost, 6) AS ev_after_cost FROM wf", *LAB, o.WALKFORWARD))
def _(spark, sf):
    df = expectancy.walkforward(labelled(spark, sf).select("symbol", "date", "pos", "close", "state"))
    return rounded(df.drop("close"), "ev_after_cost")


WF = (*LAB, o.WALKFORWARD, o.WF_ALL)


@register(
    "walkforward_trades",
    o.query(
        f"SELECT symbol, CAST(pos AS INTEGER) AS signal_pos, date AS signal_date, entry_date, exit_date, CAST(pos + 6 AS INTEGER) AS exit_pos, entry_price, exit_price, round(gross, 6) AS gross_return, round(net, 6) AS net_return, 5 AS holding FROM trd",
        *WF, o.TRADED, recursive=True,
    ),
)
def _(spark, sf):
    return rounded(backtest.walkforward_backtest(labelled(spark, sf))[0], "gross_return", "net_return")


PERF = o.performance("bt", "lab", "trd")


@register("walkforward_equity", o.query("SELECT symbol, date, pos, round(equity, 6) AS equity FROM bt_eq", *WF, o.TRADED, PERF, recursive=True))
def _(spark, sf):
    return rounded(backtest.walkforward_backtest(labelled(spark, sf))[1], "equity")


PERF_COLUMNS = ("total_return", "max_drawdown", "sharpe", "win_rate", "avg_win", "avg_loss", "exposure_time")


@register("walkforward_stats", o.query("SELECT * FROM bt_stats", *WF, o.TRADED, PERF, recursive=True))
def _(spark, sf):
    return rounded(backtest.walkforward_backtest(labelled(spark, sf))[2], *PERF_COLUMNS)


TABLE_ALL = """
wf_all AS (
  SELECT l.symbol, l.date, l.pos, l.close, e.ev AS ev_after_cost FROM lab l
  LEFT JOIN (SELECT symbol, state, avg(r) - 0.0005 AS ev FROM fwd WHERE horizon = 5 GROUP BY ALL) e ON l.symbol = e.symbol AND l.state = e.state
)"""


@register("table_backtest", o.query("SELECT * FROM bt_stats", *LAB, o.FORWARD, TABLE_ALL, o.TRADED, PERF, recursive=True))
def _(spark, sf):
    df = labelled(spark, sf)
    table = expectancy.expectancy(df, ["symbol", "state"], (5,))
    return rounded(backtest.table_backtest(df, table)[2], *PERF_COLUMNS)


HOLD = "hold AS (SELECT symbol, max_by(close, pos) / min_by(close, pos) - 1 AS total_return, count(*) AS n_bars FROM bars GROUP BY symbol)"


@register("buy_and_hold", o.query("SELECT symbol, round(total_return, 6) AS total_return, n_bars FROM hold", o.BARS, HOLD))
def _(spark, sf):
    return rounded(backtest.buy_and_hold(bars(spark, sf)), "total_return")


CROSS = """
up AS (
  SELECT symbol, pos, close, coalesce(CASE WHEN count(*) OVER a = 50 THEN avg(close) OVER a END > CASE WHEN count(*) OVER b = 200 THEN avg(close) OVER b END, false) AS u,
         coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 0) AS r
  FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING), b AS (PARTITION BY symbol ORDER BY pos ROWS 199 PRECEDING)
), crossed AS (
  SELECT symbol, product(1 + l * r) - 1 AS total_return, avg(l) AS exposure_time FROM (
    SELECT *, coalesce(lag(u::INT) OVER (PARTITION BY symbol ORDER BY pos), 0) AS l FROM up) GROUP BY symbol
)"""


@register("ma_crossover", o.query(f"SELECT symbol, {_r('total_return', 'exposure_time')} FROM crossed", o.BARS, CROSS))
def _(spark, sf):
    return rounded(backtest.ma_crossover(bars(spark, sf)), "total_return", "exposure_time")


BREAKOUT = (
    """
topped AS (
  SELECT symbol, pos, close, lead(close, 1) OVER w AS a, lead(close, 6) OVER w AS b,
         CASE WHEN count(close) OVER p = 126 THEN max(close) OVER p END AS top
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos), p AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)
), """
    + o.selected("bsel", "(SELECT symbol, pos FROM topped WHERE close > top AND b IS NOT NULL)").strip()
    + """, broke AS (
  SELECT n.symbol, coalesce(product(1 + net) - 1, 0) AS total_return, count(net) AS trade_count,
         avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (net IS NOT NULL) AS win_rate, 5 * count(net) / any_value(n.bars) AS exposure_time
  FROM (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) n
  LEFT JOIN (SELECT t.symbol, t.b / t.a - 1 - 0.0005 AS net FROM bsel s JOIN topped t ON s.symbol = t.symbol AND s.pos = t.pos) x ON x.symbol = n.symbol GROUP BY n.symbol
)"""
)


@register("breakout", o.query(f"SELECT symbol, {_r('total_return', 'win_rate', 'exposure_time')}, trade_count FROM broke", o.BARS, BREAKOUT, recursive=True))
def _(spark, sf):
    return rounded(backtest.breakout(bars(spark, sf)), "total_return", "win_rate", "exposure_time")


@register(
    "model_comparison",
    o.query(
        """SELECT m.symbol, model, round(m.total_return, 6) AS total_return, round(m.total_return - h.total_return, 6) AS excess_vs_buy_hold FROM (
          SELECT symbol, 'state_ev_strategy' AS model, total_return FROM bt_b UNION ALL SELECT symbol, 'buy_and_hold', total_return FROM hold
          UNION ALL SELECT symbol, 'ma_crossover', total_return FROM crossed UNION ALL SELECT symbol, 'breakout', total_return FROM broke) m JOIN hold h ON m.symbol = h.symbol""",
        *WF, o.TRADED, PERF, HOLD, CROSS, BREAKOUT, recursive=True,
    ),
)
def _(spark, sf):
    return rounded(backtest.compare_models(labelled(spark, sf)), "total_return", "excess_vs_buy_hold")


SHUFFLED = """
lab0 AS (SELECT * FROM lab),
dealt AS (
  SELECT a.symbol, a.pos, b.state FROM (SELECT symbol, pos, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS k FROM lab0) a
  JOIN (SELECT symbol, state, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', 7, symbol, pos)), pos) AS k FROM lab0) b ON a.symbol = b.symbol AND a.k = b.k
), shuf AS (SELECT l.symbol, l.date, l.pos, l.close, d.state FROM lab0 l JOIN dealt d ON l.symbol = d.symbol AND l.pos = d.pos)"""


@register(
    "random_label_backtest",
    o.query("SELECT * FROM bt_stats", *LAB, SHUFFLED, o.WALKFORWARD.replace("FROM lab", "FROM shuf"), o.WF_ALL, o.TRADED, PERF, recursive=True),
)
def _(spark, sf):
    return rounded(backtest.random_label_backtest(labelled(spark, sf)), *PERF_COLUMNS)


GRID = o.grid_stats()


@register("sensitivity_grid", o.query("SELECT * FROM grid_stats", *LAB, GRID, recursive=True))
def _(spark, sf):
    return rounded(backtest.sensitivity_grid(labelled(spark, sf)), *PERF_COLUMNS)


SPREAD_SQL = """SELECT symbol, count(sharpe) AS n, round(median(sharpe), 5) AS median, round(stddev_samp(sharpe), 5) AS spread,
  round(quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25), 5) AS iqr, round(min(sharpe), 5) AS lowest, round(max(sharpe), 5) AS highest,
  round(avg(CASE WHEN sharpe < 0 THEN 1.0 ELSE 0.0 END) FILTER (sharpe IS NOT NULL), 5) AS share_negative FROM grid_stats GROUP BY symbol"""
SPREAD_COLUMNS = ("median", "spread", "iqr", "lowest", "highest", "share_negative")


def sensitivity_spread(spark, sf):
    grid = rounded(backtest.sensitivity_grid(labelled(spark, sf)), "sharpe")
    return rounded(expectancy.sensitivity_summary(grid), *SPREAD_COLUMNS, places=5)


@register("sensitivity_summary", o.query(SPREAD_SQL, *LAB, GRID, recursive=True))
def _(spark, sf):
    return sensitivity_spread(spark, sf)


def ranked(df: DataFrame, *order) -> DataFrame:
    """Report rows with their place; a report has few rows, so one task numbers them."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@register("stability_ranked", o.query(f"SELECT *, CAST(row_number() OVER (ORDER BY median DESC NULLS LAST, symbol) AS INTEGER) AS place FROM ({SPREAD_SQL})", *LAB, GRID, recursive=True))
def _(spark, sf):
    return ranked(sensitivity_spread(spark, sf), F.col("median").desc_nulls_last(), "symbol")


@register(
    "sensitivity_top",
    o.query(
        """SELECT symbol, horizon, lookback, cost_bps, min_samples, total_return, sharpe, trade_count,
        CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST, symbol, horizon, lookback, cost_bps, min_samples) AS INTEGER) AS place FROM grid_stats QUALIFY place <= 24""",
        *LAB, GRID, recursive=True,
    ),
)
def _(spark, sf):
    keys = ("symbol", "horizon", "lookback", "cost_bps", "min_samples")
    grid = rounded(backtest.sensitivity_grid(labelled(spark, sf)), "total_return", "sharpe").select(*keys, "total_return", "sharpe", "trade_count")
    return ranked(grid.orderBy(F.col("sharpe").desc_nulls_last(), *keys).limit(24), F.col("sharpe").desc_nulls_last(), *keys)


def _lift_sql() -> str:
    plain = o.performance("bt", "lab", "trd")
    gated = o.TRADED.replace("sel_s", "gsel_s").replace("sel AS", "gsel AS").replace("FROM sel ", "FROM gsel ").replace("trd AS", "gtrd AS")
    gated = gated.replace("AND x IS NOT NULL", "AND x IS NOT NULL AND date IN (SELECT date FROM macro WHERE macro_regime IN (0, 2))")
    return o.query(
        """SELECT a.symbol, round(a.s, 6) AS sharpe_all, round(b.s, 6) AS sharpe_filtered, round(b.s - a.s, 6) AS lift, coalesce(b.s - a.s >= 0.2, false) AS passes
        FROM (SELECT symbol, sharpe AS s FROM bt_b) a JOIN (SELECT symbol, sharpe AS s FROM gt_b) b ON a.symbol = b.symbol""",
        *LAB, MACRO, o.WALKFORWARD, o.WF_ALL, o.TRADED, plain, gated, o.performance("gt", "lab", "gtrd"), recursive=True,
    )


@register("sharpe_lift", _lift_sql())
def _(spark, sf):
    df = labelled(spark, sf)
    regime = macro(spark, sf).select("date", regimes.regime_allowed(F.col("macro_regime"), [0, 2]).alias("allowed"))
    return rounded(backtest.sharpe_lift(df.join(regime, "date", "left"), "allowed"), "sharpe_all", "sharpe_filtered", "lift")


# Drift and conditional forecasts


def drift_sql(recent: int = 60, threshold: float = 0.1) -> str:
    return f"""part AS (SELECT symbol, state, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) <= {recent} AS recent FROM lab),
    drifted AS (
      SELECT t.symbol, t.n AS n_states_seen, CASE WHEN t.n > {recent} THEN kl END AS kl, t.n > {recent} AND kl >= {threshold} AS alert,
        CASE WHEN t.n > {recent} THEN 'ok' ELSE 'insufficient_history' END AS status
        FROM (SELECT symbol, count(*) AS n FROM lab GROUP BY symbol) t
        JOIN (SELECT symbol, sum(greatest(p, 1e-12) * (ln(greatest(p, 1e-12)) - ln(greatest(q, 1e-12)))) AS kl FROM (
          SELECT symbol, state, max(s) FILTER (recent) AS p, max(s) FILTER (NOT recent) AS q FROM (
            SELECT g.symbol, g.recent, g.state, (coalesce(n, 0) + 1e-6) / sum(coalesce(n, 0) + 1e-6) OVER (PARTITION BY g.symbol, g.recent) AS s
            FROM (SELECT DISTINCT symbol, recent, CAST(a.a AS INTEGER) AS state FROM part, range(12) a(a)) g
            LEFT JOIN (SELECT symbol, recent, state, count(*) AS n FROM part GROUP BY ALL) c ON c.symbol = g.symbol AND c.recent = g.recent AND c.state = g.state)
          GROUP BY ALL) GROUP BY symbol) k ON t.symbol = k.symbol)"""


@register(
    "state_distribution",
    o.query(
        """SELECT s.symbol, CAST(a.a AS INTEGER) AS state, round((coalesce(n, 0) + 1e-6) / sum(coalesce(n, 0) + 1e-6) OVER (PARTITION BY s.symbol), 6) AS p
        FROM (SELECT DISTINCT symbol FROM lab) s CROSS JOIN range(12) a(a)
        LEFT JOIN (SELECT symbol, state, count(*) AS n FROM lab GROUP BY ALL) c ON c.symbol = s.symbol AND c.state = a.a""",
        *LAB,
    ),
)
def _(spark, sf):
    return rounded(monitoring.state_distribution(labelled(spark, sf), ["symbol"]), "p")


@register("drift_monitor", o.query("SELECT symbol, n_states_seen, round(kl, 6) AS kl, alert, status FROM drifted", *LAB, drift_sql()))
def _(spark, sf):
    return rounded(monitoring.drift_monitor(labelled(spark, sf)), "kl")


# Counts up to each bar less those up to 60 bars before it.
ROLLING_DRIFT = """
tallies AS MATERIALIZED (
  SELECT symbol, pos, row_number() OVER w AS n_seen, list(state) OVER (PARTITION BY symbol ORDER BY pos ROWS 59 PRECEDING) AS lately,
         list(state) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 60 PRECEDING) AS earlier
  FROM lab WHERE state IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY pos)
), drifting AS (
  SELECT symbol, pos, n_seen, CASE WHEN n_seen > 60 THEN list_sum(list_transform(range(12), lambda s:
      greatest((len(list_filter(lately, lambda x: x = s)) + 1e-6) / (len(lately) + 12e-6), 1e-12)
      * (ln(greatest((len(list_filter(lately, lambda x: x = s)) + 1e-6) / (len(lately) + 12e-6), 1e-12))
         - ln(greatest((len(list_filter(earlier, lambda x: x = s)) + 1e-6) / (len(earlier) + 12e-6), 1e-12))))) END AS kl FROM tallies
)"""
#: The reference's alert is at 0.10; on these bars most days diverge by more, since 60 of a random walk's bars see few of its states.
DRIFT_ALERT = 0.10


@register("rolling_drift", o.query(f"SELECT symbol, pos, CAST(n_seen AS INTEGER) AS n_seen, round(kl, 6) AS kl, coalesce(kl >= {DRIFT_ALERT}, false) AS alert FROM drifting", *LAB, ROLLING_DRIFT))
def _(spark, sf):
    return rounded(monitoring.rolling_drift(labelled(spark, sf), threshold=DRIFT_ALERT), "kl").withColumn("n_seen", F.col("n_seen").cast("int"))


def records(spark, sf):
    """Labelled bars as composite records; some modifiers are unknown."""
    df = regimes.volatility_state(labelled(spark, sf))
    label = states.state_names(df, out="base_state")
    vol = F.when(F.col("vol_rank").isNotNull(), F.get(F.array(*[F.lit(x) for x in VOL_LABELS.values()]), F.col("vol_state")))
    mean = compensated_sma("close", 50)
    trend = F.when(F.col("close") > mean, "UP").when(F.col("close") <= mean, "DOWN")
    return label.select(
        "symbol", "pos", "base_state", vol.alias("volatility_state"), trend.alias("macro_state"),
        F.when(F.weekday("date") == 4, "FRIDAY").alias("calendar_state"), F.lit(None).cast("string").alias("liquidity_state"),
    )


RECORDS = f"""
rec AS (
  SELECT symbol, pos, {LABEL_CASE} AS b, coalesce(CASE WHEN vol_rank IS NOT NULL THEN (['LOW_VOL', 'NORMAL_VOL', 'HIGH_VOL', 'VOL_COMPRESSION', 'VOL_EXPANSION'])[vol_state + 1] END, '*') AS v,
         coalesce(CASE WHEN close > sma_50 THEN 'UP' WHEN close <= sma_50 THEN 'DOWN' END, '*') AS m,
         CASE WHEN isodow(date) = 5 THEN 'FRIDAY' ELSE '*' END AS c
  FROM vol
), keyed AS (
  SELECT symbol, pos, b, CAST(l.l AS INTEGER) AS level, concat_ws('|', b, CASE WHEN l.l > 0 THEN v ELSE '*' END, CASE WHEN l.l > 1 THEN m ELSE '*' END, CASE WHEN l.l > 2 THEN c ELSE '*' END, '*') AS key
  FROM rec, range(5) l(l)
), seq AS (SELECT *, lead(key) OVER (PARTITION BY symbol, level ORDER BY pos) AS next_key FROM keyed)"""
REC = (*LAB, o.VOL, RECORDS)


@register("coverage", o.query("SELECT symbol, level, key, n, round(n / sum(n) OVER (PARTITION BY symbol, level), 6) AS share FROM (SELECT symbol, level, key, count(*) AS n FROM seq GROUP BY ALL)", *REC))
def _(spark, sf):
    return rounded(fc.coverage(fc.state_counts(fc.leveled(records(spark, sf)))), "share")


@register(
    "transition_coverage",
    o.query(
        "SELECT symbol, level, key, next_key, n, round(n / sum(n) OVER (PARTITION BY symbol, level, key), 6) AS row_share FROM (SELECT symbol, level, key, next_key, count(*) AS n FROM seq WHERE next_key IS NOT NULL GROUP BY ALL)",
        *REC,
    ),
)
def _(spark, sf):
    return rounded(fc.transition_coverage(fc.transition_counts(fc.leveled(records(spark, sf)))), "row_share")


@register("rare_keys", o.query("SELECT symbol, level, key, count(*) AS n FROM seq GROUP BY ALL HAVING count(*) < 30", *REC))
def _(spark, sf):
    return fc.rare_keys(fc.state_counts(fc.leveled(records(spark, sf))))


def forecasts(spark, sf):
    from pyspark.sql import Window

    rec = records(spark, sf)
    recent = Window.partitionBy("symbol").orderBy(F.col("pos").desc())
    asked = rec.withColumn("_n", F.row_number().over(recent)).where("_n <= 60").drop("_n")
    return fc.conditional_forecast(rec, asked)


FORECAST = """
cnt AS (SELECT symbol, level, key, count(*) AS n, count(next_key) AS moves FROM seq GROUP BY ALL),
ask AS (SELECT k.symbol, k.pos, k.level, k.key, n, moves FROM keyed k JOIN (SELECT symbol, pos FROM rec QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) <= 60) r
        ON k.symbol = r.symbol AND k.pos = r.pos JOIN cnt c ON c.symbol = k.symbol AND c.level = k.level AND c.key = k.key),
pick AS (SELECT symbol, pos, CASE WHEN best IS NULL THEN 0 WHEN nb >= 50 THEN best ELSE greatest(best - 1, 0) END AS chosen FROM (
  SELECT symbol, pos, max(level) FILTER (n >= 30) AS best, max_by(n, level) FILTER (n >= 30) AS nb FROM ask GROUP BY ALL)),
used AS (SELECT p.symbol, p.pos, any_value(chosen) AS chosen, max(level) FILTER (moves > 0 AND level <= chosen) AS used FROM pick p JOIN ask a ON a.symbol = p.symbol AND a.pos = p.pos GROUP BY ALL),
fcs AS (SELECT u.symbol, u.pos, coalesce(used, chosen) AS fallback_level, a.n AS sample_count, a.key AS used_key, used IS NULL AS bare FROM used u
        JOIN ask a ON a.symbol = u.symbol AND a.pos = u.pos AND a.level = coalesce(used, chosen))"""


@register(
    "conditional_forecast",
    o.query(
        """SELECT f.symbol, f.pos, CAST(fallback_level AS INTEGER) AS fallback_level, sample_count, used_key,
        CASE WHEN sample_count >= 50 THEN 'high' WHEN sample_count >= 30 THEN 'medium' ELSE 'low' END AS confidence,
        concat_ws(',', CASE WHEN fallback_level < 4 THEN 'fallback_used' END, CASE WHEN sample_count < 30 THEN 'low_sample' END, CASE WHEN bare THEN 'no_transitions' END) AS warnings,
        round(t.p, 6) AS stay_probability FROM fcs f
        LEFT JOIN (SELECT symbol, level, key, count(*) FILTER (next_key = key) / nullif(count(next_key), 0) AS p, count(*) FILTER (next_key = key) AS c FROM seq GROUP BY ALL) t
        ON t.symbol = f.symbol AND t.level = f.fallback_level AND t.key = f.used_key AND t.c > 0""",
        *REC, FORECAST,
    ),
)
def _(spark, sf):
    return forecasts(spark, sf).select(
        "symbol", "pos", "fallback_level", "sample_count", "used_key", "confidence", F.array_join("warnings", ",").alias("warnings"),
        F.round(F.try_element_at("next_probs", F.col("used_key")), 6).alias("stay_probability"),
    )


@register(
    "forecast_rows",
    o.query(
        """SELECT symbol, CAST(NULL AS VARCHAR) AS date, base_state, conditions_requested, conditions_used, fallback_level, sample_count,
        CASE WHEN risk >= 0.9 THEN p * 0 ELSE p END AS probability, CAST(NULL AS VARCHAR) AS expected_value_after_cost, CAST(NULL AS VARCHAR) AS cost_model_used,
        CASE WHEN risk >= 0.9 THEN 'low' WHEN risk >= 0.75 THEN CASE WHEN c = 'high' THEN 'medium' ELSE 'low' END ELSE c END AS confidence,
        CAST(NULL AS VARCHAR) AS historical_stability, CAST(NULL AS VARCHAR) AS invalidation_trigger,
        concat_ws(',', CASE WHEN fallback_level < 4 THEN 'fallback_used' END, CASE WHEN sample_count < 30 THEN 'low_sample' END, CASE WHEN bare THEN 'no_transitions' END,
          'cross_asset_' || lower(stress), CASE WHEN risk >= 0.7 THEN 'reflexivity_elevated' END) AS warnings
        FROM (SELECT *, CASE WHEN stress = 'PANIC' THEN 'low' WHEN stress = 'STRESS' AND c0 = 'high' THEN 'medium' ELSE c0 END AS c FROM (
          SELECT f.symbol, r.b AS base_state, k.key AS conditions_requested, f.used_key AS conditions_used, CAST(f.fallback_level AS INTEGER) AS fallback_level, f.sample_count, round(t.p, 6) AS p, bare,
                 (f.pos % 11) / 11 AS risk, CASE f.pos % 3 WHEN 0 THEN 'PANIC' WHEN 1 THEN 'STRESS' ELSE 'CALM' END AS stress,
                 CASE WHEN f.sample_count >= 50 THEN 'high' WHEN f.sample_count >= 30 THEN 'medium' ELSE 'low' END AS c0
          FROM fcs f JOIN rec r ON r.symbol = f.symbol AND r.pos = f.pos JOIN keyed k ON k.symbol = f.symbol AND k.pos = f.pos AND k.level = 4
          LEFT JOIN (SELECT symbol, level, key, count(*) FILTER (next_key = key) / nullif(count(next_key), 0) AS p, count(*) FILTER (next_key = key) AS c FROM seq GROUP BY ALL) t
          ON t.symbol = f.symbol AND t.level = f.fallback_level AND t.key = f.used_key AND t.c > 0))""",
        *REC, FORECAST,
    ),
)
def _(spark, sf):
    df = forecasts(spark, sf).withColumn("stress", F.when(F.col("pos") % 3 == 0, "PANIC").when(F.col("pos") % 3 == 1, "STRESS").otherwise("CALM"))
    df = fc.with_tail_risk(fc.with_stress(df, "stress").withColumn("risk", (F.col("pos") % 11) / 11), "risk")
    df = fc.with_warning(df, F.col("risk") >= 0.7, "reflexivity_elevated")
    return rounded(fc.forecast_rows(df, "used_key"), "probability").withColumn("warnings", F.array_join("warnings", ","))


@register(
    "fallback_usage",
    o.query("SELECT CAST(fallback_level AS INTEGER) AS fallback_level, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT fallback_level, count(*) AS n FROM fcs GROUP BY 1)", *REC, FORECAST),
)
def _(spark, sf):
    return rounded(fc.fallback_usage(forecasts(spark, sf)), "share")


@register(
    "confidence_panel",
    o.query(
        """SELECT t.c AS confidence, t.k AS tier, count(f.symbol) AS n, round(count(f.symbol) / sum(count(f.symbol)) OVER (), 6) AS share
        FROM (VALUES ('high', 0), ('medium', 1), ('low', 2)) t(c, k)
        LEFT JOIN fcs f ON t.c = CASE WHEN sample_count >= 50 THEN 'high' WHEN sample_count >= 30 THEN 'medium' ELSE 'low' END GROUP BY ALL""",
        *REC, FORECAST,
    ),
)
def _(spark, sf):
    return rounded(fc.confidence_panel(forecasts(spark, sf)), "share")


@register("rarest_keys", o.query("SELECT symbol, level, key, count(*) AS n FROM seq WHERE level = 4 GROUP BY ALL ORDER BY n, symbol, key LIMIT 20", *REC))
def _(spark, sf):
    return fc.rarest(fc.state_counts(fc.leveled(records(spark, sf))).where("level = 4"))


@register(
    "coverage_by_symbol",
    o.query("SELECT symbol, count(*) AS n_forecasts, round(avg(sample_count), 6) AS mean_samples, round(avg(fallback_level), 6) AS mean_level FROM fcs GROUP BY symbol", *REC, FORECAST),
)
def _(spark, sf):
    return rounded(fc.coverage_by_symbol(forecasts(spark, sf)), "mean_samples", "mean_level")


@register(
    "warning_counts",
    o.query(
        """SELECT warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN fallback_level < 4 THEN 'fallback_used' END, CASE WHEN sample_count < 30 THEN 'low_sample' END,
        CASE WHEN bare THEN 'no_transitions' END], lambda x: x IS NOT NULL)) AS warning FROM fcs) GROUP BY 1""",
        *REC, FORECAST,
    ),
)
def _(spark, sf):
    return fc.warning_counts(forecasts(spark, sf))


# Fits without a SQL form


@register("bootstrap_sharpe")
def _(spark, sf):
    made = backtest.walkforward_backtest(labelled(spark, sf))[0].withColumnRenamed("signal_pos", "pos")
    return rounded(stats.bootstrap(made, "net_return", holding=5.0), "estimate", "low", "high")


@register("bootstrap_mean")
def _(spark, sf):
    return rounded(stats.bootstrap(add_indicators(bars(spark, sf)), "return_1d"), "estimate", "low", "high")


@register("hidden_regimes")
def _(spark, sf):
    df = add_indicators(bars(spark, sf)).select("symbol", "pos", "return_1d", "realized_vol_20")
    found = stats.hidden_regimes(df, ["return_1d", "realized_vol_20"])
    return stats.name_regimes(df.join(found, ["symbol", "pos"]))


@register("hidden_covariances")
def _(spark, sf):
    """Full covariances of the fitted models themselves."""
    columns = ["return_1d", "realized_vol_20"]
    models = stats.hidden_models(add_indicators(bars(spark, sf)), columns, covariance="full")[0]
    return rounded(stats.model_covariances(models, columns), "covariance", places=9)


@register("change_points")
def _(spark, sf):
    df = add_indicators(bars(spark, sf)).select("symbol", "pos", "return_1d")
    return paths.pause_after(changepoints.annotate_change_points(df), "is_changepoint", 5)


# Positions and streams


def signal_bars(spark, sf):
    """Bars with the estimate of their state, the drift alert as of the day and the day's macro veto."""
    df = labelled(spark, sf).select("symbol", "date", "pos", "close", "state")
    values = expectancy.walkforward(df, min_samples=10).select("symbol", "pos", "ev_after_cost", F.lit(True).alias("has_ev"))
    drift = monitoring.rolling_drift(df, threshold=DRIFT_ALERT).select("symbol", "pos", F.col("alert").alias("drift"))
    veto = macro(spark, sf).select("date", regimes.regime_allowed(F.col("macro_regime"), [-1, 0, 2]).alias("macro_ok"))
    joined = df.join(values, ["symbol", "pos"], "left").join(drift, ["symbol", "pos"], "left").join(veto, "date", "left")
    return joined.withColumns({"drift": F.coalesce("drift", F.lit(False)), "has_ev": F.coalesce("has_ev", F.lit(False))})


# A position opened at p is due at p + 5, when the next one may open: greedy choice with a gap of 5.
POSITIONS_SQL = (
    *LAB, MACRO, o.WALKFORWARD.replace("train_count >= 5", "train_count >= 10").replace("pos >= 10", "pos >= 15"), ROLLING_DRIFT,
    f"""sig AS (
      SELECT l.symbol, l.date, l.pos, l.close, l.state, wf.ev_after_cost, wf.symbol IS NOT NULL AS has_ev, lag(wf.ev_after_cost) OVER w AS ev,
             lag(l.date) OVER w AS signal_date, lag(l.state) OVER w AS signal_state, lag(wf.symbol IS NOT NULL) OVER w AS had_ev,
             coalesce(d.kl >= {DRIFT_ALERT}, false) AS drift, coalesce(coalesce(m.macro_regime, -1) IN (-1, 0, 2), true) AS macro_ok, max(l.pos) OVER (PARTITION BY l.symbol) AS last
      FROM lab l LEFT JOIN wf ON l.symbol = wf.symbol AND l.pos = wf.pos LEFT JOIN drifting d ON d.symbol = l.symbol AND d.pos = l.pos LEFT JOIN macro m ON m.date = l.date
      WINDOW w AS (PARTITION BY l.symbol ORDER BY l.pos))""",
    o.selected("psel", "(SELECT symbol, pos FROM sig WHERE ev > 0 AND NOT drift AND macro_ok AND pos + 5 <= last)", 3),
    """taken AS (
      SELECT e.symbol, e.pos, e.symbol || '-' || e.pos AS position_id, e.signal_date, e.date AS entry_date, e.close AS entry_price, 5 AS horizon,
             e.signal_state AS state, round(e.ev, 6) AS signal_ev, x.date AS target_exit_date, x.date AS exit_date, x.close AS exit_price,
             round(x.close / e.close - 1 - 0.0005, 6) AS net_return, 'horizon_reached' AS closed_reason
      FROM psel s JOIN sig e ON e.symbol = s.symbol AND e.pos = s.pos JOIN sig x ON x.symbol = e.symbol AND x.pos = e.pos + 5)""",
)
DECISIONS_SQL = """SELECT t.symbol, x.pos, x.date, 'close' AS action, 'horizon_reached' AS reason, position_id, exit_price AS price, net_return,
      CAST(NULL AS DATE) AS signal_date, CAST(NULL AS DOUBLE) AS signal_ev, CAST(NULL AS INTEGER) AS state FROM taken t JOIN sig x ON x.symbol = t.symbol AND x.pos = t.pos + 5
    UNION ALL SELECT g.symbol, g.pos, g.date, CASE WHEN e.symbol IS NOT NULL THEN 'open' ELSE 'skip_entry' END,
      CASE WHEN drift THEN 'drift_alert' WHEN NOT macro_ok THEN 'macro_filter' WHEN held.symbol IS NOT NULL THEN 'already_open' WHEN g.pos = 0 THEN 'no_yesterday_bar'
           WHEN NOT had_ev THEN 'no_ev_for_signal_date' WHEN coalesce(ev <= 0, true) THEN 'ev_below_threshold' WHEN e.symbol IS NULL THEN 'horizon_past_data' END,
      CASE WHEN e.symbol IS NOT NULL THEN e.position_id WHEN NOT drift AND macro_ok THEN held.position_id END, e.entry_price, NULL, e.signal_date,
      CASE WHEN NOT drift AND macro_ok AND held.symbol IS NULL AND g.pos > 0 AND had_ev AND (e.symbol IS NOT NULL OR ev <= 0) THEN round(ev, 6) END, e.state
    FROM sig g LEFT JOIN taken e ON e.symbol = g.symbol AND e.pos = g.pos
    LEFT JOIN taken held ON held.symbol = g.symbol AND g.pos > held.pos AND g.pos < held.pos + 5"""


def decisions(spark, sf):
    return positions.paper_trade(signal_bars(spark, sf))


def paper_positions(spark, sf):
    return positions.positions_from(decisions(spark, sf), labelled(spark, sf).select("symbol", "pos", "date"))


@register("paper_trading", o.query(DECISIONS_SQL, *POSITIONS_SQL, recursive=True))
def _(spark, sf):
    return rounded(decisions(spark, sf), "net_return", "signal_ev")


@register("latest_decisions", o.query(f"SELECT * FROM ({DECISIONS_SQL}) QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1", *POSITIONS_SQL, recursive=True))
def _(spark, sf):
    return rounded(positions.latest_decisions(decisions(spark, sf)), "net_return", "signal_ev")


@register("paper_positions", o.query("SELECT * EXCLUDE (pos) FROM taken", *POSITIONS_SQL, recursive=True))
def _(spark, sf):
    return rounded(paper_positions(spark, sf), "net_return", "signal_ev")


@register(
    "open_position_marks",
    o.query(
        """SELECT t.position_id, t.symbol, round(l.close / t.entry_price - 1, 6) AS unrealized FROM taken t JOIN days l ON l.symbol = t.symbol
        WHERE t.entry_date <= l.day AND t.exit_date > l.day""",
        *POSITIONS_SQL, "days AS (SELECT s.symbol, s.date AS day, s.close FROM sig s JOIN (SELECT symbol, max(pos) + 2 AS pos FROM taken GROUP BY symbol) n ON n.symbol = s.symbol AND n.pos = s.pos)",
        recursive=True,
    ),
)
def _(spark, sf):
    """Open positions two bars after each symbol's last entry, at that bar's close."""
    table, df = stored(paper_positions(spark, sf), "positions"), labelled(spark, sf)
    entries = table.groupBy("symbol").agg(F.max("entry_date").alias("entry_date"))
    bars_ = df.select("symbol", "date", "close", F.lead("date", 2).over(by_symbol()).alias("day"), F.lead("close", 2).over(by_symbol()).alias("price"))
    days = bars_.join(entries, "symbol").where("date = entry_date").select("symbol", "day", "price")
    held = positions.as_of(table, days.select("symbol", "day"))
    return rounded(positions.mark_to_market(held, days.select("symbol", "price")), "unrealized")


@register(
    "streaming_hourly_bars",
    """SELECT * FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
       min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)
       WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)""",
)
def _(spark, sf):
    from ..streaming import bars as streams

    bars_ = streams.drained(streams.streaming_hourly_bars(streams.event_stream(spark, sf)), "hourly")
    return bars_.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@register(
    "streaming_positions",
    o.query(
        """SELECT symbol, pos, 'open' AS action, CAST(NULL AS VARCHAR) AS reason, symbol || '-' || pos AS position_id, close AS price, CAST(NULL AS DOUBLE) AS net_return
        FROM sig JOIN ssel USING (symbol, pos)
        UNION ALL SELECT x.symbol, x.pos, 'close', 'horizon_reached', e.symbol || '-' || e.pos, x.close, round(x.close / e.close - 1 - 0.0005, 6)
        FROM ssel s JOIN sig e ON e.symbol = s.symbol AND e.pos = s.pos JOIN sig x ON x.symbol = e.symbol AND x.pos = e.pos + 5""",
        *POSITIONS_SQL, o.selected("ssel", "(SELECT symbol, pos FROM sig WHERE ev > 0 AND NOT drift AND macro_ok)", 3), recursive=True,
    ),
)
def _(spark, sf):
    """Daily bars written as files and read as a stream; decisions equal a batch run's, but for the end of the data."""
    from ..streaming import bars as streams

    signals = stored(signal_bars(spark, sf).withColumnRenamed("pos", "seq"), "signals")
    stream = spark.readStream.schema(signals.schema).parquet(signals.inputFiles()[0].rsplit("/", 1)[0])
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, streams.STATE_STORE)
    try:
        return rounded(streams.drained(streams.streaming_positions(stream), "positions"), "net_return")
    finally:
        spark.conf.set(key, before)


# Sorted and limited reports


@register("top_states_by_value", o.query(
    """SELECT symbol, state, n, round(ev, 6) AS ev_after_cost FROM (SELECT symbol, state, count(r) AS n, avg(r) - 0.0005 AS ev FROM fwd WHERE horizon = 5 GROUP BY ALL)
    WHERE n >= 10 ORDER BY abs(ev) DESC, symbol, state LIMIT 16""", *LAB, o.FORWARD))  # fmt: skip
def _(spark, sf):
    table = expectancy.expectancy(labelled(spark, sf), ["symbol", "state"], (5,)).where("n >= 10")
    top = table.orderBy(F.abs("ev_after_cost").desc(), "symbol", "state").limit(16)
    return rounded(top.select("symbol", "state", "n", "ev_after_cost"), "ev_after_cost")


@register("dashboard_summary", o.query(
    """SELECT max_by(m.symbol, m.total_return) AS best_symbol, min_by(m.symbol, m.total_return) AS worst_symbol,
    count(*) FILTER (m.total_return > h.total_return) AS beats_buy_hold FROM bt_b m JOIN hold h ON m.symbol = h.symbol""",
    *WF, o.TRADED, PERF, HOLD, recursive=True))
def _(spark, sf):
    df = labelled(spark, sf)
    own = backtest.walkforward_backtest(df)[2].select("symbol", "total_return")
    held = backtest.buy_and_hold(df).select("symbol", F.col("total_return").alias("held"))
    both = own.join(held, "symbol")
    return both.agg(
        F.max_by("symbol", "total_return").alias("best_symbol"), F.min_by("symbol", "total_return").alias("worst_symbol"),
        F.count_if(F.col("total_return") > F.col("held")).alias("beats_buy_hold"),
    )


@register("provider_pivot", o.query(
    """SELECT symbol, round(avg(close) FILTER (p = 'a'), 6) AS a_close, round(avg(volume) FILTER (p = 'a'), 6) AS a_volume,
    round(avg(close) FILTER (p = 'b'), 6) AS b_close, round(avg(volume) FILTER (p = 'b'), 6) AS b_volume,
    round(avg(close) FILTER (p = 'b') - avg(close) FILTER (p = 'a'), 6) AS close_delta,
    round(avg(volume) FILTER (p = 'b') - avg(volume) FILTER (p = 'a'), 6) AS volume_delta
    FROM (SELECT *, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'b' END AS p FROM bars) GROUP BY symbol""", o.BARS))  # fmt: skip
def _(spark, sf):
    df = bars(spark, sf).withColumn("provider", F.when(F.col("pos") % 2 == 0, "a").otherwise("b"))
    out = monitoring.provider_pivot(df, "a", "b", ["close", "volume"])
    return rounded(out, *[c for c in out.columns if c != "symbol"])


# Regimes by name, merged reports and dashboard views


def named_regimes(spark, sf):
    """Volatility states as regimes, with the returns and volatility that name them."""
    df = regimes.volatility_state(labelled(spark, sf)).withColumn("return_1d", quotient(F.col("close"), F.lag("close").over(by_symbol())) - 1)
    df = df.where("return_1d IS NOT NULL AND realized_vol_20 IS NOT NULL").withColumnRenamed("vol_state", "regime")
    return df, stats.name_regimes(df)


NAMED = """
rg AS (SELECT * FROM (SELECT symbol, pos, vol_state AS regime, realized_vol_20, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r FROM vol) WHERE r IS NOT NULL AND realized_vol_20 IS NOT NULL),
rm AS (SELECT symbol, regime, avg(r) AS mean_return, avg(realized_vol_20) AS mean_vol FROM rg GROUP BY ALL),
named AS (
  SELECT *, CASE WHEN mean_return >= median(mean_return) OVER (PARTITION BY symbol) THEN CASE WHEN mean_vol >= median(mean_vol) OVER (PARTITION BY symbol) THEN 'RISK_ON_VOLATILE' ELSE 'RISK_ON_TREND' END
            WHEN mean_vol >= median(mean_vol) OVER (PARTITION BY symbol) THEN 'RISK_OFF_VOLATILE' ELSE 'RISK_OFF_QUIET' END AS label FROM rm
)"""


@register("regime_names", o.query("SELECT symbol, regime, round(mean_return, 6) AS mean_return, round(mean_vol, 6) AS mean_vol, label FROM named", *LAB, o.VOL, NAMED))
def _(spark, sf):
    return rounded(named_regimes(spark, sf)[1], "mean_return", "mean_vol")


@register(
    "regime_signal",
    o.query("SELECT g.symbol, g.pos, g.regime, n.label IN ('RISK_ON_TREND', 'RISK_ON_VOLATILE') AS allowed FROM rg g JOIN named n ON n.symbol = g.symbol AND n.regime = g.regime", *LAB, o.VOL, NAMED),
)
def _(spark, sf):
    df, names = named_regimes(spark, sf)
    return regimes.regime_signal(df.select("symbol", "pos", "regime"), names, ["RISK_ON_TREND", "RISK_ON_VOLATILE"])


@register(
    "regime_covariances",
    o.query(
        """SELECT symbol, regime, x.a AS a, y.b AS b, round(CASE WHEN x.a <> y.b THEN 0.0 WHEN x.a = 'return_1d' THEN vr ELSE vv END, 9) AS covariance
        FROM (SELECT symbol, regime, var_pop(r) AS vr, var_pop(realized_vol_20) AS vv FROM rg GROUP BY ALL), (VALUES ('return_1d'), ('realized_vol_20')) x(a), (VALUES ('return_1d'), ('realized_vol_20')) y(b)""",
        *LAB, o.VOL, NAMED,
    ),
)
def _(spark, sf):
    df = named_regimes(spark, sf)[0]
    return rounded(stats.regime_covariances(df, stats.emissions(df, ("return_1d", "realized_vol_20", "not_there"))), "covariance", places=9)


@register(
    "merged_comparison",
    o.query(
        """SELECT m.symbol, model, round(m.total_return, 6) AS total_return, round(coalesce(excess, m.total_return - h.total_return), 6) AS excess_vs_buy_hold FROM (
          SELECT symbol, 'buy_and_hold' AS model, total_return, 0.0 AS excess FROM hold
          UNION ALL SELECT symbol, 'ma_crossover', total_return + 1, NULL FROM crossed UNION ALL SELECT symbol, 'breakout', total_return, NULL FROM broke) m JOIN hold h ON h.symbol = m.symbol""",
        o.BARS, HOLD, CROSS, BREAKOUT, recursive=True,
    ),
)
def _(spark, sf):
    df = bars(spark, sf)
    crossed = backtest.ma_crossover(df)
    existing = backtest.excess_over_holding([("buy_and_hold", backtest.buy_and_hold(df)), ("ma_crossover", crossed)])
    again = crossed.select("symbol", F.lit("ma_crossover").alias("model"), (F.col("total_return") + 1).alias("total_return"))
    new = again.unionByName(backtest.breakout(df).select("symbol", F.lit("breakout").alias("model"), "total_return"))
    return rounded(backtest.merge_models(existing, new), "total_return", "excess_vs_buy_hold")


@register(
    "source_summary_merged",
    o.query(
        """SELECT coalesce(a.symbol, b.symbol) AS symbol, a.n AS n_rows_left, b.n AS n_rows_right, a.lo AS first_date_left, b.lo AS first_date_right, a.hi AS last_date_left, b.hi AS last_date_right,
        CAST(0 AS BIGINT) + a.miss AS missing_close_left, b.miss AS missing_close_right
        FROM (SELECT symbol, count(*) AS n, min(date) AS lo, max(date) AS hi, count(*) - count(close) AS miss FROM bars WHERE symbol <> '5-LOW' GROUP BY 1) a
        FULL OUTER JOIN (SELECT symbol, count(*) AS n, min(date) AS lo, max(date) AS hi, count(*) - count(close) AS miss FROM bars WHERE symbol <> '2-HIGH' GROUP BY 1) b ON a.symbol = b.symbol""",
        o.BARS,
    ),
)
def _(spark, sf):
    df = bars(spark, sf)
    left = monitoring.summarize_source(df.where("symbol <> '5-LOW'"), ["close"])
    right = monitoring.summarize_source(df.where("symbol <> '2-HIGH'"), ["close"])
    return monitoring.merge_summaries(left, right, "left", "right")


@register(
    "performance_ranked",
    o.query(
        """SELECT symbol, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, trade_count, round(total_return, 6) AS total_return,
        CAST(row_number() OVER (ORDER BY round(total_return, 6) DESC NULLS LAST, symbol) AS INTEGER) AS place FROM bt_stats""",
        *WF, o.TRADED, PERF, recursive=True,
    ),
)
def _(spark, sf):
    made = rounded(backtest.walkforward_backtest(labelled(spark, sf))[2], *PERF_COLUMNS)
    return ranked(made.select("symbol", "sharpe", "max_drawdown", "trade_count", "total_return"), F.col("total_return").desc_nulls_last(), "symbol")


@register(
    "cluster_top_values",
    o.query(
        """SELECT cluster, state, n, ev_after_cost, CAST(row_number() OVER (ORDER BY ev_after_cost DESC, cluster, state) AS INTEGER) AS place FROM (
          SELECT cluster, state, count(r) AS n, round(avg(r) - 0.0005, 6) AS ev_after_cost FROM fwd f JOIN clus c ON f.symbol = c.symbol WHERE horizon = 5 GROUP BY ALL) QUALIFY place <= 16""",
        *LAB, o.FORWARD, FEATURES_SQL,
    ),
)
def _(spark, sf):
    clusters = paths.cluster_assets(paths.asset_features(bars(spark, sf))).select("symbol", "cluster")
    table = expectancy.expectancy(labelled(spark, sf).join(clusters, "symbol"), ["cluster", "state"], (5,))
    table = rounded(table.select("cluster", "state", "n", "ev_after_cost"), "ev_after_cost")
    order = (F.col("ev_after_cost").desc(), "cluster", "state")
    return ranked(table.orderBy(*order).limit(16), *order)


@register(
    "markov_top_values",
    _markov_value_sql(
        """SELECT symbol, pos, state, markov_ev, CAST(row_number() OVER (ORDER BY abs(markov_ev) DESC, symbol, pos) AS INTEGER) AS place
        FROM (SELECT symbol, pos, state, round(markov_ev, 6) AS markov_ev FROM markov_values WHERE markov_ev IS NOT NULL) QUALIFY place <= 20""",
        5,
    ),
)
def _(spark, sf):
    found = rounded(markov.walkforward_markov_value(labelled(spark, sf)), "markov_ev").where("markov_ev IS NOT NULL")
    order = (F.abs("markov_ev").desc(), "symbol", "pos")
    return ranked(found.select("symbol", "pos", "state", "markov_ev").orderBy(*order).limit(20), *order)


@register("sharpe_intervals_ranked")
def _(spark, sf):
    """Bootstrap intervals, the highest ratio first; the draws have no SQL form."""
    made = backtest.walkforward_backtest(labelled(spark, sf))[0].withColumnRenamed("signal_pos", "pos")
    found = rounded(stats.bootstrap(made, "net_return", holding=5.0), "estimate", "low", "high")
    return ranked(found, F.col("estimate").desc_nulls_last(), "symbol")


@register("cluster_members", o.query("SELECT cluster, string_agg(symbol, ', ' ORDER BY symbol) AS symbols, count(*) AS n FROM clus GROUP BY cluster", o.BARS, FEATURES_SQL))
def _(spark, sf):
    return paths.cluster_members(paths.cluster_assets(paths.asset_features(bars(spark, sf))))


@register(
    "volatility_bars",
    o.query(
        f"""SELECT symbol || ' V' || vol_state || ' S' || state AS key, n, ev_after_cost, CAST(row_number() OVER (ORDER BY abs(ev_after_cost) DESC, symbol, vol_state, state) AS INTEGER) AS place FROM (
          SELECT f.symbol, vol_state, f.state, count(r) AS n, round(avg(r) - 0.0005, 6) AS ev_after_cost FROM fwd f JOIN vol v ON f.symbol = v.symbol AND f.pos = v.pos WHERE horizon = 5 GROUP BY ALL)
        WHERE n >= 10 AND isfinite(ev_after_cost) QUALIFY place <= 10""",
        *LAB, o.VOL, o.FORWARD,
    ),
)
def _(spark, sf):
    df = regimes.volatility_state(labelled(spark, sf))
    table = rounded(expectancy.expectancy(df, ["symbol", "vol_state", "state"], (5,)), "ev_after_cost").where("n >= 10 AND abs(ev_after_cost) < double('inf')")
    order = (F.abs("ev_after_cost").desc(), "symbol", "vol_state", "state")
    top = ranked(table.orderBy(*order).limit(10), *order)
    return top.select(F.concat("symbol", F.lit(" V"), "vol_state", F.lit(" S"), "state").alias("key"), "n", "ev_after_cost", "place")


@register(
    "fallback_ranked",
    o.query(
        """SELECT CAST(fallback_level AS INTEGER) AS fallback_level, n, round(n / sum(n) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY fallback_level) AS INTEGER) AS place
        FROM (SELECT fallback_level, count(*) AS n FROM fcs GROUP BY 1)""",
        *REC, FORECAST,
    ),
)
def _(spark, sf):
    return ranked(rounded(fc.fallback_usage(forecasts(spark, sf)), "share"), "fallback_level")


@register("dashboard_clusters", o.query("SELECT cluster, count(*) AS n FROM clus GROUP BY cluster", o.BARS, FEATURES_SQL))
def _(spark, sf):
    return paths.cluster_assets(paths.asset_features(bars(spark, sf))).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
