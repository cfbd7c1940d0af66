"""Volatility, macro, calendar, liquidity and stress states, and risk scores."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import EVENT_DATES, LIQUIDITY_COST_BPS
from ..functions.windows import by_symbol, clip01, trailing

VOL_COLUMNS = ("realized_vol_20", "atr_14", "bb_width_20")


def volatility_state(df: DataFrame, lookback: int = 63, delta: int = 21, low: float = -0.25, high: float = 0.25) -> DataFrame:
    """Append ``vol_rank`` and ``vol_state``: the value's percentile rank in its
    last ``lookback`` bars (ties averaged), and its change over ``delta`` bars."""
    column = next((c for c in VOL_COLUMNS if c in df.columns), None)
    if column is None:
        raise ValueError(f"one of {', '.join(VOL_COLUMNS)} is needed")
    frame = trailing(lookback)
    df = df.withColumn("_seen", F.collect_list(column).over(frame))
    below = F.size(F.filter("_seen", lambda x: x < F.col(column)))
    equal = F.size(F.filter("_seen", lambda x: x == F.col(column)))
    rank = F.when((F.size("_seen") == lookback) & F.col(column).isNotNull(), (below + (equal + 1) / 2) / lookback)
    before = F.lag(column, delta).over(by_symbol())
    df = df.withColumns({"vol_rank": rank, "_change": F.col(column) / F.nullif(before, F.lit(0.0)) - 1})
    state = (
        F.when(F.col("vol_rank").isNull(), 1)
        .when(F.col("_change") >= high, 4)
        .when(F.col("_change") <= low, 3)
        .when(F.col("vol_rank") >= 2 / 3, 2)
        .when(F.col("vol_rank") <= 1 / 3, 0)
        .otherwise(1)
    )
    return df.withColumn("vol_state", state.cast("int")).drop("_seen", "_change")


def position_size(value: Column, risk: Column, atr: Column, mult: Column) -> Column:
    """Units that lose ``risk`` of ``value`` on a move of ``mult`` average ranges."""
    good = (value > 0) & (risk > 0) & (atr > 0) & (mult > 0)
    return F.when(good, value * risk / F.nullif(atr * mult, F.lit(0.0))).otherwise(
        F.raise_error(F.lit("position size needs positive inputs")).cast("double")
    )


def macro_regime(index: DataFrame, vix: DataFrame | None = None, window: int = 200, stressed: float = 25.0, calm: float = 15.0) -> DataFrame:
    """Regime of each date of ``index`` (date, close): 0 on, 1 off, 2 neutral, null before the mean is full.

    ``vix`` (date, vix) is taken on the index's dates, then carried forward;
    its values on other dates are lost. Without it volatility counts as calm.
    An index has a row a date, so the calendar bounds what the one window sorts.
    """
    order = Window.orderBy("date")
    df = index
    if vix is None:
        df = df.withColumn("vix", F.lit(None).cast("double"))
    else:
        df = df.join(vix, "date", "left")
        df = df.withColumn("vix", F.last("vix", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    frame = order.rowsBetween(-(window - 1), 0)
    df = df.withColumn("_ma", F.when(F.count("close").over(frame) == window, F.avg("close").over(frame)))
    cool = F.lit(True) if vix is None else F.coalesce(F.col("vix") <= calm, F.lit(False))
    hot = F.lit(False) if vix is None else F.coalesce(F.col("vix") >= stressed, F.lit(False))
    regime = (
        F.when(F.col("_ma").isNull(), F.lit(None))
        .when((F.col("close") < F.col("_ma")) | hot, 1)
        .when((F.col("close") > F.col("_ma")) & cool, 0)
        .otherwise(2)
    )
    return df.withColumn("macro_regime", regime.cast("int")).drop("_ma")


def regime_allowed(regime: Column, allowed: list[int]) -> Column:
    """Whether a regime is allowed; unknown (null) only if -1 is."""
    if not allowed:
        raise ValueError("at least one regime must be allowed")
    return F.coalesce(regime, F.lit(-1)).isin(allowed)


def regime_signal(df: DataFrame, labels: DataFrame, allowed: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Append ``allowed``: whether the bar's ``regime`` has one of the allowed labels by ``labels``
    (keys, regime, label); false for an unknown regime or one without a label."""
    if not allowed:
        raise ValueError("at least one label must be allowed")
    named = labels.select(*keys, "regime", "label")
    joined = df.join(F.broadcast(named), [*keys, "regime"], "left")  # a row a regime
    return joined.withColumn("allowed", F.coalesce(F.col("label").isin(allowed), F.lit(False))).drop("label")


def distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def holidays(first: int, last: int) -> list[datetime.date]:
    """US federal holidays as observed, Good Friday, and Juneteenth from 2021."""
    from pandas.tseries.holiday import GoodFriday, USFederalHolidayCalendar

    start, end = f"{first}-01-01", f"{last}-12-31"
    found = {d.date() for d in USFederalHolidayCalendar().holidays(start, end)} | {d.date() for d in GoodFriday.dates(start, end)}
    for year in range(max(first, 2021), last + 1):
        day = datetime.date(year, 6, 19)
        found.add(day + datetime.timedelta(days={5: -1, 6: 1}.get(day.weekday(), 0)))
    return sorted(found)


def _days(texts: list[str], *shifts: int) -> list[datetime.date]:
    return sorted({datetime.date.fromisoformat(x) + datetime.timedelta(days=s) for x in texts for s in shifts})


def near_holidays(year: int) -> list[datetime.date]:
    """The year's weekdays next to a holiday of that year or a neighbouring one."""
    near = {d + datetime.timedelta(days=s) for d in holidays(year - 1, year + 1) for s in (-1, 1)}
    return sorted(d for d in near if d.weekday() < 5 and d.year == year)


def with_calendar_state(df: DataFrame, day: str, out: str = "calendar_state") -> DataFrame:
    """Append each day's state. Holidays are made for the years that the column
    holds, in a task each, and joined: nothing is computed before the result is asked for."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_near": [d for y in pdf["y"] for d in near_holidays(int(y))]})

    years = df.select(F.year(day).alias("y")).where("y IS NOT NULL").distinct()
    marked = df.join(years.mapInPandas(near, "_near date"), F.to_date(day) == F.col("_near"), "left")
    return marked.withColumn(out, calendar_state(F.col(day), F.col("_near").isNotNull())).drop("_near")


def calendar_state(day: Column, next_to_holiday: Column) -> Column:
    """The first that applies: FOMC_WINDOW (a day around), CPI_WINDOW (the day
    or the one before), OPEX_WEEK (Monday to the third Friday), MONTH_END (the
    last three weekdays), HOLIDAY_LIQUIDITY (a weekday next to a holiday), NONE."""
    friday = F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FRI"), 14)
    end = F.last_day(day)
    # Weekdays after a day in its month: at most two for the last three weekdays.
    later = F.filter(F.sequence(F.date_add(day, 1), F.greatest(end, F.date_add(day, 1))), lambda x: (x <= end) & (F.weekday(x) < 5))
    month_end = (F.weekday(day) < 5) & (F.datediff(end, day) <= 5) & (F.size(later) < 3)
    return (
        F.when(day.isin(_days(EVENT_DATES["FOMC"], -1, 0, 1)), "FOMC_WINDOW")
        .when(day.isin(_days(EVENT_DATES["CPI"], -1, 0)), "CPI_WINDOW")
        .when(day.between(F.date_sub(friday, 4), friday), "OPEX_WEEK")
        .when(month_end, "MONTH_END")
        .when(next_to_holiday, "HOLIDAY_LIQUIDITY")
        .otherwise("NONE")
    )


# Volume score, realized volatility and gap above which each state begins (thin: below the score),
# and the index, spread and dollar score above which each level of stress does.
LIQUIDITY = {"panic": (4.0, 0.06, 0.05), "stressed": (2.5, 0.04, 0.03), "thin": (-1.0, 0.025)}
STRESS = {"PANIC": (40.0, 8.0, 3.0), "STRESS": (28.0, 5.5, 2.0), "ELEVATED": (20.0, 4.0, 1.5)}


def _any(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def liquidity_state(volume_z: Column, vol: Column, gap: Column, limits: dict | None = None) -> Column:
    """PANIC_LIQUIDITY, STRESSED_LIQUIDITY, THIN_LIQUIDITY or NORMAL_LIQUIDITY; a null input decides nothing."""
    at = limits or LIQUIDITY
    out = F  # F.when begins the chain
    for name, key in (("PANIC_LIQUIDITY", "panic"), ("STRESSED_LIQUIDITY", "stressed")):
        z, v, g = at[key]
        out = out.when(_any(volume_z > z, vol > v, F.abs(gap) > g), name)
    z, v = at["thin"]
    return out.when(_any(volume_z < z, vol > v), "THIN_LIQUIDITY").otherwise("NORMAL_LIQUIDITY")


def cross_asset_stress(vix: Column, spread: Column, dollar_z: Column, limits: dict | None = None) -> Column:
    out = F  # F.when begins the chain
    for name, (a, b, c) in (limits or STRESS).items():
        out = out.when(_any(vix > a, spread > b, F.abs(dollar_z) > c), name)
    return out.otherwise("CALM")


def _known(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# Weights and scales of the two scores.
def tail_risk(vol: Column, volume_z: Column, gap: Column, drawdown: Column) -> Column:
    score = (
        0.35 * clip01(_known(vol) / 0.6)
        + 0.30 * clip01(F.abs(_known(volume_z)) / 4)
        + 0.20 * clip01(F.abs(_known(gap)) / 0.05)
        + 0.15 * clip01(F.abs(_known(drawdown)) / 0.3)
    )
    return F.round(score, 6)


def reflexivity(change: Column, volume_z: Column, correlation: Column, kurtosis: Column) -> Column:
    score = (
        0.25 * clip01(F.abs(_known(change)) / 0.05)
        + 0.35 * clip01(F.abs(_known(volume_z)) / 4)
        + 0.20 * clip01(F.abs(_known(correlation)))
        + 0.20 * clip01((_known(kurtosis) - 3) / 10)
    )
    return F.round(score, 6)


def cost_bps(state: Column, side: Column | None = None, costs: dict[str, float] | None = None) -> Column:
    """Round-trip cost in basis points by liquidity state (unknown: NORMAL_LIQUIDITY); half of it for one side."""
    table = LIQUIDITY_COST_BPS | (costs or {})
    out = F  # F.when begins the chain
    for name, value in table.items():
        out = out.when(state == name, value)
    whole = out.otherwise(table["NORMAL_LIQUIDITY"])
    return whole if side is None else F.when(side.isin("entry", "exit"), whole / 2).otherwise(whole)


def entry_blocked(state: Column) -> Column:
    return F.coalesce(state == "PANIC_LIQUIDITY", F.lit(False))
