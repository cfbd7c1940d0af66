"""Simulated positions: the daily step as a fold over each symbol's bars, and the table of positions.

Nothing here places orders. A position opens at a close and is due a number of
bars later; one symbol holds at most one at a time.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.constants import COST_BPS
from ..sources.storage import names_in, read_file, remove, replace_file, stored

DECISIONS = (
    "symbol string, pos int, date date, action string, reason string, position_id string, price double, net_return double, "
    "signal_date date, signal_ev double, state int"
)
POSITIONS = (
    "position_id string, symbol string, signal_date date, entry_date date, entry_price double, horizon int, state int, "
    "signal_ev double, target_exit_date date, exit_date date, exit_price double, net_return double, closed_reason string"
)
SCHEMA_VERSION = 1


def _known(value) -> bool:
    return value is not None and not pd.isna(value)


def _flag(bar: dict, name: str) -> bool | None:
    return bool(bar[name]) if _known(bar.get(name)) else None


def step(position: dict | None, bar: dict, before: dict | None, options: dict) -> tuple[dict | None, list[dict]]:
    """One bar's decisions, in order: close what is due, then the gates, then open.

    ``before`` is the previous bar, whose state and expected value are the
    signal. Drift, a macro veto, an open position, no bar before, none with an
    estimate, an estimate that is missing or at most the threshold, and an exit
    beyond the data (``last_pos``, where it is known) each skip the entry.
    """
    made: list[dict] = []

    def note(action, reason, **more):
        made.append({"pos": bar["pos"], "date": bar["date"], "action": action, "reason": reason} | more)

    if position and bar["pos"] >= position["target_pos"]:
        net = bar["close"] / position["entry_price"] - 1 - options["cost_bps"] / 1e4
        note("close", "horizon_reached", position_id=position["position_id"], price=bar["close"], net_return=net)
        position = None
    ev = before.get("ev_after_cost") if before else None
    last = options.get("last_pos")
    if _flag(bar, "drift") is True:
        note("skip_entry", "drift_alert")
    elif _flag(bar, "macro_ok") is False:
        note("skip_entry", "macro_filter")
    elif position:
        note("skip_entry", "already_open", position_id=position["position_id"])
    elif before is None:
        note("skip_entry", "no_yesterday_bar")
    elif _flag(before, "has_ev") is False:
        note("skip_entry", "no_ev_for_signal_date")
    elif not _known(ev) or ev <= options["threshold"]:
        note("skip_entry", "ev_below_threshold", signal_ev=ev if _known(ev) else None)
    elif last is not None and bar["pos"] + options["horizon"] > last:
        note("skip_entry", "horizon_past_data")
    else:
        position = {
            "position_id": f"{bar['symbol']}-{bar['pos']}", "entry_price": bar["close"], "target_pos": bar["pos"] + options["horizon"],
        }
        state = before.get("state")
        note(
            "open", None, position_id=position["position_id"], price=bar["close"], signal_ev=float(ev),
            signal_date=before.get("date"), state=int(state) if _known(state) else None,
        )
    return position, made


def paper_trade(bars: DataFrame, horizon: int = 5, threshold: float = 0.0, cost_bps: float = COST_BPS) -> DataFrame:
    """Decisions for every bar of (symbol, date, pos, close, ev_after_cost, and
    optionally state, has_ev, drift, macro_ok). The fold is sequential, one task a symbol."""
    options = {"horizon": horizon, "threshold": threshold, "cost_bps": cost_bps}
    wanted = ("symbol", "date", "pos", "close", "ev_after_cost", "state", "has_ev", "drift", "macro_ok")
    names = [c for c in wanted if c in bars.columns]
    columns = [c.split()[0] for c in DECISIONS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = options | {"last_pos": int(pdf["pos"].iat[-1])}
        position, before, out = None, None, []
        for values in pdf.itertuples(index=False, name=None):
            bar = dict(zip(names, values, strict=True))
            position, made = step(position, bar, before, own)
            out += made
            before = bar
        symbol = pdf["symbol"].iat[0]
        rows = [[symbol if c == "symbol" else made.get(c) for c in columns] for made in out]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return bars.select(*names).groupBy("symbol").applyInPandas(run, DECISIONS)


#: What a symbol carries from one day to the next: the last bar's number and signal, and the position it holds.
CARRIED = (
    "symbol string, pos int, date date, ev_after_cost double, state int, has_ev boolean, position_id string, entry_price double, target_pos int"
)
_CARRIED = [c.split()[0] for c in CARRIED.split(", ")]


def nothing_carried(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CARRIED)


def resumed(carried: dict | None, symbol: str) -> tuple[dict | None, dict | None, int]:
    """The position held, the bar before and the next bar's number, from a carried row."""
    if carried is None:
        return None, None, 0
    held = None
    if _known(carried["position_id"]):
        held = {"position_id": carried["position_id"], "symbol": symbol, "entry_price": carried["entry_price"], "target_pos": int(carried["target_pos"])}
    return held, {c: carried[c] for c in ("date", "ev_after_cost", "state", "has_ev")}, int(carried["pos"]) + 1


def carried_on(symbol: str, pos: int, bar: dict, held: dict | None) -> dict:
    """The row that the next day starts from."""
    own = {c: (bar.get(c) if _known(bar.get(c)) else None) for c in ("date", "ev_after_cost", "state", "has_ev")}
    p = held or {}
    return {"symbol": symbol, "pos": pos} | own | {c: p.get(c) for c in ("position_id", "entry_price", "target_pos")}


def daily_step(carried: DataFrame, bars: DataFrame, horizon: int = 5, threshold: float = 0.0, cost_bps: float = COST_BPS) -> tuple[DataFrame, DataFrame]:
    """The day's decisions and the rows to carry on, from the rows carried so far and the new bars alone.

    ``bars`` (symbol, date, close, ev_after_cost, and optionally state, has_ev,
    drift, macro_ok) may be of one or several days; nothing earlier is read
    again. The end of the data isn't known in advance, so the newest bar may
    open a position. Symbols without a new bar are carried on as they are.
    Both tables are stored once, and come from the same pass.
    """
    options = {"horizon": horizon, "threshold": threshold, "cost_bps": cost_bps}
    wanted = ("symbol", "date", "close", "ev_after_cost", "state", "has_ev", "drift", "macro_ok")
    names = [c for c in wanted if c in bars.columns]
    columns = [c.split()[0] for c in DECISIONS.split(", ")]

    def run(before: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        old = before.to_dict("records")[0] if len(before) else None
        symbol = new["symbol"].iat[0] if len(new) else old["symbol"]
        held, last, pos = resumed(old, symbol)
        out, bar = [], None
        for values in new.sort_values("date").itertuples(index=False, name=None):
            bar = dict(zip(names, values, strict=True)) | {"pos": pos}
            held, made = step(held, bar, last, options)
            out += [m | {"symbol": symbol} for m in made]
            last, pos = bar, pos + 1
        rows = [[False, *[m.get(c) for c in columns], *[None] * len(_CARRIED)] for m in out]
        row = old if bar is None else carried_on(symbol, pos - 1, bar, held)
        rows.append([True, *[None] * len(columns), *[row[c] if _known(row[c]) else None for c in _CARRIED]])
        return pd.DataFrame(rows, columns=["is_carried", *columns, *[f"c_{c}" for c in _CARRIED]], dtype=object)

    both = f"is_carried boolean, {DECISIONS}, " + ", ".join(f"c_{c}" for c in CARRIED.split(", "))
    made = carried.groupBy("symbol").cogroup(bars.select(*names).groupBy("symbol")).applyInPandas(run, both)
    made = stored(made, "daily-step")
    return made.where("NOT is_carried").select(*columns), made.where("is_carried").select(*[F.col(f"c_{c}").alias(c) for c in _CARRIED])


def positions_from(decisions: DataFrame, bars: DataFrame, horizon: int = 5) -> DataFrame:
    """The positions table of the decisions; an open position has no exit. ``bars`` (symbol, pos, date) date the targets."""
    opened, closed = F.col("action") == "open", F.col("action") == "close"

    def at(condition: Column, column: str) -> Column:
        return F.max(F.when(condition, F.col(column)))

    rows = decisions.where("action IN ('open', 'close')").groupBy("symbol", "position_id").agg(
        at(opened, "signal_date").alias("signal_date"),
        at(opened, "date").alias("entry_date"),
        at(opened, "price").alias("entry_price"),
        F.lit(horizon).alias("horizon"),
        at(opened, "state").alias("state"),
        at(opened, "signal_ev").alias("signal_ev"),
        (at(opened, "pos") + horizon).alias("_target"),
        at(closed, "date").alias("exit_date"),
        at(closed, "price").alias("exit_price"),
        at(closed, "net_return").alias("net_return"),
        at(closed, "reason").alias("closed_reason"),
    )
    dates = bars.select("symbol", F.col("pos").alias("_target"), F.col("date").alias("target_exit_date"))
    return rows.join(dates, ["symbol", "_target"], "left").select(*[c.split()[0] for c in POSITIONS.split(", ")])


def no_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSITIONS)


def open_positions(positions: DataFrame, symbol: str | None = None) -> DataFrame:
    found = positions.where("exit_date IS NULL")
    return found if symbol is None else found.where(F.col("symbol") == symbol)


def closed_positions(positions: DataFrame) -> DataFrame:
    return positions.where("exit_date IS NOT NULL")


def has_open_position(positions: DataFrame, symbol: str) -> bool:
    return not open_positions(positions, symbol).isEmpty()


def opened(positions: DataFrame, position: dict) -> DataFrame:
    """The table with one more position; an id that is taken, or a symbol that holds one, is an error."""
    if not positions.where(F.col("position_id") == position["position_id"]).isEmpty():
        raise ValueError(f"position {position['position_id']} exists")
    if has_open_position(positions, position["symbol"]):
        raise ValueError(f"{position['symbol']} has an open position")
    return positions.unionByName(positions.sparkSession.createDataFrame([position], POSITIONS))


def closed(positions: DataFrame, position_id: str, exit_date, exit_price: float, reason: str, cost_bps: float = 0.0) -> DataFrame:
    """The table with that position closed; an unknown id or a closed position is an error."""
    own = F.col("position_id") == position_id
    found = positions.where(own).select("exit_date").first()
    if found is None:
        raise KeyError(f"unknown position {position_id}")
    if found["exit_date"] is not None:
        raise ValueError(f"position {position_id} is closed already")
    values = {
        "exit_date": F.lit(exit_date).cast("date"),
        "exit_price": F.lit(float(exit_price)),
        "net_return": F.lit(float(exit_price)) / F.col("entry_price") - 1 - cost_bps / 1e4,
        "closed_reason": F.lit(reason),
    }
    return positions.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items()})


#: Snapshots that stay readable behind the newest.
KEPT_SNAPSHOTS = 2


class Conflict(RuntimeError):
    """Another writer has saved a version since this one's was read."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """The saved versions, oldest first."""
    return [int(name[:-5]) for name in names_in(spark, f"{path}/log") if name.endswith(".json") and name[:-5].isdigit()]


def save_positions(positions: DataFrame, path: str, expected: int | None = None) -> int:
    """Save the table as the next version, which is returned.

    The rows go to a folder of their own, and one rename of a small log entry
    makes them the newest version. So ``positions`` may be read from ``path``
    itself, a crash in between leaves the version before, and of two writers
    the later one fails. ``expected`` is the version that ``positions`` came
    from (0: none), if it must still be the newest.
    """
    spark = positions.sparkSession
    before = max(versions(spark, path), default=0)
    if expected is not None and expected != before:
        raise Conflict(f"version {before} is the newest, not {expected}")
    folder = f"snapshot-{before + 1:08d}-{uuid.uuid4().hex[:8]}"
    positions.write.parquet(f"{path}/{folder}")
    entry = {"schema_version": SCHEMA_VERSION, "snapshot": folder}
    try:
        replace_file(spark, f"{path}/log/{before + 1:08d}.json", json.dumps(entry).encode(), new=True)
    except FileExistsError as e:
        remove(spark, f"{path}/{folder}")
        raise Conflict(f"version {before + 1} was saved meanwhile") from e
    for old in versions(spark, path)[: -1 - KEPT_SNAPSHOTS]:
        remove(spark, f"{path}/{_entry(spark, path, old)['snapshot']}")
        remove(spark, f"{path}/log/{old:08d}.json")
    return before + 1


def _entry(spark: SparkSession, path: str, version: int) -> dict:
    found = read_file(spark, f"{path}/log/{version:08d}.json")
    if found is None:
        raise FileNotFoundError(f"{path}: no version {version}")
    return json.loads(found)


def load_positions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest saved table or that ``version``, empty if there is none; another schema version is an error."""
    saved = versions(spark, path)
    if not saved and version is None:
        return no_positions(spark)
    entry = _entry(spark, path, saved[-1] if version is None else version)
    if entry["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {entry['schema_version']} instead of {SCHEMA_VERSION}")
    return spark.read.schema(POSITIONS).parquet(f"{path}/{entry['snapshot']}")


def as_of(positions: DataFrame, days: DataFrame) -> DataFrame:
    """The table as it was at each symbol's ``day`` (symbol, day): later entries are gone, later exits open."""
    known = positions.join(F.broadcast(days), "symbol").where(F.col("entry_date") <= F.col("day"))  # a row a symbol
    exits = ("exit_date", "exit_price", "net_return", "closed_reason")
    later = F.col("exit_date") > F.col("day")
    return known.select(*[F.when(~F.coalesce(later, F.lit(False)), F.col(c)).alias(c) if c in exits else F.col(c) for c in positions.columns])


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised returns of open positions whose symbol has a price (symbol, price)."""
    held = open_positions(positions).join(prices, "symbol")
    return held.select("position_id", "symbol", (F.col("price") / F.col("entry_price") - 1).alias("unrealized"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """What each symbol's newest bar decided: the daily job's rows."""
    newest = Window.partitionBy("symbol").orderBy(F.col("pos").desc())
    return decisions.withColumn("_n", F.dense_rank().over(newest)).where("_n = 1").drop("_n")
