"""Event streams to hourly bars, and bars to simulated positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.positions import CARRIED, carried_on, resumed, step
from ..sources.storage import new_path

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob)
    return reader.parquet(folder)


def streaming_hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hourly bars; an hour is final once the watermark has passed it, and later events are dropped."""
    keyed = events.select(
        F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("event_type").alias("symbol"), "value"
    ).withWatermark("at", late)
    order = F.struct("at", "event_id")
    bars = keyed.groupBy("symbol", F.window("at", "1 hour").alias("w")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return bars.select("symbol", F.col("w.start").alias("hour"), "open", "high", "low", "close", "volume")


OUT = "symbol STRING, pos INT, action STRING, reason STRING, position_id STRING, price DOUBLE, net_return DOUBLE"
#: The state of a symbol is the row that a daily job would carry on, without the symbol.
STATE = ", ".join(CARRIED.split(", ")[1:])
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Positions(StatefulProcessor):
    """Folds a symbol's bars, with its carried row as typed state; the first state may come from a table."""

    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.to_dict("records")[0]
        self.carried.update(self._row(row))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        symbol = key[0]
        names = [c.split()[0] for c in STATE.split(", ")]
        old = dict(zip(names, self.carried.get(), strict=True)) if self.carried.exists() else None
        held, last, pos = resumed(old, symbol)
        out, bar = [], None
        for bar in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            bar |= {"pos": pos}
            held, made = step(held, bar, last, self.options)
            out += [m for m in made if m["action"] != "skip_entry"]
            last, pos = bar, pos + 1
        if bar is not None:
            self.carried.update(self._row(carried_on(symbol, pos - 1, bar, held)))
        columns = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame([[symbol if c == "symbol" else m.get(c) for c in columns] for m in out], columns=columns, dtype=object)

    @staticmethod
    def _row(row: dict) -> tuple:
        kinds = {"pos": int, "state": int, "target_pos": int, "ev_after_cost": float, "entry_price": float, "has_ev": bool}
        names = [c.split()[0] for c in STATE.split(", ")]
        values = [None if row.get(c) is None or pd.isna(row[c]) else row[c] for c in names]
        return tuple(v if v is None or c not in kinds else kinds[c](v) for c, v in zip(names, values, strict=True))

    def close(self) -> None:
        pass


def streaming_positions(bars: DataFrame, horizon: int = 5, threshold: float = 0.0, cost_bps: float = 5.0, carried: DataFrame | None = None) -> DataFrame:
    """Decisions as bars (symbol, seq, close, ev_after_cost, and optionally date,
    state, has_ev, drift, macro_ok) arrive, one small state per symbol.

    ``carried`` are rows of a daily job or an earlier stream to go on from.
    The exit is set when a position opens, so the newest bar can open one; a
    batch's bars are taken in the order of ``seq``. (symbol, pos, action) is an
    idempotent key for the sink. The session needs the state store STATE_STORE.
    """
    options = {"horizon": horizon, "threshold": threshold, "cost_bps": cost_bps}
    slim = bars.select(*[c for c in ("symbol", "seq", "date", "close", "ev_after_cost", "state", "has_ev", "drift", "macro_ok") if c in bars.columns])
    first = None if carried is None else carried.groupBy("symbol")
    return slim.groupBy("symbol").transformWithStateInPandas(Positions(options), OUT, "Append", "None", first)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there and return its rows as a Parquet table."""
    spark = stream.sparkSession
    base = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
