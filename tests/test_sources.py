"""Vendors as data sources, the versioned position store, resumable days, and checks of given tables."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast, markov, positions
from tidemark.sources import storage, store, vendor
from tidemark.streaming import bars as streams


def answers(folder):
    """A vendor that keeps a file for each request and fails the first one of some."""

    def fetch(symbol, start, end):
        import pathlib
        import uuid

        made = pathlib.Path(folder)
        before = len(list(made.glob(f"{symbol}_{start}_*")))
        (made / f"{symbol}_{start}_{uuid.uuid4().hex}").touch()
        if symbol == "BAD":
            raise OSError("always away")
        if symbol == "SLOW" and not before:
            raise OSError("away")
        day = {"open": 1, "High": "2.5", "low": 0.5, "close": 1.5, "volume": 10}
        rows = [day | {"date": start}, day | {"date": start, "close": 1.75}, day | {"date": end, "close": "n/a"}]
        return {"data": rows} if symbol == "SLOW" else rows

    return fetch


def test_a_partition_is_a_symbol_and_a_range(spark, tmp_path):
    df = vendor.read_vendor(spark, "test", answers(str(tmp_path)), [" spy ", "slow", "SPY"], "2024-01-01", "2024-01-25", days=10, wait=0)
    assert df.rdd.getNumPartitions() == 6
    rows = store.stored(df, "rows").collect()
    assert len(rows) == 18 and {r.symbol for r in rows} == {"SPY", "SLOW"} and {r.high for r in rows} == {2.5}
    assert {r.date for r in rows} == {datetime.date(2024, 1, d) for d in (1, 10, 11, 20, 21, 25)}
    assert len(list(tmp_path.glob("SPY_*"))) == 3 and len(list(tmp_path.glob("SLOW_*"))) == 6  # each range of SLOW twice
    assert sum(r.close is None for r in rows) == 6
    assert len({(r.symbol, r.ingest_seq) for r in rows}) == 18
    # A task that runs again gives the same rows.
    assert sorted(map(tuple, df.drop("date").collect()), key=str) == sorted(map(tuple, df.drop("date").collect()), key=str)


def test_download_through_the_source(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(store.PROVIDERS, "test", answers(str(tmp_path)))
    got = store.download(spark, ["SPY", "SLOW"], "2024-01-01", "2024-01-25", "test", wait=0).orderBy("symbol", "date").collect()
    # The last row of a date wins; the last date has no close and goes.
    assert [(r.symbol, str(r.date), r.pos, r.close) for r in got] == [("SLOW", "2024-01-01", 0, 1.75), ("SPY", "2024-01-01", 0, 1.75)]
    assert len(list(tmp_path.glob("SPY_*"))) == 1
    with pytest.raises(Exception, match="always away"):
        store.download(spark, "bad", "2024-01-01", "2024-01-25", "test", wait=0)
    for rows in ([{"date": "2024-01-01", "open": 1}], {"error": "limit"}):
        monkeypatch.setitem(store.PROVIDERS, "odd", lambda *a, rows=rows: rows)
        with pytest.raises(Exception, match="missing columns|no records"):
            store.download(spark, "X", "2024-01-01", "2024-01-25", "odd")
    monkeypatch.setitem(store.PROVIDERS, "none", lambda *a: [])
    with pytest.raises(ValueError, match="nothing"):
        store.download(spark, "X", "a", "b", "none")


def position(i, symbol="SPY"):
    return {
        "position_id": f"{symbol}-{i}", "symbol": symbol, "signal_date": datetime.date(2024, 1, 1), "entry_date": datetime.date(2024, 1, 2), "entry_price": 10.0 + i,
        "horizon": 5, "state": 1, "signal_ev": 0.01, "target_exit_date": None, "exit_date": None, "exit_price": None, "net_return": None, "closed_reason": None,
    }


def test_versions_of_the_position_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert positions.load_positions(spark, path).count() == 0 and positions.versions(spark, path) == []
    assert positions.save_positions(positions.opened(positions.no_positions(spark), position(1)), path, 0) == 1
    held = positions.load_positions(spark, path)
    # Read and written at one path.
    assert positions.save_positions(positions.opened(held, position(2, "QQQ")), path, 1) == 2
    assert {r.position_id for r in positions.load_positions(spark, path).collect()} == {"SPY-1", "QQQ-2"}
    assert [r.position_id for r in positions.load_positions(spark, path, 1).collect()] == ["SPY-1"]
    with pytest.raises(positions.Conflict):
        positions.save_positions(held, path, 1)
    for n in range(3, 6):
        positions.save_positions(positions.load_positions(spark, path), path, n - 1)
    assert positions.versions(spark, path) == [3, 4, 5]
    assert len(list((tmp_path / "table").glob("snapshot-*"))) == 3 and positions.load_positions(spark, path).count() == 2


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    positions.save_positions(positions.opened(positions.no_positions(spark), position(1)), path)

    def dies(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(positions, "replace_file", dies)
        with pytest.raises(KeyboardInterrupt):
            positions.save_positions(positions.no_positions(spark), path)
    assert len(list((tmp_path / "table").glob("snapshot-*"))) == 2
    assert [r.position_id for r in positions.load_positions(spark, path).collect()] == ["SPY-1"]

    def beaten(spark, path, data, new=False):
        real(spark, path, json.dumps({"schema_version": 1, "snapshot": "other"}).encode(), new)
        real(spark, path, data, new)

    real = positions.replace_file
    monkeypatch.setattr(positions, "replace_file", beaten)
    with pytest.raises(positions.Conflict):
        positions.save_positions(positions.no_positions(spark), path, 1)
    assert storage.read_file(spark, f"{path}/log/00000002.json") == b'{"schema_version": 1, "snapshot": "other"}'


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/deep/run.json"
    assert store.load_json(path) is None
    store.save_json({"schema_version": 1, "n": float("nan")}, path)
    store.save_json({"schema_version": 1, "n": 2}, path)
    assert store.load_json(path, 1) == {"schema_version": 1, "n": 2} and [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["run.json"]
    with pytest.raises(ValueError):
        store.load_json(path, 2)
    with pytest.raises(FileExistsError):
        storage.replace_file(spark, path, b"{}", new=True)


def signals(spark, n=60, seed=4):
    import numpy as np

    r, rows = np.random.default_rng(seed), []
    for s in ("A", "B"):
        for i, d in enumerate(pd.date_range("2024-01-01", periods=n).date):
            ev = None if r.random() < 0.1 else float(r.normal(0.002, 0.01))
            rows.append((s, d, i, float(50 + r.random()), ev, int(r.integers(0, 5)), bool(ev is not None), bool(r.random() < 0.1), bool(r.random() < 0.9)))
    return spark.createDataFrame(rows, "symbol string, date date, pos int, close double, ev_after_cost double, state int, has_ev boolean, drift boolean, macro_ok boolean")


def test_days_add_up_to_the_batch(spark):
    df = signals(spark)
    batch = [tuple(r) for r in positions.paper_trade(df, 5, 0.0, 5.0).collect()]
    carried, made = positions.nothing_carried(spark), []
    cuts = ["2024-01-01", "2024-01-02", "2024-01-09", "2024-02-01", "2024-03-01"]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        day = df.where((F.col("date") >= a) & (F.col("date") < b)).drop("pos")
        decisions, carried = positions.daily_step(carried, day.where("symbol = 'A' OR date > '2024-01-01'"))
        made += [tuple(r) for r in decisions.collect()]
    # B begins a day later; its positions are numbered from there.
    late = positions.paper_trade(df.where("symbol = 'B' AND pos > 0").withColumn("pos", F.col("pos") - 1), 5, 0.0, 5.0).collect()
    want = [r for r in batch if r[0] == "A"] + [tuple(r) for r in late]
    end = {"A": 59, "B": 58}
    # A batch knows the end of its data, the days don't.
    known = lambda rows: sorted((r for r in rows if r[1] <= end[r[0]] - 5), key=str)
    assert known(made) == known(want) and {r[3] for r in known(made)} == {"open", "close", "skip_entry"}
    assert {r.symbol: r.pos for r in carried.collect()} == end
    # A day without bars changes nothing.
    none, again = positions.daily_step(carried, df.limit(0).drop("pos"))
    assert none.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, carried.collect()))


def test_a_stream_goes_on_from_a_carried_table(spark, tmp_path):
    df = signals(spark).withColumn("seq", F.col("pos"))
    early, late = df.where("pos < 23"), df.where("pos >= 23")
    first, carried = positions.daily_step(positions.nothing_carried(spark), early.drop("pos", "seq"))
    late.drop("pos").write.parquet(str(tmp_path / "late"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_STORE)
    try:
        stream = spark.readStream.schema(late.drop("pos").schema).parquet(str(tmp_path / "late"))
        rest = streams.drained(streams.streaming_positions(stream, carried=carried), "resumed").collect()
    finally:
        spark.conf.set(key, before)
    names = ("symbol", "pos", "action", "reason", "position_id", "price", "net_return")
    got = [tuple(r[c] for c in names) for r in rest]
    want = [tuple(r[c] for c in names) for r in positions.daily_step(carried, late.drop("pos", "seq"))[0].where("action <> 'skip_entry'").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 4
    assert first.count() > 0


def test_gates_of_a_stream(spark, tmp_path):
    df = signals(spark).withColumn("seq", F.col("pos")).drop("pos").withColumn("drift", F.lit(True))
    df.write.parquet(str(tmp_path / "bars"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_STORE)
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "bars"))
        assert streams.drained(streams.streaming_positions(stream), "gated").count() == 0
    finally:
        spark.conf.set(key, before)


def cells(spark, rows):
    return spark.createDataFrame([("A", *r) for r in rows], "symbol string, src int, dst int, p double")


def test_matrices_and_states_are_checked(spark):
    good = cells(spark, [(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.25), (1, 1, 0.75)])
    assert markov.check_matrix(good) is good
    got = {r.dst: r.p for r in markov.state_forecast(good, 0, 2).collect()}
    assert got == {0: 0.375, 1: 0.625}
    for rows in ([(0, 0, 1.0), (0, 1, 0.0)], [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 1.0), (1, 0, 0.0)], [(1, 1, 1.0)]):
        with pytest.raises(ValueError, match="square"):
            markov.check_matrix(cells(spark, rows))
    for p in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            markov.stationary(cells(spark, [(0, 0, p)]))
    for state in (-1, 2):
        with pytest.raises(ValueError, match="outside"):
            markov.state_forecast(good, state, 1)
    with pytest.raises(ValueError):
        markov.state_forecast(good, 0, 0)


RECORDS = "symbol string, pos int, base_state string, volatility_state string, macro_state string, calendar_state string, liquidity_state string"


def test_records_can_be_overridden(spark):
    df = spark.createDataFrame([("A", 0, "CHOP", "HIGH", "UP", "FOMC", None)], RECORDS)
    got = forecast.overridden(df, calendar_state=None, macro_state="DOWN", volatility_state=F.lower("volatility_state")).first()
    assert (got.base_state, got.volatility_state, got.macro_state, got.calendar_state) == ("CHOP", "high", "DOWN", None)
    assert df.first().calendar_state == "FOMC"
    with pytest.raises(ValueError, match="bogus"):
        forecast.overridden(df, bogus="x")


def test_diagnostics_write_five_tables(spark, tmp_path):
    rows = [(s, i, "CHOP" if i % 3 else "CALM", "HIGH" if i % 2 else "LOW", None, None, None) for s in "AB" for i in range(120)] + [("B", 120, "RARE", None, None, None, None)]
    history = spark.createDataFrame(rows, RECORDS)
    paths = forecast.diagnostics(history, history.where("pos >= 100"), str(tmp_path / "out"), top=2)
    assert sorted(paths) == ["confidence_distribution", "coverage_by_symbol", "fallback_usage", "forecast_warnings", "top_rare_states"]
    read = {name: spark.read.option("header", True).csv(path).toPandas() for name, path in paths.items()}
    assert read["coverage_by_symbol"]["n_forecasts"].tolist() == ["20", "21"] and read["confidence_distribution"]["confidence"].tolist() == ["high", "medium", "low"]
    assert read["top_rare_states"].values.tolist() == [["RARE|*|*|*|*", "1"], ["CALM|*|*|*|*", "80"]]
    assert read["fallback_usage"]["n"].astype(int).sum() == 41 and "fallback_used" in set(read["forecast_warnings"]["warning"])
