"""Hand-computed cases, no-lookahead checks and invariants."""

import datetime
import inspect
import os

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import backtest, changepoints, expectancy, forecast, indicators, markov, monitoring, paths, positions, regimes, states, statistics
from tidemark.plans import registry
from tidemark.sources import bars as sources
from tidemark.sources import connectors, store
from tidemark.sources.storage import replace_file

DAY = datetime.date(2024, 1, 1)


def series(spark, close, state=None, symbol="A", **more):
    rows = []
    for i, c in enumerate(close):
        row = {"symbol": symbol, "date": DAY + datetime.timedelta(days=i), "pos": i, "close": float(c), "state": None if state is None else state[i]}
        rows.append(row | {k: v[i] for k, v in more.items()})
    kinds = "".join(f", {k} {'boolean' if isinstance(v[0], bool) else 'double'}" for k, v in more.items())
    return spark.createDataFrame(rows, f"symbol string, date date, pos int, close double, state int{kinds}")


def full_bars(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = [("A", DAY + datetime.timedelta(days=i), i, c, c * 1.01, c * 0.99, c, 1000.0 + 7 * (i % 13)) for i, c in enumerate(close.tolist())]
    return spark.createDataFrame(rows, "symbol string, date date, pos int, open double, high double, low double, close double, volume double")


def test_indicators_against_pandas(spark):
    df = full_bars(spark)
    got = indicators.add_indicators(df).orderBy("pos").toPandas()
    c = got["close"]
    for name, want in {
        "sma_20": c.rolling(20).mean(),
        "sma_200": c.rolling(200).mean(),
        "ema_20": c.ewm(span=20, adjust=False, min_periods=20).mean(),
        "return_5d": c.pct_change(5),
        "realized_vol_20": c.pct_change().rolling(20).std() * 252**0.5,
        "bb_width_20": 4 * c.rolling(20).std() / c.rolling(20).mean(),
        "volume_zscore_20": (got["volume"] - got["volume"].rolling(20).mean()) / got["volume"].rolling(20).std(),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-12, err_msg=name)
    with pytest.raises(ValueError):
        indicators.add_indicators(df.drop("close"))


def test_ema_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(indicators, "EMA_BLOCK", 450)
    df = full_bars(spark, 1400)
    got = indicators.with_ema(df, 20, "e").orderBy("pos").toPandas()
    np.testing.assert_allclose(got["e"].astype(float), got["close"].ewm(span=20, adjust=False, min_periods=20).mean(), rtol=1e-10)


def test_flat_prices_have_rsi_zero(spark):
    df = full_bars(spark, 30).withColumns({c: F.lit(10.0) for c in ("open", "high", "low", "close")})
    got = indicators.add_indicators(df).orderBy("pos").collect()
    assert got[20]["rsi_14"] == 0.0 and got[13]["rsi_14"] is None and got[20]["volume_zscore_20"] is not None


@pytest.mark.parametrize("changed", ["high", "low", "close", "volume"])
def test_no_lookahead(spark, changed):
    df = full_bars(spark, 260)
    later = df.withColumn(changed, F.when(F.col("pos") >= 240, F.col(changed) * 3).otherwise(F.col(changed)))
    columns = ["pos", "sma_20", "atr_14", "rsi_14", "nearest_support", "nearest_resistance", "state", "ema_20"]
    one, two = (states.enrich(x).where("pos < 240").select(*columns).orderBy("pos").collect() for x in (df, later))
    assert one == two


def test_walkforward_uses_known_returns_only(spark):
    n = 120
    close = (100 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.02, n)))).tolist()
    st_ = [i % 3 for i in range(n)]
    one = expectancy.walkforward(series(spark, close, st_), 5, 40, 2).where("pos <= 80").orderBy("pos").select("pos", "ev_after_cost").collect()
    close[81:] = [x * 2 for x in close[81:]]
    two = expectancy.walkforward(series(spark, close, st_), 5, 40, 2).where("pos <= 80").orderBy("pos").select("pos", "ev_after_cost").collect()
    assert one == two


def test_levels(spark):
    rows = [("A", i, h, l, l + 0.5, 2.0) for i, (h, l) in enumerate([(11, 9), (12, 10), (15, 11), (14, 12)])]
    df = spark.createDataFrame([(s, p, float(h), float(l), c, a) for s, p, h, l, c, a in rows], "symbol string, pos int, high double, low double, close double, atr_14 double")
    got = states.detect_levels(df, 3, 0.5).orderBy("pos").collect()
    assert (got[3].nearest_resistance, got[3].nearest_support) == (15, 9)
    assert (got[3].resistance_zone_low, got[3].resistance_zone_high, got[3].support_zone_low, got[3].support_zone_high) == (14, 16, 8, 10)
    assert got[2].nearest_support is None
    with pytest.raises(ValueError):
        states.detect_levels(df, 0)


def test_expectancy_by_hand(spark):
    df = series(spark, [100, 110, 105, 120], [1, 2, 1, 2])
    got = {r.state: r for r in expectancy.expectancy(df, ["symbol", "state"], (1,), 10).collect()}
    assert got[1].n == 2 and got[1].win_rate == 1.0
    mean = (0.1 + 120 / 105 - 1) / 2
    assert abs(got[1].ev_after_cost - (mean - 0.001)) < 1e-12
    assert got[2].n == 1 and got[2].avg_win is None and got[2].ci_low is None
    assert expectancy.expectancy(series(spark, [100, 105, 110], [1, 1, 1]), ["state"], (2,)).first().n == 1


def test_walkforward_by_hand(spark):
    df = series(spark, [100, 110, 121, 100, 90], [1] * 5)
    got = expectancy.walkforward(df, 1, 2, 2, 0).orderBy("pos").collect()
    assert got[0].pos == 3 and got[0].train_count == 2 and abs(got[0].ev_after_cost - 0.1) < 1e-12


def test_markov_value_by_hand_and_blocks(spark):
    df = series(spark, [100, 110, 121, 133.1, 146.41], [0, 1, 1, 1, 1])
    got = {r.pos: r for r in markov.walkforward_markov_value(df, 1, 3, 2, 0).collect()}
    assert got[4].state == 1 and abs(got[4].coverage - 1) < 1e-12 and abs(got[4].markov_ev - 0.1) < 1e-12
    n = 400
    rng = np.random.default_rng(2)
    long = series(spark, (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))).tolist(), rng.integers(0, 5, n).tolist())
    for f in (markov.walkforward_markov_value, lambda d, **k: markov.walkforward_forecasts(d, 60, (1, 3), **k)):
        one, two = (sorted(map(str, f(long, block=b).collect())) for b in (10_000, 90))
        assert one == two


def test_forecasts_of_several_steps(spark):
    rng = np.random.default_rng(12)
    found = rng.integers(0, 4, 90).tolist()
    rows = markov.walkforward_forecasts(series(spark, [1.0] * 90, found), 60).collect()
    got = {(r.pos, r.horizon, r.dst): r.p for r in rows}
    assert {r.horizon for r in rows} == {1, 5, 10, 20} and {r.pos for r in rows} == set(range(60, 90))
    for pos in range(60, 90):
        counts = np.zeros((4, 4))
        for a, b in zip(found[pos - 60 : pos - 1], found[pos - 59 : pos], strict=True):
            counts[a, b] += 1
        for h in (1, 5, 10, 20):
            want = np.linalg.matrix_power(counts / counts.sum(axis=1, keepdims=True), h)[found[pos]]
            assert [got.get((pos, h, d), 0.0) for d in range(4)] == pytest.approx(want.tolist(), abs=1e-12)


def test_several_steps_are_registered(spark, sf):
    one, all_ = (registry.QUERIES[q](spark, sf).toPandas() for q in ("walkforward_forecasts", "walkforward_forecasts_steps"))
    assert set(all_["horizon"]) == {1, 5, 10, 20}
    assert sorted(map(tuple, all_[all_["horizon"] == 1].values)) == sorted(map(tuple, one.values))


def test_backtest_costs(spark):
    df = series(spark, [100, 100, 110, 110], [1, 0, 0, 0])
    table = spark.createDataFrame([("A", 1, 1.0)], "symbol string, state int, ev_after_cost double")
    made, equity, stats = backtest.table_backtest(df, table, 1, 0.0, 100)
    t = made.first()
    assert (t.signal_pos, t.exit_pos) == (0, 2) and abs(t.gross_return - 0.10) < 1e-12 and abs(t.net_return - 0.09) < 1e-12
    s = stats.first()
    assert abs(s.total_return - 0.09) < 1e-12 and s.trade_count == 1 and abs(s.exposure_time - 0.25) < 1e-12


def test_baselines_by_hand(spark):
    got = backtest.ma_crossover(series(spark, [100, 100, 110, 121]), 1, 2).first()
    assert abs(got.total_return - 0.10) < 1e-12 and got.exposure_time == 0.25
    got = backtest.breakout(series(spark, [100, 101, 105, 106, 112]), 2, 1, 0).first()
    assert got.trade_count == 1 and abs(got.total_return - (112 / 106 - 1)) < 1e-12
    assert backtest.buy_and_hold(series(spark, [100])).first().total_return == 0.0


def test_trades_do_not_overlap(spark, sf):
    made = backtest.walkforward_backtest(registry.labelled(spark, sf), threshold=-1.0)[0].orderBy("symbol", "signal_pos").collect()
    for a, b in zip(made, made[1:], strict=False):
        assert a.symbol != b.symbol or b.signal_pos > a.exit_pos


def test_grid_equals_single_runs(spark, sf):
    df = registry.labelled(spark, sf)
    grid = backtest.sensitivity_grid(df, (5,), (126,), (5.0, 10.0), (5, 10)).collect()
    own = {r.symbol: r for r in backtest.walkforward_backtest(df, 5, 126, 10, 10.0)[2].collect()}
    for r in grid:
        if r.cost_bps == 10.0 and r.min_samples == 10:
            assert abs(r.total_return - own[r.symbol].total_return) < 1e-9 and r.trade_count == own[r.symbol].trade_count


def matrix_of(spark, values, n, **options):
    df = series(spark, [1.0] * len(values), values)
    got = markov.matrix(markov.transitions(df), n_states=n, **options).collect()
    out = np.zeros((n, n))
    for r in got:
        out[r.src, r.dst] = r.p
    return out


def test_transition_matrix_by_hand(spark):
    np.testing.assert_allclose(matrix_of(spark, [0, 1, 1, 2, 0, 1], 3)[:2], [[0, 1, 0], [0, 0.5, 0.5]])
    np.testing.assert_allclose(matrix_of(spark, [0, 1, 0], 3)[2], [0, 0, 1])
    np.testing.assert_allclose(matrix_of(spark, [0, 1, 0], 3, alpha=1.0)[2], [1 / 3] * 3)
    np.testing.assert_allclose(matrix_of(spark, [0, 1, 0], 3, empty_row="zero")[2], [0, 0, 0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=60), st.integers(1, 6), st.integers(0, 3))
def test_row_forecasts_are_distributions(values, steps, start):
    counts = np.zeros((4, 4))
    np.add.at(counts, (values[:-1], values[1:]), 1)
    p = markov.counts_to_matrix(counts)
    v = markov.row_forecast(p, start, steps)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    np.testing.assert_allclose(v, np.linalg.matrix_power(p, steps)[start], atol=1e-9)


def test_stationary_is_a_fixed_point(spark, sf):
    p = markov.matrix(markov.transitions(registry.labelled(spark, sf)), alpha=0.1)
    cells, found = p.toPandas(), markov.stationary(p).toPandas()
    for symbol, own in found.groupby("symbol"):
        m = cells[cells.symbol == symbol].pivot(index="src", columns="dst", values="p").to_numpy()
        v = own.sort_values("dst")["p"].to_numpy()
        np.testing.assert_allclose(v @ m, v, atol=1e-9)


def test_fallback_thresholds(spark):
    def records(n, vol, start):
        return [("A", start + i, "S", vol, None, None, None) for i in range(n)]

    kinds = "symbol string, pos int, base_state string, volatility_state string, macro_state string, calendar_state string, liquidity_state string"
    for n, level in ((50, 4), (49, 3), (30, 3), (29, 0)):
        history = spark.createDataFrame(records(n, "X", 0) + records(60, "Y", 1000), kinds)
        asked = spark.createDataFrame(records(1, "X", 0), kinds)
        got = forecast.conditional_forecast(history, asked).first()
        assert got.fallback_level == level, n
    nothing = forecast.conditional_forecast(history, spark.createDataFrame([("A", 1, "NEW", None, None, None, None)], kinds)).first()
    assert nothing.next_probs == {} and nothing.warnings == ["fallback_used", "low_sample", "no_transitions"] and nothing.confidence == "low"


def test_overlays(spark):
    df = spark.createDataFrame([("high", ["a"], {"x": 0.4}, s, r) for s, r in (("CALM", 0.1), ("STRESS", 0.8), ("PANIC", 0.95))], "confidence string, warnings array<string>, next_probs map<string,double>, stress string, risk double")
    got = forecast.with_tail_risk(forecast.with_stress(df, "stress"), "risk").collect()
    assert [r.confidence for r in got] == ["high", "low", "low"]
    assert got[2].next_probs == {"x": 0.0} and got[0].next_probs == {"x": 0.4} and got[0].warnings == ["a", "cross_asset_calm"]


def test_regime_tables(spark):
    row = spark.range(1)
    z, v, g = F.lit(None).cast("double"), F.lit(0.061), F.lit(None).cast("double")
    assert row.select(regimes.liquidity_state(z, v, g)).first()[0] == "PANIC_LIQUIDITY"
    assert row.select(regimes.liquidity_state(F.lit(-1.1), z, g)).first()[0] == "THIN_LIQUIDITY"
    assert row.select(regimes.liquidity_state(F.lit(2.5), F.lit(0.02), F.lit(0.03))).first()[0] == "NORMAL_LIQUIDITY"
    assert row.select(regimes.cross_asset_stress(F.lit(28.0), z, F.lit(-2.5))).first()[0] == "STRESS"
    assert row.select(regimes.position_size(F.lit(1e5), F.lit(0.01), F.lit(2.0), F.lit(2.0))).first()[0] == 250.0
    assert {datetime.date(2024, 3, 29), datetime.date(2000, 4, 21), datetime.date(1961, 3, 31), datetime.date(2060, 4, 16)} <= set(regimes.holidays(1960, 2060))
    days = {"2024-01-30": "FOMC_WINDOW", "2024-02-12": "CPI_WINDOW", "2024-03-15": "OPEX_WEEK", "2024-08-30": "MONTH_END", "2024-07-05": "HOLIDAY_LIQUIDITY", "2024-07-04": "NONE", "2024-06-29": "NONE"}
    df = spark.createDataFrame([(k,) for k in days], "d string").withColumn("day", F.to_date("d"))
    df = regimes.with_calendar_state(df, "day", "c")
    assert {r.d: r.c for r in df.collect()} == days
    far = spark.createDataFrame([("2060-04-15",), ("1961-03-30",), (None,)], "d string").select(F.to_date("d").alias("d"))
    got = {str(r.d): r.calendar_state for r in regimes.with_calendar_state(far, "d").collect()}
    assert got["1961-03-30"] == "MONTH_END" and got["2060-04-15"] == "OPEX_WEEK"
    july = regimes.with_calendar_state(spark.createDataFrame([("2059-07-03",), ("1955-07-05",)], "d string").select(F.to_date("d").alias("d")), "d")
    assert {r.calendar_state for r in july.collect()} == {"HOLIDAY_LIQUIDITY"}
    costs = row.select(*[regimes.cost_bps(F.lit(x)) for x in ("NORMAL_LIQUIDITY", "THIN_LIQUIDITY", "STRESSED_LIQUIDITY", "PANIC_LIQUIDITY", "OTHER")]).first()
    assert tuple(costs) == (5.0, 12.0, 30.0, 80.0, 5.0)
    with pytest.raises(ValueError):
        regimes.regime_allowed(F.lit(1), [])


def test_volatility_state_by_hand(spark):
    df = series(spark, [1.0] * 6, realized_vol_20=[0.10, 0.11, 0.12, 0.13, 0.30, 0.08])
    got = [r.vol_state for r in regimes.volatility_state(df, 3, 21).orderBy("pos").collect()]
    assert got[4] == 2 and got[5] == 0 and got[0] == 1


def test_distribution_and_drift(spark):
    got = monitoring.state_distribution(series(spark, [1.0] * 4, [-1, 0, 1, 5]), ["symbol"], 3, 0.0).orderBy("state").collect()
    assert [r.p for r in got] == [0.5, 0.5, 0.0]
    short = monitoring.drift_monitor(series(spark, [1.0] * 10, [1] * 10)).first()
    assert short.status == "insufficient_history" and short.kl is None and not short.alert


def test_path_features_by_hand(spark):
    got = paths.path_features(series(spark, [100, 101, 102, 105, 106, 107], [0, 0, 0, 1, 1, 1]), velocity=3).orderBy("pos").collect()
    assert [r.state_age for r in got] == [1, 2, 3, 1, 2, 3] and abs(got[3].entry_velocity - 0.05) < 1e-12
    assert got[2].prior_path is None and got[3].prior_path == "0>0>0"


def test_clusters_are_not_ntiles(spark):
    rows = spark.createDataFrame([(f"s{i}", float(i), 0.5) for i in range(7)], "symbol string, realized_volatility double, reversal_frequency double")
    got = [r.cluster for r in paths.cluster_assets(rows, 5).orderBy("realized_volatility").collect()]
    assert [got.count(k) for k in range(5)] == [2, 1, 2, 1, 1]


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    df = series(spark, [1.0] * 200, r=rng.normal(0.01, 0.02, 200).tolist())
    one, two = (statistics.bootstrap(df, "r", n=400, seed=s).first() for s in (1, 1))
    assert one == two and one.low < one.estimate < one.high and one.n == 200
    assert statistics.bootstrap(df.withColumn("r", F.lit(None).cast("double")), "r").first().estimate is None
    with pytest.raises(ValueError):
        statistics.bootstrap(df, "r", statistic="mode")


def test_bootstrap_mean_draws_all_resamples(spark, sf, monkeypatch):
    drawn, real = [], statistics.bootstrap
    monkeypatch.setattr(statistics, "bootstrap", lambda df, value, **more: drawn.append(more.get("n", inspect.signature(real).parameters["n"].default)) or real(df, value, **more))
    registry.QUERIES["bootstrap_mean"](spark, sf)
    assert drawn == [2000]


def test_hidden_regimes_find_planted_ones():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (80, 2)) for m in (-2, 2, -2, 2)])
    path, _ = statistics.fit_hmm(x, 2, starts=3, rounds=40)
    truth = np.repeat([0, 1, 0, 1], 80)
    assert max((path == truth).mean(), (path != truth).mean()) > 0.98


def test_hidden_regimes_take_the_best_of_converged_starts(spark, sf, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(m, s, (60, 2)) for m, s in ((0, 1), (0.5, 0.4), (-0.4, 2), (0.5, 0.4), (0, 1))])
    each = [statistics.fit_hmm(x, 3, starts=1, seed=7 + s)[1] for s in range(10)]
    best = statistics.fit_hmm(x, 3)[1]
    assert abs(best - max(each)) < 1e-6 and best >= statistics.fit_hmm(x, 3, rounds=15)[1]
    more = statistics.fit_hmm(x, 3, rounds=201)[1]
    assert abs(more - best) < 2e-2
    assert inspect.signature(statistics.hidden_regimes).parameters["starts"].default == 10
    assert inspect.signature(statistics.hidden_regimes).parameters["rounds"].default == 200
    used = []
    real = statistics.hidden_regimes
    monkeypatch.setattr(statistics, "hidden_regimes", lambda df, columns, **more: used.append(more) or real(df.limit(0), columns))
    registry.QUERIES["hidden_regimes"](spark, sf)
    assert used == [{}]


def test_change_points_find_planted_ones():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, s, 120) for s in (0.005, 0.04, 0.005)]) + np.repeat([0, 0.05, 0], 120)
    found = changepoints.change_points(x)
    assert len(found) == 2 and abs(found[0] - 120) <= 5 and abs(found[1] - 240) <= 5
    assert changepoints.change_points(x[:30]) == []


def test_change_points_span_the_whole_series(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(m, 0.01, n) for m, n in ((0, 300), (0.06, 310), (0, 590), (0.06, 290), (0, 20), (0.06, 490))])
    assert changepoints.median_square(x[:301]) == pytest.approx(np.median(((x[:301, None] - x[None, :301]) ** 2)[np.triu_indices(301, 1)]), rel=1e-12)
    want = dense_change_points(x, 20, 3.0, 5)
    assert [300, 610, 1200, 1490, 1510] == want == changepoints.change_points(x)
    df = series(spark, [1.0] * len(x), return_1d=x.tolist())
    got = changepoints.annotate_change_points(df).where("is_changepoint").select("pos").collect()
    assert sorted(r.pos for r in got) == want


def dense_change_points(x, min_size, penalty, jump):
    """The optimal segmentation from the full kernel table, nothing pruned."""
    n, squares = len(x), (x[:, None] - x[None, :]) ** 2
    table = np.exp(-np.clip(squares / (np.median(squares[np.triu_indices(n, 1)]) or 1.0), 1e-2, 1e2))
    np.fill_diagonal(table, 1.0)
    sums = np.zeros((n + 1, n + 1))
    sums[1:, 1:] = table.cumsum(axis=0).cumsum(axis=1)
    best, last = {0: -penalty}, {}
    for b in [*range(jump, n, jump), n]:
        cost = {a: v + penalty + (b - a) - (sums[b, b] - sums[a, b] - sums[b, a] + sums[a, a]) / (b - a) for a, v in best.items() if a <= b - min_size}
        if cost:
            last[b] = min(cost, key=cost.get)
            best[b] = cost[last[b]]
    found, b = [], n
    while last[b]:
        found.insert(0, b := last[b])
    return found


def uneven(rng, n, pieces):
    cuts = np.sort(rng.integers(0, n, pieces - 1))
    return np.concatenate([rng.normal(rng.normal(0, 0.01), rng.choice([0.004, 0.01, 0.03]), len(c)) for c in np.split(np.zeros(n), cuts)])


@pytest.mark.parametrize("min_size,penalty,jump", [(20, 3.0, 5), (7, 0.6, 1), (3, 1.0, 5), (30, 0.2, 4)])
def test_change_points_are_optimal(min_size, penalty, jump):
    rng = np.random.default_rng(min_size)
    for n in (2 * min_size, 97, 333, 600):
        x = uneven(rng, n, 6)
        assert changepoints.change_points(x, min_size, penalty, jump) == dense_change_points(x, min_size, penalty, jump)
    assert changepoints.change_points(np.zeros(200), min_size, penalty, jump) == []
    with pytest.raises(ValueError):
        changepoints.change_points(x, 0)
    with pytest.raises(ValueError):
        changepoints.change_points(x, 20, 0)


@pytest.mark.parametrize("min_size,penalty,jump,block", [(20, 3.0, 5, 60), (7, 0.6, 1, 50), (11, 0.2, 4, 200)])
def test_change_points_by_blocks(spark, min_size, penalty, jump, block):
    rng, want, rows = np.random.default_rng(block), set(), []
    for name, n, pieces in (("long", 461, 7), ("even", 240, 1), ("short", 70, 2), ("tiny", 2 * min_size - 1, 1), ("flat", 150, 0)):
        x = uneven(rng, n, pieces) if pieces else np.zeros(n)
        want |= {(name, 2 * b) for b in (dense_change_points(x, min_size, penalty, jump) if n >= 2 * min_size else [])}
        # Unknown values lie between the known ones.
        rows += [(name, p, float(x[p // 2]) if p % 2 == 0 else (None, float("nan"))[p % 4 // 2]) for p in range(2 * n)]
    df = spark.createDataFrame(rows, "symbol string, pos int, return_1d double").repartition(3)
    got = changepoints.annotate_change_points(df, "return_1d", min_size, penalty, jump, whole=100, block=block).collect()
    assert {(r.symbol, r.pos) for r in got if r.is_changepoint} == want and len({s for s, _ in want}) >= 1
    assert len(got) == len(rows) // 2
    none = changepoints.annotate_change_points(df.where("false"), whole=100, block=block)
    assert none.count() == 0 and none.columns == ["symbol", "pos", "is_changepoint"]


def test_paper_trading_order(spark):
    n = 12
    df = series(spark, [100.0 + i for i in range(n)], ev_after_cost=[0.01] * n, drift=[i == 1 for i in range(n)], macro_ok=[i != 2 for i in range(n)])
    got = positions.paper_trade(df, 3).orderBy("pos", F.col("action").desc()).collect()
    first = [(r.pos, r.action, r.reason) for r in got if r.pos <= 4]
    assert first == [
        (0, "skip_entry", "no_yesterday_bar"), (1, "skip_entry", "drift_alert"), (2, "skip_entry", "macro_filter"), (3, "open", None), (4, "skip_entry", "already_open"),
    ]
    closed = [r for r in got if r.action == "close"]
    assert closed[0].pos == 6 and abs(closed[0].net_return - (106 / 103 - 1 - 0.0005)) < 1e-12
    assert [(r.pos, r.reason) for r in got if r.pos >= 9 and r.action == "skip_entry"] == [(9, "horizon_past_data"), (10, "horizon_past_data"), (11, "horizon_past_data")]
    table = positions.positions_from(positions.paper_trade(df, 3), df, 3)
    assert [f.name for f in table.schema] == [c.split()[0] for c in positions.POSITIONS.split(", ")]
    one = table.orderBy("entry_date").first()
    assert (one.signal_date, one.entry_date, one.target_exit_date, one.exit_date, one.closed_reason) == (*(DAY + datetime.timedelta(days=d) for d in (2, 3, 6, 6)), "horizon_reached")
    assert table.where("exit_date IS NULL").count() == 0
    weak = series(spark, [100.0] * 4, ev_after_cost=[0.01, -0.01, None, 0.01], has_ev=[False, True, True, True])
    reasons = [r.reason for r in positions.paper_trade(weak, 1).orderBy("pos").collect()]
    assert reasons == ["no_yesterday_bar", "no_ev_for_signal_date", "ev_below_threshold", "ev_below_threshold"]


def test_position_table(spark, tmp_path):
    day = datetime.date(2024, 5, 1)
    position = {
        "position_id": "a", "symbol": "SPY", "signal_date": day, "entry_date": day, "entry_price": 100.0, "horizon": 5, "state": 1, "signal_ev": 0.01,
        "target_exit_date": day, "exit_date": None, "exit_price": None, "net_return": None, "closed_reason": None,
    }
    table = positions.opened(positions.no_positions(spark), position)
    assert positions.has_open_position(table, "SPY") and not positions.has_open_position(table, "QQQ")
    with pytest.raises(ValueError):
        positions.opened(table, position)
    with pytest.raises(ValueError):
        positions.opened(table, position | {"position_id": "b"})
    with pytest.raises(KeyError):
        positions.closed(table, "none", day, 110.0, "manual")
    done = positions.closed(table, "a", day, 110.0, "manual", 10.0)
    assert positions.closed_positions(done).count() == 1 and abs(done.first().net_return - 0.099) < 1e-12
    with pytest.raises(ValueError):
        positions.closed(done, "a", day, 110.0, "manual")
    marks = positions.mark_to_market(table, spark.createDataFrame([("SPY", 105.0)], "symbol string, price double"))
    assert [(r.position_id, round(r.unrealized, 9)) for r in marks.collect()] == [("a", 0.05)]
    path = str(tmp_path / "positions")
    assert positions.load_positions(spark, path).count() == 0
    positions.save_positions(done, path)
    assert positions.load_positions(spark, path).collect() == done.collect()
    replace_file(spark, f"{path}/log/00000002.json", b'{"schema_version": 2, "snapshot": "x"}', new=True)
    with pytest.raises(ValueError):
        positions.load_positions(spark, path)


def test_equity_after_a_total_loss(spark):
    df = series(spark, [1.0] * 6)
    made = spark.createDataFrame([("A", 1, 0.1), ("A", 3, -1.0), ("A", 4, 0.5)], "symbol string, exit_pos int, net_return double")
    assert [round(r.equity, 9) for r in backtest.equity_curve(df, made).orderBy("pos").collect()] == [1, 1.1, 1.1, 0, 0, 0]
    made = spark.createDataFrame([("A", 1, 0.1), ("A", 3, -1.0005)], "symbol string, exit_pos int, net_return double")
    assert abs(backtest.equity_curve(df, made).orderBy(F.col("pos").desc()).first().equity + 1.1 * 0.0005) < 1e-12


def test_rolling_windows_count_bars_without_a_state(spark):
    """Against windows cut bar by bar, with unknown states inside."""
    rng = np.random.default_rng(7)
    states_ = [None if rng.random() < 0.3 else int(rng.integers(0, 3)) for _ in range(60)]
    df = series(spark, [1.0] * 60, states_)
    got = {(r.anchor, r.src, r.dst): r.n for r in markov.rolling_matrices(df, 12, 5, 3).collect()}
    want = {}
    for anchor in range(11, 60, 5):
        own = [s for s in states_[anchor - 11 : anchor + 1] if s is not None]
        for a, b in zip(own, own[1:], strict=False):
            want[anchor, a, b] = want.get((anchor, a, b), 0) + 1
    assert got == want


def test_regimes_by_label(spark):
    df = spark.createDataFrame([("A", 0, 0), ("A", 1, 1), ("A", 2, None), ("A", 3, 7)], "symbol string, pos int, regime int")
    labels = spark.createDataFrame([("A", 0, "RISK_ON_TREND"), ("A", 1, "RISK_OFF_QUIET")], "symbol string, regime int, label string")
    got = {r.pos: r.allowed for r in regimes.regime_signal(df, labels, ["RISK_ON_TREND"]).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
    with pytest.raises(ValueError):
        regimes.regime_signal(df, labels, [])
    assert statistics.emissions(df.withColumn("atr_14", F.lit(1.0))) == ["atr_14"]
    with pytest.raises(ValueError):
        statistics.emissions(df)


def test_connectors(tmp_path):
    asked = []
    fetch = connectors.fmp_fetch("secret", transport=lambda url: asked.append(url) or {"historical": []})
    assert fetch("SPY", "2024-01-01", "2024-02-01") == {"historical": []}
    assert asked[0].endswith("historical-price-eod/full?symbol=SPY&from=2024-01-01&to=2024-02-01&apikey=secret")
    with pytest.raises(OSError) as e:
        connectors.get_json("http://127.0.0.1:9/?apikey=secret")
    assert "secret" not in str(e.value)
    env = tmp_path / ".env"
    env.write_text("# note\nexport=1\nFINANCIAL_MODELING_PREP_API_KEY = 'two'\n")
    assert connectors.api_key(environ={"FMP_API_KEY": " one "}, path=env) == "one" and connectors.api_key(environ={}, path=env) == "two"
    with pytest.raises(connectors.ConnectorError):
        connectors.api_key(environ={}, path=tmp_path / "none")
    days = pd.to_datetime(["2024-01-02", "2024-01-03"])
    flat = pd.DataFrame({"Open": [1.0, 2], "High": [2.0, 3], "Low": [1.0, 2], "Close": [1.5, np.nan], "Volume": [5, 6]}, index=days)
    for names in ([(c, "SPY") for c in flat.columns], [("SPY", c) for c in flat.columns], [(c, "X") for c in flat.columns]):
        two = flat.set_axis(pd.MultiIndex.from_tuples(names), axis=1)
        got = connectors.yahoo("SPY", "a", "b", fetch=lambda *a, **k: two)  # noqa: B023
        assert [r["date"] for r in got] == ["2024-01-02", "2024-01-03"] and got[0]["close"] == 1.5 and got[1]["close"] is None
    many = pd.concat([flat, flat], axis=1).set_axis(pd.MultiIndex.from_product([["A", "B"], flat.columns]), axis=1)
    with pytest.raises(ValueError):
        connectors.one_symbol(many, "SPY")


def test_finding_tables(spark, tmp_path):
    df = full_bars(spark, 30).withColumn("symbol", F.lit("SPY"))
    store.save_bars(df, str(tmp_path / "bars"), "fmp")
    assert store.load_first(spark, str(tmp_path / "bars"), "spy", "fmp").count() == 30
    with pytest.raises(FileNotFoundError, match="provider=yfinance/symbol=SPY"):
        store.load_first(spark, str(tmp_path / "bars"), "SPY", "yfinance")
    df.write.partitionBy("symbol").parquet(str(tmp_path / "old"))
    assert store.load_first(spark, str(tmp_path / "old"), "SPY", "fmp").count() == 30 and store.symbols_in(spark, str(tmp_path / "old")) == ["SPY"]
    assert store.chosen_symbols(["X"]) == ["X"] and len(store.chosen_symbols()) == 9 and len(store.chosen_symbols(everything=True)) == 15
    for name, age in (("c_1.csv", 100), ("c_2.csv", 50), ("c_3.csv", 90)):
        (tmp_path / name).write_text("a\n1\n")
        os.utime(tmp_path / name, (1e9 - age, 1e9 - age))
    assert store.newest(spark, str(tmp_path / "c_*.csv")).endswith("c_2.csv")
    with pytest.raises(FileNotFoundError):
        store.newest(spark, str(tmp_path / "nothing*"))
    store.save_raw(df, str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "symbol=SPY").is_dir()


def test_reports_and_views(spark, tmp_path):
    path = store.experiment_report("My_run 1!", {"Results": "good"}, str(tmp_path), "2024-05-01")
    text = open(path, encoding="utf-8").read()
    assert path.endswith("my_run-1.md") and text.startswith("# Experiment Report: My_run 1!\n\n**Date:** 2024-05-01")
    assert text.count("## ") == 12 and "## Results\n\ngood" in text and text.count(store.NOT_EVALUATED) == 11
    with pytest.raises(ValueError):
        store.experiment_report("x", {"Other": ""}, str(tmp_path), "2024-05-01")
    assert store.ingestion_view(None, spark) == "No ingestion status captured yet."
    assert "missing provider" in store.ingestion_view({"symbols": []}, spark)
    run = {"provider": "p", "start": "a", "end": "b", "status": "partial", "started_at": "t"}
    view = store.ingestion_view(run | {"symbols": [{"symbol": "A", "status": "success", "rows": 3, "total_missing": 2}, {"symbol": "B", "status": "failed", "error": "no"}]}, spark)
    assert [(r.symbol, r.first_date, r.missing_count, r.error) for r in view.collect()] == [("A", "n/a", 2, ""), ("B", "n/a", 0, "no")]
    page = store.dashboard({"Runs": view, "Note": "nothing <yet>"}, charts={"Runs": ("symbol", "missing_count")})
    assert "<svg" in page and "nothing &lt;yet&gt;" in page
    assert store.bars_chart([("a", float("nan")), ("b", None)], "t") == "<p>No chart rows available.</p>"
    assert store.bars_chart([(f"s{i}", i - 3.0) for i in range(20)], "t").count("<rect") == 12


def test_stream_equals_batch(spark, sf):
    batch = positions.paper_trade(registry.signal_bars(spark, sf)).where("action <> 'skip_entry'")
    stream = registry.QUERIES["streaming_positions"](spark, sf)
    # The stream can't know where the data ends: it may open where a batch run stops.
    ends = registry.signal_bars(spark, sf).groupBy("symbol").agg(F.max("pos").alias("last"))
    stream = stream.join(ends, "symbol").where("action = 'close' OR pos + 5 <= last")
    key = ["symbol", "pos", "action"]
    assert sorted(map(tuple, batch.select(*key).collect())) == sorted(map(tuple, stream.select(*key).collect()))


def test_cleaning_and_stores(spark, tmp_path):
    def rows(symbol, start, end):
        if symbol == "BAD":
            raise RuntimeError("no such symbol")
        return {"historical": [
            {"Date": "2024-01-03", "Open": 1, "High": 2, "Low": 1, "Close": 1.5, "Volume": 10},
            {"Date": "2024-01-02", "Open": 1, "High": 2, "Low": 1, "Close": "x", "Volume": 10},
            {"Date": "2024-01-04", "Open": 1, "High": 2, "Low": 1, "Close": 1.5, "Volume": 10},
            {"Date": "2024-01-04", "Open": 1, "High": 2, "Low": 1, "Close": 1.7, "Volume": 10},
        ]}

    store.provider("fake")(rows)
    run = store.ingest(spark, [" abc", "BAD"], "2024-01-01", "2024-02-01", "fake", str(tmp_path / "bars"))
    assert run["status"] == "partial" and [s["rows"] for s in run["symbols"]] == [2, 0]
    got = store.load_bars(spark, str(tmp_path / "bars"), "abc", "fake").orderBy("pos").collect()
    assert [(str(r.date), r.close, r.pos) for r in got] == [("2024-01-03", 1.5, 0), ("2024-01-04", 1.7, 1)]
    with pytest.raises(ValueError):
        store.download(spark, "abc", "", "", "unknown")
    store.save_json({"schema_version": 1, "x": float("nan")}, str(tmp_path / "a" / "run.json"))
    assert store.load_json(str(tmp_path / "a" / "run.json"), 1)["x"] is None and store.load_json(str(tmp_path / "none.json")) is None
    with pytest.raises(ValueError):
        store.load_json(str(tmp_path / "a" / "run.json"), 2)
    df = spark.createDataFrame([("A", 1, "open", ["w"])], "symbol string, pos int, action string, warnings array<string>")
    for _ in range(2):
        store.append_decisions(df, str(tmp_path / "decisions"))
    assert spark.read.parquet(str(tmp_path / "decisions")).count() == 1
    store.save_csv(df, str(tmp_path / "csv"), single=True)
    assert store.read_csv(spark, str(tmp_path / "csv"), "symbol string, pos int, action string, warnings string").first().warnings == '["w"]'
    assert store.read_csv(spark, str(tmp_path / "no"), "a int", required=False).count() == 0
    assert store.slug("A  Big-Title!") == "a-big-title" and store.slug("state_ev run") == "state_ev-run" and "Not available" in store.markdown("T", {"S": ""})
    assert "<td>open</td>" in store.dashboard({"d": df})
    with pytest.raises(ValueError):
        store.slug("!!")
    with pytest.raises(ValueError):
        sources.clean_bars(df)
