"""Operators that cut long groups into blocks, against the same work done in one piece."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.operators import backtest, hidden, markov, monitoring, paths, statistics
from tidemark.sources.bars import with_pos

BARS = "symbol string, date date, pos int, close double, state int"


def table(spark, n=200, seed=3, symbols=("A", "B"), holes=0.1, n_states=4):
    r, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(0.02 * r.normal(size=n)))
        run = np.repeat(r.integers(0, n_states, n), r.integers(1, 6, n))[:n]
        days = pd.date_range("2015-01-01", periods=n, freq="3D").date
        rows += [(s, d, i, float(c), None if r.random() < holes else int(k)) for i, (d, c, k) in enumerate(zip(days, close, run, strict=True))]
    return spark.createDataFrame(rows, BARS).repartition(3)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_values(spark, block):
    r = np.random.default_rng(1)
    rows = [(k, i, None if r.random() < 0.2 else float(r.normal())) for k in ("a", None) for i in range(40) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = scans.running(df, ["k"], "i", {"s": ("sum", F.col("v")), "p": ("product", F.col("v")), "m": ("max", F.col("v"))}, block).toPandas()
    assert len(got) == len(rows)
    for key in ("a", None):
        own = got[got["k"].isna() if key is None else got["k"] == key].sort_values("i")
        v = own["v"].to_numpy()
        assert np.allclose(own["s"], np.nancumsum(v)) and np.allclose(own["p"], np.nancumprod(v))
        assert np.allclose(own["m"], pd.Series(v).cummax().ffill(), equal_nan=True)
    numbers = scans.numbered(df, ["k"], "i", "n", block).where("k = 'a'").orderBy("i").toPandas()["n"]
    assert numbers.tolist() == list(range(len(numbers)))


def test_positions_and_runs_by_blocks(spark):
    df = table(spark)
    numbered = with_pos(df.drop("pos"), days=20).join(df.withColumnRenamed("pos", "p"), ["symbol", "date"])
    assert numbered.where("pos <> p").count() == 0 and numbered.count() == 400
    one, many = (paths.path_features(df, block=b).orderBy("symbol", "pos").toPandas() for b in (10_000, 7))
    pd.testing.assert_frame_equal(one, many)


@pytest.mark.parametrize(("block", "fan"), [(7, 2), (1, 3), (50, 256), (4096, 256)])
@pytest.mark.parametrize("horizon", [1, 5, 20])
def test_chosen_trades_are_the_greedy_ones(spark, block, fan, horizon):
    r, rows, want = np.random.default_rng(2), [], []
    for key, density in (("a", 0.4), ("b", 0.02), ("c", 1.0)):
        found = np.flatnonzero(r.random(300) < density).tolist()
        rows += [(key, int(p), f"{key}{p}") for p in r.permutation(found)]
        free = 0
        for p in found:
            if p >= free:
                want.append((key, p, f"{key}{p}"))
                free = p + horizon + 2
    df = spark.createDataFrame(rows, "k string, pos int, name string").repartition(3)
    got = backtest.non_overlapping(df, ("k",), horizon, block, fan)
    assert got.columns == ["k", "pos", "name"] and sorted(tuple(r) for r in got.collect()) == want
    assert backtest.non_overlapping(df.limit(0), ("k",), horizon).count() == 0


@pytest.mark.parametrize("block", [3, 10_000])
def test_statistics_from_trades_equal_those_from_bars(spark, block):
    df = table(spark, holes=0)
    made, equity, stats = backtest.walkforward_backtest(df, lookback=60)
    got = backtest.performance(made, backtest.lengths_of(df), block=block).orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(got, stats.orderBy("symbol").toPandas())
    curve = backtest.equity_curve(df, made, block=block).toPandas()
    trades = made.toPandas()
    for row in got.itertuples():
        e = curve[curve["symbol"] == row.symbol].sort_values("pos")["equity"].to_numpy()
        r = e[1:] / e[:-1] - 1
        own = trades[trades["symbol"] == row.symbol]
        assert row.trade_count == len(own) > 3
        assert np.isclose(row.total_return, e[-1] - 1) and np.isclose(row.max_drawdown, (e / np.maximum.accumulate(e) - 1).min())
        assert np.isclose(row.sharpe, r.mean() / r.std() * 252**0.5)


def test_statistics_without_trades(spark):
    df = table(spark, n=20)
    made = backtest.trades(df, F.lit(False), 5, 5.0)
    got = backtest.performance(made, backtest.lengths_of(df)).first()
    assert (got.total_return, got.max_drawdown, got.sharpe, got.trade_count, got.exposure_time) == (0.0, 0.0, None, 0, 0.0)


def drift_by_hand(states, recent=10, n=4):
    out, seen = {}, []
    for pos, s in enumerate(states):
        if s is None:
            continue
        seen.append(s)
        if len(seen) > recent:
            p, q = (np.bincount(v, minlength=n) + 1e-6 for v in (seen[-recent:], seen[:-recent]))
            p, q = p / p.sum(), q / q.sum()
            out[pos] = float((p * (np.log(p) - np.log(q))).sum())
    return out


@pytest.mark.parametrize("block", [12, 4096])
def test_drift_as_of_each_bar(spark, block):
    df = table(spark, n=150)
    got = monitoring.rolling_drift(df, 10, 0.3, 4, block=block).collect()
    for symbol in ("A", "B"):
        states = [r.state for r in df.where(F.col("symbol") == symbol).orderBy("pos").collect()]
        want = drift_by_hand(states)
        own = {r.pos: r for r in got if r.symbol == symbol}
        assert len(own) == sum(s is not None for s in states)
        assert {p for p, r in own.items() if r.kl is not None} == set(want)
        assert all(abs(own[p].kl - v) < 1e-9 and own[p].alert == (v >= 0.3) for p, v in want.items())
    assert {r.alert for r in got} == {True, False}


def test_drift_does_not_look_ahead(spark):
    df = table(spark, n=150)
    changed = df.withColumn("state", F.when(F.col("pos") > 80, F.lit(0)).otherwise(F.col("state")))
    before, after = (sorted(map(tuple, monitoring.rolling_drift(d, 10, 0.3, 4).where("pos <= 80").collect()), key=str) for d in (df, changed))
    assert before == after and len(before) > 100


@pytest.mark.parametrize(("window", "step", "block"), [(12, 1, 5), (12, 5, 4096), (2, 1, 3)])
def test_rolling_matrices_by_changes(spark, window, step, block):
    df = table(spark, n=80, holes=0.4)
    got = markov.rolling_matrices(df, window, step, 3, block)
    cells = {(r.symbol, r.anchor, r.src, r.dst): (r.n, r.p) for r in got.collect()}
    want = {}
    for symbol in ("A", "B"):
        states = [r.state for r in df.where(F.col("symbol") == symbol).orderBy("pos").collect()]
        for anchor in range(window - 1, 80, step):
            own = [s for s in states[anchor - window + 1 : anchor + 1] if s is not None]
            for a, b in zip(own, own[1:], strict=False):
                if a < 3 and b < 3:
                    want[symbol, anchor, a, b] = want.get((symbol, anchor, a, b), 0) + 1
    assert {k: n for k, (n, _) in cells.items()} == want
    rows = {}
    for (s, k, a, _), (_, p) in cells.items():
        rows[s, k, a] = rows.get((s, k, a), 0) + p
    assert all(abs(v - 1) < 1e-12 for v in rows.values())


# Hidden Markov models


def sequential(p, pi, a):
    """Forward-backward bar by bar for one start."""
    n, k = p.shape
    f, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        f[t] = (pi if t == 0 else f[t - 1] @ a) * p[t]
        scale[t] = f[t].sum()
        f[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        b[t] = a @ (p[t + 1] * b[t + 1]) / scale[t + 1]
    moves = sum(a * np.outer(f[t], p[t + 1] * b[t + 1]) / scale[t + 1] for t in range(n - 1))
    return f * b, moves, np.log(scale).sum()


@pytest.mark.parametrize("n", [2, 3, 10, 97, 400])
def test_scan_equals_recursion(n):
    r = np.random.default_rng(n)
    starts, k = 3, 4
    p, x = r.random((n, starts, k)) + 0.01, r.normal(size=(n, 2))
    a = r.random((starts, k, k)) + 0.05
    a /= a.sum(axis=2, keepdims=True)
    pi = np.full((starts, k), 1 / k)
    for block in (n, 1, 7, 50):
        cuts = list(range(0, n, block))
        one = [hidden.joined(*hidden.products(p[c : c + block], a, c == 0)) for c in cuts]
        state, weight, total = hidden.ends(np.stack([m for m, _ in one]), np.stack([s for _, s in one]), pi, np.ones((starts, k)))
        sums = {}
        for i, c in enumerate(cuts):
            for name, v in hidden.expectations(x[c : c + block], p[c : c + block], a, state[i], weight[i], c == 0).items():
                sums[name] = sums.get(name, 0) + v
        for s in range(starts):
            g, moves, like = sequential(p[:, s], pi[s], a[s])
            assert abs(total[s] - like) < 1e-9 * max(1, abs(like))
            assert np.allclose(sums["n"][s], g.sum(axis=0), atol=1e-9) and np.allclose(sums["moves"][s], moves, atol=1e-9)
            assert np.allclose(sums["x"][s], g.T @ x, atol=1e-9) and np.allclose(sums["first"][s], g[0], atol=1e-9)
            assert np.allclose(sums["xx"][s], np.einsum("tk,td,te->kde", g, x, x), atol=1e-9)


def planted(n=900, seed=5):
    r = np.random.default_rng(seed)
    states = np.repeat(np.arange(n // 60) % 2, 60)[:n]
    cov = [np.array([[1.0, 0.8], [0.8, 1.0]]), np.array([[2.0, -1.2], [-1.2, 1.0]])]
    mean = np.array([[0.0, 0.0], [3.0, -2.0]])
    return states, np.stack([r.multivariate_normal(mean[s], cov[s]) for s in states]), mean, cov


def test_full_covariances_are_recovered():
    states, x, mean, cov = planted()
    model = hidden.fit_blocks(x, 2, starts=4, full=True)
    order = np.argsort(model["mean"][:, 0])
    assert np.abs(model["mean"][order] - mean).max() < 0.25
    assert np.abs(model["cov"][order] - np.stack(cov)).max() < 0.35
    path, _ = hidden.fit_hmm(x, 2, starts=4, full=True)
    assert max((path == states).mean(), (path != states).mean()) > 0.97
    plain = hidden.fit_blocks(x, 2, starts=4)
    assert np.abs(plain["cov"] * (1 - np.eye(2))).max() == 0 and model["log_likelihood"] > plain["log_likelihood"] + 50


@pytest.mark.parametrize("full", [False, True])
def test_fits_do_not_depend_on_blocks(full):
    _, x, _, _ = planted(400)
    one, many = (hidden.fit_blocks(x, 2, starts=3, full=full, block=b) for b in (10_000, 37))
    assert all(np.allclose(one[c], many[c], atol=1e-9) for c in ("pi", "a", "mean", "cov")) and abs(one["log_likelihood"] - many["log_likelihood"]) < 1e-7


def test_long_symbols_are_fitted_by_jobs_over_blocks(spark):
    rows = []
    for s, n in (("A", 300), ("B", 120), ("C", 3)):
        x = planted(n, seed=n)[1] if n > 3 else np.zeros((n, 2))
        rows += [(s, i, None if i == 50 else float(u), float(v)) for i, (u, v) in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, pos int, u double, v double")
    found = [hidden.hidden_models(df, ["u", "v"], 2, 2, 6, covariance="full", block=b) for b in (10_000, 100)]
    one, many = ({r.symbol: r for r in models.collect()} for models, _ in found)
    assert set(one) == set(many) == {"A", "B"}
    for s in one:
        assert abs(one[s].log_likelihood - many[s].log_likelihood) < 1e-6
        assert all(np.allclose(one[s][c], many[s][c], atol=1e-7) for c in ("pi", "a", "mean", "cov"))
    paths_ = [sorted(map(tuple, regimes.collect())) for _, regimes in found]
    assert paths_[0] == paths_[1] and len(paths_[0]) == 299 + 119
    cells = hidden.model_covariances(found[0][0], ["u", "v"]).where("symbol = 'A'").collect()
    assert len(cells) == 8 and {(r.a, r.b) for r in cells} == {(a, b) for a in "uv" for b in "uv"}
    wide = {(r.regime, r.a, r.b): r.covariance for r in cells}
    assert all(wide[g, "u", "v"] == pytest.approx(wide[g, "v", "u"]) for g in (0, 1)) and max(abs(wide[g, "u", "v"]) for g in (0, 1)) > 0.3


def test_best_paths_through_blocks():
    r = np.random.default_rng(8)
    for n, k in ((1, 3), (5, 2), (60, 3)):
        e, a = np.log(r.random((n, k)) + 0.01), r.random((k, k)) + 0.05
        a /= a.sum(axis=1, keepdims=True)
        pi = np.log(np.full(k, 1 / k))
        want = hidden.viterbi(e, a, pi, True)
        score = pi
        for c in range(0, n, 7):
            score = (score[:, None] + hidden.best_moves(e[c : c + 7], a, c == 0)).max(axis=0)
        reached = pi[want[0]] + e[0, want[0]] + sum(np.log(a[i, j]) + e[t + 1, j] for t, (i, j) in enumerate(zip(want[:-1], want[1:], strict=True)))
        assert abs(score.max() - reached) < 1e-9


# Bootstrap


def brute_samples(x, n, block, chunk_rows, batch, name):
    """The same draws, put together value by value."""
    size, block = len(x), min(max(block, 1), len(x))
    starts, number = size - block + 1, -(-size // block)
    chunks, before = -(-starts // chunk_rows), lambda c: min(c * chunk_rows, starts)
    samples = [[] for _ in range(n)]
    for c in range(chunks):
        for q, first in enumerate(range(0, n, batch)):
            for kind, many, length in (("whole", number - 1, block), ("last", 1, size - (number - 1) * block)):
                counts = statistics.share_of((*name, q, kind), np.full(min(batch, n - first), many), before, c, chunks)
                at = statistics._rng(*name, q, kind, "of", c).integers(0, before(c + 1) - before(c), int(counts.sum()))
                for r, s in zip(np.repeat(np.arange(len(counts)), counts), at, strict=True):
                    samples[first + r] += x[before(c) + s : before(c) + s + length].tolist()
    assert all(len(s) == size for s in samples)
    return np.array(samples)


@pytest.mark.parametrize("chunk_rows", [16, 65_536])
def test_bootstrap_draws(spark, chunk_rows):
    r = np.random.default_rng(9)
    values = {"A": r.normal(0.01, 0.02, 83), "B": r.normal(0, 1, 3), "C": np.array([0.5])}
    rows = [(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)] + [("A", 200, None), ("D", 0, None)]
    df = spark.createDataFrame(rows, "symbol string, pos int, v double")
    for statistic, holding, f in (("mean", None, lambda s: s.mean(axis=1)), ("std", None, lambda s: s.std(axis=1)), ("mean", 5.0, None)):
        out = [statistics.bootstrap(d, "v", statistic=statistic, n=120, batch=50, chunk_rows=chunk_rows, holding=holding).orderBy("symbol").toPandas() for d in (df, df.repartition(5, "pos"))]
        pd.testing.assert_frame_equal(*out, rtol=1e-9)
        got = {r.symbol: r for r in out[0].itertuples()}
        assert got["D"].n == 0 and np.isnan(got["D"].estimate)
        for k, x in values.items():
            if holding and len(x) < 2:
                assert np.isnan(got[k].estimate) and got[k].n == 1
                continue
            samples = brute_samples(x, 120, 5, chunk_rows, 50, (7, k))
            if holding:
                spread = samples.std(axis=1, ddof=1)
                found = np.where(spread > 1e-9, samples.mean(axis=1) / np.where(spread > 1e-9, spread, 1), 0) * (252 / 5) ** 0.5
            else:
                found = f(samples)
            assert np.allclose([got[k].low, got[k].high], np.quantile(found, [0.025, 0.975]), atol=1e-9), (statistic, holding, k)
    means = statistics.bootstrap(df, "v", n=400, chunk_rows=chunk_rows).where("symbol = 'A'").first()
    assert means.low < values["A"].mean() < means.high and means.high - means.low < 0.03
    mid = statistics.bootstrap(df, "v", statistic="median", n=60).where("symbol = 'A'").first()
    assert mid.low <= mid.estimate <= mid.high and mid.estimate == pytest.approx(np.median(values["A"]))
