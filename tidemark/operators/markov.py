"""Transition matrices in long form, forecasts from them, and their stability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import N_STATES
from ..functions.scans import BLOCK, blocked, numbered, running
from ..sources.storage import stored


def transitions(df: DataFrame, keys: tuple[str, ...] = ("symbol",), state: str = "state") -> DataFrame:
    """Neighbouring pairs (keys, pos, src, dst) of known states: rows without a
    state, or with a null key, go first, so pairs bridge them."""
    known = df.dropna(subset=[*keys, state])
    order = Window.partitionBy(*keys).orderBy("pos")
    return known.select(
        *keys, "pos", F.col(state).alias("src"), F.lead(state).over(order).alias("dst")
    ).where("dst IS NOT NULL")


def matrix(pairs: DataFrame, keys: tuple[str, ...] = ("symbol",), n_states: int = N_STATES, alpha: float = 0.0, empty_row: str = "identity") -> DataFrame:
    """Dense long matrix (keys, src, dst, n, p) of counted pairs. A row without
    observations becomes the identity's, uniform (any alpha > 0) or zero."""
    if n_states < 1 or alpha < 0 or empty_row not in ("identity", "zero"):
        raise ValueError("bad matrix options")
    inside = F.col("src").between(0, n_states - 1) & F.col("dst").between(0, n_states - 1)
    counts = pairs.where(inside).groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ids = F.sequence(F.lit(0), F.lit(n_states - 1))
    grid = pairs.select(*keys).distinct().withColumn("src", F.explode(ids)).withColumn("dst", F.explode(ids))
    full = grid.join(counts, [*keys, "src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum(F.col("n") + alpha).over(Window.partitionBy(*keys, "src"))
    bare = (F.col("src") == F.col("dst")).cast("double") if empty_row == "identity" else F.lit(0.0)
    return full.withColumn("p", F.coalesce((F.col("n") + alpha) / F.nullif(total, F.lit(0.0)), bare))


def forecast(p: DataFrame, steps: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``steps``-step transition probabilities: each step is one join and sum on the small matrix."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    one = p.select(*keys, "src", "dst", "p")
    out = one
    for _ in range(steps - 1):
        step = one.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("p").alias("_q"))
        out = out.join(step, [*keys, "dst"]).groupBy(*keys, "src", F.col("_to").alias("dst")).agg(F.sum(F.col("p") * F.col("_q")).alias("p"))
    return out


def check_matrix(p: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``p`` (keys, src, dst, p) itself; a matrix that isn't square, or holds a value that isn't finite, is an error.

    Square: each pair of states from 0 to the largest one, once.
    """
    n = F.greatest(F.max("src"), F.max("dst")) + 1
    sound = p.groupBy(*keys).agg(
        (F.coalesce(F.min(F.least("src", "dst")), F.lit(-1)) >= 0).alias("at_zero"),
        (F.count(F.lit(1)) == n * n).alias("full"),
        (F.count_distinct("src", "dst") == n * n).alias("once"),
        F.every(F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") != float("inf"))).alias("finite"),
    )
    bad = sound.where("NOT coalesce(at_zero AND full AND once AND finite, false)").first()
    if bad is not None:
        what = "isn't square" if not (bad["at_zero"] and bad["full"] and bad["once"]) else "holds values that aren't finite"
        raise ValueError(f"the transition matrix of {', '.join(str(bad[k]) for k in keys)} {what}")
    return p


def state_forecast(p: DataFrame, state: int, steps: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Probabilities (keys, dst, p) ``steps`` after ``state``; a matrix or state that can't be is an error.

    A row is carried from step to step, and the negative rounding errors of
    its end go: the row sums to 1, or is uniform where nothing is left.
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    check_matrix(p, keys)
    if state < 0 or not p.groupBy(*keys).agg(F.max("src").alias("_m")).where(F.col("_m") < state).isEmpty():
        raise ValueError(f"state {state} is outside the transition matrix")
    row = p.where(F.col("src") == state).select(*keys, "dst", "p")
    for _ in range(steps - 1):
        move = p.select(*keys, "src", F.col("dst").alias("_to"), F.col("p").alias("_q"))
        row = row.withColumnRenamed("dst", "src").join(move, [*keys, "src"]).groupBy(*keys, F.col("_to").alias("dst")).agg(F.sum(F.col("p") * F.col("_q")).alias("p"))
    own = Window.partitionBy(*keys)
    kept = F.greatest("p", F.lit(0.0))
    return row.select(*keys, "dst", F.when(F.sum(kept).over(own) > 1e-12, kept / F.nullif(F.sum(kept).over(own), F.lit(0.0))).otherwise(1 / F.count(F.lit(1)).over(own)).alias("p"))


def compare_conditional(conditional: DataFrame, plain: DataFrame, regime: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Distance of each regime's matrix from the unconditional one: total and largest row L1."""
    other = plain.select(*keys, "src", "dst", F.col("p").alias("_q"))
    rows = conditional.join(other, [*keys, "src", "dst"]).groupBy(*keys, regime, "src").agg(F.sum(F.abs(F.col("p") - F.col("_q"))).alias("_d"))
    return rows.groupBy(*keys, regime).agg(F.sum("_d").alias("total_l1"), F.max("_d").alias("max_row_l1"))


def rolling_matrices(df: DataFrame, window: int, step: int = 1, n_states: int = N_STATES, block: int = BLOCK) -> DataFrame:
    """Matrices of the last ``window`` bars at every ``step``-th bar.

    Long and sparse: (symbol, anchor, src, dst, n, p) for the cells seen; a row
    without observations has none (all zero). Anchors count bars; bars without
    a state take their place in a window, and pairs bridge them.
    """
    if window < 2 or step < 1:
        raise ValueError("window must be at least 2 and step at least 1")
    every = numbered(df.select("symbol", "pos", "state"), ["symbol"], "pos", "k", block)
    on = Window.partitionBy("symbol").orderBy("k")
    known = every.where("state IS NOT NULL")
    pairs = known.select("symbol", F.col("k").alias("at"), F.lag("k").over(on).alias("from"), F.lag("state").over(on).alias("src"), F.col("state").alias("dst"))
    pairs = pairs.where(F.col("src").between(0, n_states - 1) & F.col("dst").between(0, n_states - 1))
    # The pair of j and k comes into the windows at the anchor k and leaves at j + window: counts
    # change at these places only, and between two of them a cell's rows are written once.
    cell = ["symbol", "src", "dst"]
    events = pairs.select(*cell, F.explode(F.array(F.struct(F.col("at").alias("p"), F.lit(1).alias("d")), F.struct((F.col("from") + window).alias("p"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy(*cell, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    counts = running(events, cell, "p", {"n": ("sum", F.col("d"))}, block)
    following = F.lead("p").over(Window.partitionBy(*cell).orderBy("p"))
    ends = every.groupBy("symbol").agg(F.max("k").alias("end"))
    spans = counts.withColumn("until", following).where("n > 0").join(ends, "symbol")
    first = F.greatest(F.col("p"), F.lit(window - 1))
    first = first + F.pmod(F.lit(window - 1) - first, F.lit(step))
    last = F.least(F.coalesce(F.col("until") - 1, F.col("end")), F.col("end"))
    counts = spans.withColumn("anchor", F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(step))))
    counts = counts.select(*cell, F.col("n").cast("long").alias("n"), F.explode("anchor").alias("anchor")).select("symbol", "anchor", "src", "dst", "n")
    total = F.sum("n").over(Window.partitionBy("symbol", "anchor", "src"))
    return counts.withColumn("p", F.col("n") / total)


def stability(rolling: DataFrame, step: int, n_states: int = N_STATES) -> DataFrame:
    """Per symbol, anchor and state: 1 less half the L1 change of its row since the
    anchor before (rows without observations are zero, and stable while they stay so)."""
    rolling = stored(rolling, "rolling-matrices")  # read four times
    now = rolling.select("symbol", "anchor", "src", "dst", F.col("p").alias("a"))
    before = rolling.select("symbol", (F.col("anchor") + step).alias("anchor"), "src", "dst", F.col("p").alias("b"))
    last = rolling.groupBy("symbol").agg(F.min("anchor").alias("_lo"), F.max("anchor").alias("_hi"))
    both = now.join(before, ["symbol", "anchor", "src", "dst"], "full_outer").join(last, "symbol")
    both = both.where((F.col("anchor") > F.col("_lo")) & (F.col("anchor") <= F.col("_hi")))
    l1 = both.groupBy("symbol", "anchor", "src").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("l1"))
    anchors = rolling.join(last, "symbol").where("anchor > _lo").select("symbol", "anchor").distinct()
    grid = anchors.withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    return grid.join(l1, ["symbol", "anchor", "src"], "left").select(
        "symbol", "anchor", "src", (1 - 0.5 * F.coalesce("l1", F.lit(0.0))).alias("stability")
    )


def stability_score(per_state: DataFrame) -> DataFrame:
    return per_state.groupBy("symbol", "anchor").agg(F.avg("stability").alias("stability"))


def unstable_states(per_state: DataFrame, threshold: float = 0.7) -> DataFrame:
    return per_state.groupBy("symbol", "src").agg(F.avg("stability").alias("mean_stability")).where(F.col("mean_stability") < threshold)


def counts_to_matrix(counts: np.ndarray) -> np.ndarray:
    """Row-normalised counts; a row without any becomes the identity's."""
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), np.eye(len(counts)))


def row_forecast(p: np.ndarray, state: int, steps: int) -> np.ndarray:
    """A row of p^steps without the whole power: a vector times the matrix, step by step."""
    v = np.zeros(len(p))
    v[state] = 1.0
    for _ in range(steps):
        v = v @ p
    v = np.maximum(v, 0)
    return v / v.sum() if v.sum() > 0 else np.full(len(p), 1 / len(p))


def _between(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of ``rows[low:high]`` for many ranges at once, from running sums."""
    running = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    return running[high] - running[low]


def _pair_counts(s: np.ndarray, low: np.ndarray, high: np.ndarray, n_states: int) -> np.ndarray:
    """Counts (ranges, n, n) of the neighbouring pairs within ``s[low:high]``, for many ranges."""
    one = np.zeros((max(len(s) - 1, 0), n_states * n_states))
    one[np.arange(len(one)), s[:-1] * n_states + s[1:]] = 1
    return _between(one, low, np.maximum(high - 1, low)).reshape(-1, n_states, n_states)


def _chains(counts: np.ndarray) -> np.ndarray:
    """Row-normalised counts of many windows; a row without any becomes the identity's."""
    total = counts.sum(axis=2, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), np.eye(counts.shape[1]))


def walkforward_forecasts(df: DataFrame, lookback: int = 252, horizons: tuple[int, ...] = (1, 5, 10, 20), n_states: int = N_STATES, block: int = 5000) -> DataFrame:
    """Per bar: state probabilities from the ``lookback`` known states before it.

    Returns (symbol, pos, horizon, dst, p) for the states with p > 0. Counts are
    differences of running counts, for all bars of a block at once; the matrix is
    never raised to a power.
    """
    if lookback < 2:
        raise ValueError("lookback must be at least 2")
    order = Window.partitionBy("symbol").orderBy("pos")
    known = df.where("state IS NOT NULL").select("symbol", "pos", "state", (F.row_number().over(order) - 1).alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        s, pos, own, k = (pdf[c].to_numpy() for c in ("state", "pos", "own", "k"))
        at = np.flatnonzero(own & (k >= lookback))
        p = _chains(_pair_counts(s, at - lookback, at, n_states))
        v, parts = np.eye(n_states)[s[at]], []
        for h in range(1, max(horizons) + 1):
            v = np.einsum("ai,aij->aj", v, p)
            if h in horizons:
                i, d = np.nonzero(v > 0)
                share = v[i, d] / v[i].sum(axis=1)
                parts.append(pd.DataFrame({"pos": pos[at[i]], "horizon": h, "dst": d, "p": share}))
        out = pd.concat(parts, ignore_index=True)
        out.insert(0, "symbol", pdf["symbol"].iat[0])
        return out

    cut = blocked(known, "k", block, lookback)
    return cut.groupBy("symbol", "block").applyInPandas(run, "symbol string, pos int, horizon int, dst int, p double")


def walkforward_markov_value(df: DataFrame, horizon: int = 5, lookback: int = 252, min_samples: int = 5, cost_bps: float = 5.0, n_states: int = N_STATES, block: int = 5000) -> DataFrame:
    """Per bar: forecast state probabilities times the states' own mean payoffs, from earlier bars alone.

    Training signals of position p are p - horizon - lookback .. p - horizon - 1.
    States with fewer than ``min_samples`` payoffs are left out; ``coverage`` is
    the probability of the rest and ``weighted_samples`` their expected count.
    """
    base = df.select("symbol", "pos", "close", "state", F.col("pos").alias("k"))
    reach = lookback + horizon + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        pos, close, own = pdf["pos"].to_numpy(), pdf["close"].to_numpy(), pdf["own"].to_numpy()
        s = pdf["state"].fillna(-1).to_numpy().astype(int)
        r = np.full(len(pdf), np.nan)
        if len(pdf) > horizon:
            r[:-horizon] = close[horizon:] / close[:-horizon] - 1
        known = np.flatnonzero(s >= 0)
        at = np.flatnonzero(own & (pos >= horizon + min_samples) & (s >= 0))
        # The training bars of each asked bar, as a range of the known ones.
        low, high = (np.searchsorted(known, x) for x in (np.maximum(0, at - horizon - lookback), np.maximum(0, at - horizon)))
        one = np.eye(n_states)[s[known]]
        numbers = _between(one, low, high)
        sums = _between(one * np.nan_to_num(r[known])[:, None], low, high)
        p = _chains(_pair_counts(s[known], low, high, n_states))
        v = np.eye(n_states)[s[at]]
        for _ in range(horizon):
            v = np.einsum("ai,aij->aj", v, p)
        use = (numbers >= max(1, min_samples)) & (high - low >= 2)[:, None]
        payoff = np.where(use, sums / np.maximum(numbers, 1) - cost_bps / 1e4, 0.0)
        value = np.where(use.any(axis=1), (v * payoff).sum(axis=1), np.nan)
        out = pd.DataFrame({"pos": pos[at], "state": s[at], "markov_ev": value, "coverage": (v * use).sum(axis=1), "weighted_samples": (v * use * numbers).sum(axis=1)})
        out["markov_ev"] = out["markov_ev"].astype(object).where(out["markov_ev"].notna(), None)
        out.insert(0, "symbol", pdf["symbol"].iat[0])
        return out

    cut = blocked(base, "k", block, reach)
    return cut.groupBy("symbol", "block").applyInPandas(
        run, "symbol string, pos int, state int, markov_ev double, coverage double, weighted_samples double"
    )


def _stationary(v: np.ndarray) -> list[float]:
    """The p with p P = p and sum 1, by least squares; uniform where there is none."""
    n = int(round(len(v) ** 0.5))
    equations = np.vstack([v.reshape(n, n).T - np.eye(n), np.ones((1, n))])
    found = np.maximum(np.linalg.lstsq(equations, np.append(np.zeros(n), 1.0), rcond=None)[0], 0)
    return (found / found.sum() if found.sum() > 1e-12 else np.full(n, 1 / n)).tolist()


def stationary(p: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The stationary distribution of each matrix: (keys, dst, p)."""
    check_matrix(p, keys)
    cells = F.array_sort(F.collect_list(F.struct("src", "dst", "p")))
    dense = p.groupBy(*keys).agg(F.transform(cells, lambda x: x["p"]).alias("m"))

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        return m.map(lambda v: _stationary(np.asarray(v)))

    return dense.select(*keys, F.posexplode(solve("m")).alias("dst", "p"))
