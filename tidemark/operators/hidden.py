"""Gaussian hidden Markov models by scans: a long history is many tasks' work.

A bar acts on the filtered state as a k x k matrix, and matrices multiply in any
grouping. A block of bars is therefore one scaled product; the products of a
symbol's blocks give each block the state it starts from and the weight of all
that follows, and then every block finishes its own expectations. Inside a
block the same is done with chunks, so that a step of numpy works on many
chunks at once. Only matrices, states and sums pass between tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scans import numbered
from ..sources.storage import stored

#: Gain in log-likelihood below which a fit has converged.
GAIN = 1e-2
#: Bars of a block.
BLOCK = 65_536
TINY = 1e-300
MODEL = "symbol string, k int, width int, pi array<double>, a array<double>, mean array<double>, cov array<double>, log_likelihood double"


def log_densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log densities (bars, starts, k) under the starts' normal distributions, by Cholesky factors."""
    lower = np.linalg.cholesky(cov)
    # Solving against the identity once makes a density a product with all bars.
    back = np.linalg.inv(lower)
    z = np.einsum("skij,tskj->tski", back, x[:, None, None, :] - mean[None])
    logdet = np.log(np.diagonal(lower, axis1=-2, axis2=-1)).sum(axis=-1)
    return -0.5 * (z**2).sum(axis=-1) - logdet[None] - 0.5 * x.shape[1] * math.log(2 * math.pi)


def _chunks(n: int) -> tuple[int, int]:
    size = max(1, math.isqrt(n))
    return size, -(-n // size)


def _scaled(m: np.ndarray, axes) -> tuple[np.ndarray, np.ndarray]:
    total = m.sum(axis=axes, keepdims=True) + TINY
    return m / total, np.log(total)


def products(p: np.ndarray, a: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled products (chunks, starts, k, k) of the bars' matrices, and logs of what was divided out.

    ``p`` holds densities (bars, starts, k). The first bar of a history has no move before it.
    """
    n, size = len(p), _chunks(len(p))[0]
    count = _chunks(n)[1]
    m = np.tile(np.eye(p.shape[2]), (count, p.shape[1], 1, 1))
    logs = np.zeros((count, p.shape[1]))
    for s in range(size):
        at = p[s::size]
        step = a[None] * at[:, :, None, :]
        if first and s == 0:
            step[0] = np.eye(p.shape[2])[None] * at[0][:, None, :]
        m[: len(at)], total = _scaled(m[: len(at)] @ step, (-2, -1))
        logs[: len(at)] += total[..., 0, 0]
    return m, logs


def joined(m: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One product of all chunks' products."""
    while len(m) > 1:
        odd = len(m) % 2
        both, total = _scaled(m[: len(m) - odd : 2] @ m[1::2], (-2, -1))
        added = logs[: len(m) - odd : 2] + logs[1::2] + total[..., 0, 0]
        m, logs = (np.concatenate([both, m[-1:]]), np.concatenate([added, logs[-1:]])) if odd else (both, added)
    return m[0], logs[0]


def ends(m: np.ndarray, logs: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From products in order: the filtered state before each (starts, k), the
    weight of what follows each, and the log-likelihood. ``before`` and ``after`` are those of the whole."""
    state, weight = np.empty((len(m), *before.shape)), np.empty((len(m), *before.shape))
    now, total = before, np.zeros(before.shape[0])
    for c in range(len(m)):
        state[c] = now
        now, log = _scaled((now[:, None] @ m[c])[:, 0], -1)
        total += log[:, 0] + logs[c]
    now = after
    for c in range(len(m) - 1, -1, -1):
        weight[c] = now
        now = _scaled((m[c] @ now[:, :, None])[:, :, 0], -1)[0]
    return state, weight, total


def expectations(x: np.ndarray, p: np.ndarray, a: np.ndarray, before: np.ndarray, after: np.ndarray, first: bool) -> dict[str, np.ndarray]:
    """Sums over a block's bars: states, moves, first and second moments, and the first bar's states."""
    n, starts, k = p.shape
    size = _chunks(n)[0]
    m, logs = products(p, a, first)
    state, weight, _ = ends(m, logs, before, after)
    f, b = np.empty_like(p), np.empty_like(p)
    now = state
    for s in range(size):
        at = p[s::size]
        moved = (now[: len(at), :, None] @ a[None])[:, :, 0]
        if first and s == 0:
            moved[0] = before
        now = _scaled(moved * at, -1)[0]
        f[s::size] = now
    last = np.minimum(np.arange(len(m)) * size + size, n) - 1
    b[last] = weight
    for s in range(size - 2, -1, -1):
        at = np.arange(s, n, size)
        at = at[~np.isin(at, last)]
        if len(at):
            b[at] = _scaled((a[None] @ (p[at + 1] * b[at + 1])[..., None])[..., 0], -1)[0]
    g = f * b
    g /= g.sum(axis=2, keepdims=True) + TINY
    earlier = f[:-1] if first else np.concatenate([before[None], f[:-1]])
    later = (p * b)[1:] if first else p * b
    norm = np.einsum("tsi,sij,tsj->ts", earlier, a, later, optimize=True) + TINY
    moves = a * np.einsum("tsi,tsj->sij", earlier / norm[..., None], later, optimize=True)
    return {
        "moves": moves, "n": g.sum(axis=0), "x": np.einsum("tsk,td->skd", g, x, optimize=True),
        "xx": np.einsum("tsk,td,te->skde", g, x, x, optimize=True), "first": g[0] if first else np.zeros((starts, k)),
    }


def updated(sums: dict[str, np.ndarray], floor: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next (pi, a, mean, cov): ``floor`` is added to the variances."""
    w = sums["n"] + 1e-12
    mean = sums["x"] / w[..., None]
    outer = mean[..., :, None] * mean[..., None, :]
    cross = mean[..., :, None] * sums["x"][..., None, :]
    cov = (sums["xx"] - cross - np.swapaxes(cross, -1, -2) + outer * sums["n"][..., None, None]) / w[..., None, None]
    cov = (cov if full else cov * np.eye(len(floor))) + np.diag(floor)
    a = (sums["moves"] + 1e-12) / (sums["moves"] + 1e-12).sum(axis=2, keepdims=True)
    return sums["first"], a, mean, cov


def started(rows: np.ndarray, variance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First parameters of all starts from their drawn rows (starts, k, d), and the floor of variances."""
    starts, floor = len(rows), 1e-3 * variance + 1e-12
    a = np.full((starts, k, k), 0.1 / max(1, k - 1))
    a[:, np.arange(k), np.arange(k)] = 0.9
    a /= a.sum(axis=2, keepdims=True)
    return np.full((starts, k), 1 / k), a, rows, np.tile(np.diag(variance + floor), (starts, k, 1, 1)), floor


def drawn(n: int, k: int, starts: int, seed: int) -> np.ndarray:
    """Row numbers (starts, k) of the first means."""
    return np.stack([np.random.default_rng(seed + s).choice(n, k, replace=False) for s in range(starts)])


def _block_densities(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = log_densities(x, mean, cov)
    top = e.max(axis=2, keepdims=True)
    return np.exp(e - top), top[..., 0].sum(axis=0)


def fit_blocks(x: np.ndarray, k: int = 3, starts: int = 10, rounds: int = 200, seed: int = 7, full: bool = False, block: int = BLOCK) -> dict:
    """The best of several Baum-Welch fits, its bars taken block by block: all starts side by side, until converged."""
    n = len(x)
    if n < 2 * k:
        raise ValueError("too few observations for the number of regimes")
    pi, a, mean, cov, floor = started(x[drawn(n, k, starts, seed)], x.var(axis=0), k)
    cuts = range(0, n, block)
    gained, open_ = np.full(starts, -np.inf), np.arange(starts)

    def likelihood(at: np.ndarray):
        found = [_block_densities(x[c : c + block], mean[at], cov[at]) for c in cuts]
        one = [joined(*products(p, a[at], c == 0)) for c, (p, _) in zip(cuts, found, strict=True)]
        state, weight, total = ends(np.stack([m for m, _ in one]), np.stack([s for _, s in one]), pi[at], np.ones((len(at), k)))
        return found, state, weight, total + sum(top for _, top in found)

    for _ in range(rounds):
        found, state, weight, total = likelihood(open_)
        sums: dict[str, np.ndarray] = {}
        for i, c in enumerate(cuts):
            for name, v in expectations(x[c : c + block], found[i][0], a[open_], state[i], weight[i], c == 0).items():
                sums[name] = sums.get(name, 0) + v
        pi[open_], a[open_], mean[open_], cov[open_] = updated(sums, floor, full)
        done = total - gained[open_] < GAIN
        gained[open_] = total
        open_ = open_[~done]
        if not len(open_):
            break
    # Compared by the likelihoods of the models as they ended.
    total = likelihood(np.arange(starts))[3]
    s = int(total.argmax())
    return {"pi": pi[s], "a": a[s], "mean": mean[s], "cov": cov[s], "log_likelihood": float(total[s])}


def best_moves(e: np.ndarray, a: np.ndarray, first: bool) -> np.ndarray:
    """Best log score from each state before a block's bars to each at its end: a product of max and plus."""
    with np.errstate(divide="ignore"):
        la = np.log(a + TINY)
    n, k = e.shape
    size, count = _chunks(n)
    same = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    m = np.tile(same, (count, 1, 1))
    for s in range(size):
        at = e[s::size]
        step = la[None] + at[:, None, :]
        if first and s == 0:
            step[0] = same + at[0][None]
        m[: len(at)] = (m[: len(at), :, :, None] + step[:, None]).max(axis=2)
    out = m[0]
    for c in range(1, count):
        out = (out[:, :, None] + m[c][None]).max(axis=1)
    return out


def viterbi(e: np.ndarray, a: np.ndarray, before: np.ndarray, first: bool, last: int | None = None) -> np.ndarray:
    """The best path through a block from the scores before it, to the state ``last`` if given."""
    la = np.log(a + TINY)
    back = np.zeros(e.shape, dtype=int)
    score = before + e[0] if first else None
    for t in range(1 if first else 0, len(e)):
        move = (before if score is None else score)[:, None] + la
        back[t] = move.argmax(axis=0)
        score = move.max(axis=0) + e[t]
    path = np.empty(len(e), dtype=np.int32)
    path[-1] = score.argmax() if last is None else last
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit_hmm(x: np.ndarray, k: int = 3, starts: int = 10, rounds: int = 200, seed: int = 7, full: bool = False, block: int = BLOCK) -> tuple[np.ndarray, float]:
    """A fit's most likely path and its log-likelihood."""
    model = fit_blocks(x, k, starts, rounds, seed, full, block)
    e = log_densities(x, model["mean"][None], model["cov"][None])[:, 0]
    return viterbi(e, model["a"], np.log(model["pi"] + TINY), True), model["log_likelihood"]


def _known(df: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(symbol, pos, n, i, block, x): bars with all emissions, numbered, standardised by symbol."""
    rows = numbered(df.select("symbol", "pos", *columns).where(" AND ".join(f"abs({c}) < double('inf')" for c in columns)), ["symbol"], "pos", "i")
    spread = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*[F.stddev_pop(c) for c in columns]).alias("s")
    )
    x = [(F.col(c) - F.col("m")[j]) / (F.col("s")[j] + 1e-12) for j, c in enumerate(columns)]
    out = rows.join(spread, "symbol").select("symbol", "pos", "n", "i", F.floor(F.col("i") / block).cast("int").alias("block"), F.array(*x).alias("x"), "m", "s")
    return out.where(F.col("x").isNotNull())


def _matrix(values) -> np.ndarray:
    return np.array(values.tolist(), dtype=float)


def _flat(model: dict) -> dict:
    return {c: np.asarray(model[c]).ravel().tolist() for c in ("pi", "a", "mean", "cov")}


def _shaped(row, k: int, width: int, starts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    shapes = {"pi": (starts, k), "a": (starts, k, k), "mean": (starts, k, width), "cov": (starts, k, width, width)}
    return tuple(np.array(row[c], dtype=float).reshape(shape) for c, shape in shapes.items())


def fitted_models(known: DataFrame, width: int, k: int, starts: int, rounds: int, seed: int, full: bool, block: int) -> DataFrame:
    """A model a symbol, of :func:`_known` rows. Symbols of one block are fitted in
    a task each; the rounds of longer ones are jobs over all their blocks at once."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("i")["x"])
        model = fit_blocks(x, k, starts, rounds, seed, full, block)
        return pd.DataFrame([{"symbol": pdf["symbol"].iat[0], "k": k, "width": width, "log_likelihood": model["log_likelihood"]} | _flat(model)])[[c.split()[0] for c in MODEL.split(", ")]]

    fit = known.where(F.col("n") >= 2 * k)
    made = fit.where(F.col("n") <= block).groupBy("symbol").applyInPandas(whole, MODEL)
    long = fit.where(F.col("n") > block)
    if long.isEmpty():
        return made
    return made.unionByName(_long_models(long, width, k, starts, rounds, seed, full))


STATE = "symbol string, pi array<double>, a array<double>, mean array<double>, cov array<double>, floor array<double>, gained array<double>, open array<int>"
SUMS = ("moves", "n", "x", "xx", "first")


def _long_models(rows: DataFrame, width: int, k: int, starts: int, rounds: int, seed: int, full: bool) -> DataFrame:
    one = ["symbol", "block"]

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(pdf["i"], pdf["x"], strict=True))
        first = np.array([[at[i] for i in own] for own in drawn(int(pdf["n"].iat[0]), k, starts, seed).tolist()])
        pi, a, mean, cov, floor = started(first, np.array(pdf["var"].iat[0]), k)
        row = {"symbol": pdf["symbol"].iat[0], "floor": floor.tolist(), "gained": [-np.inf] * starts, "open": list(range(starts))}
        return pd.DataFrame([row | _flat({"pi": pi, "a": a, "mean": mean, "cov": cov})])[[c.split()[0] for c in STATE.split(", ")]]

    @F.udf("array<int>")
    def wanted(n):  # a row a symbol
        return sorted({int(i) for i in drawn(n, k, starts, seed).ravel()})

    variance = rows.groupBy("symbol").agg(F.first("n").alias("n"), F.array(*[F.var_pop(F.col("x")[j]) for j in range(width)]).alias("var"))
    asked = variance.select("symbol", "var", F.explode(wanted("n")).alias("i"))
    state = stored(rows.join(asked, ["symbol", "i"]).groupBy("symbol").applyInPandas(begin, STATE), "hidden-state")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        row, first = pdf.iloc[0], int(pdf["block"].iat[0]) == 0
        _, a, mean, cov = _shaped(row, k, width, starts)
        p, top = _block_densities(_matrix(pdf["x"]), mean, cov)
        m, logs = joined(*products(p, a, first))
        return pd.DataFrame([{"symbol": row["symbol"], "block": row["block"], "m": m.ravel().tolist(), "logs": (logs + top).tolist()}])

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        pi = np.array(pdf["pi"].iat[0]).reshape(starts, k)
        m, logs = _matrix(pdf["m"]).reshape(-1, starts, k, k), _matrix(pdf["logs"])
        before, after, total = ends(m, logs, pi, np.ones((starts, k)))
        return pd.DataFrame({"symbol": pdf["symbol"], "block": pdf["block"], "before": [v.ravel().tolist() for v in before], "after": [v.ravel().tolist() for v in after], "total": [total.tolist()] * len(pdf)})

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        row, x = pdf.iloc[0], _matrix(pdf["x"])
        _, a, mean, cov = _shaped(row, k, width, starts)
        p, _ = _block_densities(x, mean, cov)
        made = expectations(x, p, a, np.array(row["before"]).reshape(starts, k), np.array(row["after"]).reshape(starts, k), int(row["block"]) == 0)
        return pd.DataFrame([{"symbol": row["symbol"], "block": row["block"], "total": row["total"]} | {c: made[c].ravel().tolist() for c in SUMS}])

    shapes = {"moves": (starts, k, k), "n": (starts, k), "x": (starts, k, width), "xx": (starts, k, width, width), "first": (starts, k)}

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        made = {c: _matrix(pdf.sort_values("block")[c]).sum(axis=0).reshape(shapes[c]) for c in SUMS}
        now, open_ = _shaped(row, k, width, starts), np.array(row["open"], dtype=int)
        new = updated(made, np.array(row["floor"]), full)
        for old, v in zip(now, new, strict=True):
            old[open_] = v[open_]
        total, gained = np.array(row["total"]), np.array(row["gained"])
        still = open_[total[open_] - gained[open_] >= GAIN]
        gained[open_] = total[open_]
        out = {"symbol": row["symbol"], "floor": row["floor"], "gained": gained.tolist(), "open": still.tolist()}
        return pd.DataFrame([out | _flat(dict(zip(("pi", "a", "mean", "cov"), now, strict=True)))])[[c.split()[0] for c in STATE.split(", ")]]

    doubles = "array<double>"

    def entered(now: DataFrame) -> DataFrame:
        made = rows.select("symbol", "block", "i", "x").join(now, "symbol").groupBy(*one).applyInPandas(product, f"symbol string, block int, m {doubles}, logs {doubles}")
        return made.join(now.select("symbol", "pi"), "symbol").groupBy("symbol").applyInPandas(entries, f"symbol string, block int, before {doubles}, after {doubles}, total {doubles}")

    done = None
    for _ in range(rounds):
        known = rows.select("symbol", "block", "i", "x").join(state, "symbol").join(entered(state), one)
        parts = known.groupBy(*one).applyInPandas(sums, f"symbol string, block int, total {doubles}, " + ", ".join(f"{c} {doubles}" for c in SUMS))
        after = stored(parts.join(state, "symbol").groupBy("symbol").applyInPandas(advance, STATE), "hidden-state")
        ended = after.where(F.size("open") == 0)
        done = ended if done is None else done.unionByName(ended)
        state = after.where(F.size("open") > 0)
        if state.isEmpty():
            break
    else:
        done = done.unionByName(state)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row, total = pdf.iloc[0], np.array(pdf["total"].iat[0])
        s = int(total.argmax())
        model = dict(zip(("pi", "a", "mean", "cov"), (v[s] for v in _shaped(row, k, width, starts)), strict=True))
        return pd.DataFrame([{"symbol": row["symbol"], "k": k, "width": width, "log_likelihood": float(total[s])} | _flat(model)])[[c.split()[0] for c in MODEL.split(", ")]]

    final = done.join(entered(done).where("block = 0").select("symbol", "total"), "symbol")
    return stored(final.groupBy("symbol").applyInPandas(choose, MODEL), "hidden-models")


def decoded(known: DataFrame, models: DataFrame, block: int) -> DataFrame:
    """Most likely regime of each bar: block tables of best scores, the path's state at each block's end, then the blocks' own paths."""
    one = ["symbol", "block"]
    slim = known.select("symbol", "block", "i", "pos", "x").join(models.select("symbol", "k", "width", "pi", "a", "mean", "cov"), "symbol")

    def opened(pdf: pd.DataFrame):
        pdf = pdf.sort_values("i")
        row = pdf.iloc[0]
        pi, a, mean, cov = _shaped(row, int(row["k"]), int(row["width"]))
        return pdf, row, np.log(pi[0] + TINY), a[0], log_densities(_matrix(pdf["x"]), mean, cov)[:, 0]

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row, _, a, e = opened(pdf)
        return pd.DataFrame([{"symbol": row["symbol"], "block": row["block"], "m": best_moves(e, a, int(row["block"]) == 0).ravel().tolist()}])

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        k = int(pdf["k"].iat[0])
        m, before = _matrix(pdf["m"]).reshape(-1, k, k), []
        score = np.log(np.array(pdf["pi"].iat[0]) + TINY)
        for c in range(len(m)):
            before.append(score)
            score = (score[:, None] + m[c]).max(axis=0)
        last = np.empty(len(m), dtype=int)
        last[-1] = score.argmax()
        for c in range(len(m) - 1, 0, -1):
            last[c - 1] = (before[c] + m[c][:, last[c]]).argmax()
        return pd.DataFrame({"symbol": pdf["symbol"], "block": pdf["block"], "before": [b.tolist() for b in before], "last": last})

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, row, _, a, e = opened(pdf)
        found = viterbi(e, a, np.array(row["before"]), int(row["block"]) == 0, int(row["last"]))
        return pd.DataFrame({"symbol": pdf["symbol"], "pos": pdf["pos"], "regime": found})

    tables = slim.groupBy(*one).applyInPandas(table, "symbol string, block int, m array<double>")
    ends_ = tables.join(models.select("symbol", "k", "pi"), "symbol").groupBy("symbol").applyInPandas(turns, "symbol string, block int, before array<double>, last int")
    return slim.join(ends_, one).groupBy(*one).applyInPandas(path, "symbol string, pos int, regime int")


def hidden_models(df: DataFrame, columns: list[str], k: int = 3, starts: int = 10, rounds: int = 200, seed: int = 7, covariance: str = "diag", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Models (symbol, k, width, pi, a, mean, cov, log_likelihood; arrays row by
    row, in the units of ``columns``) and regimes (symbol, pos, regime).

    The best of ``starts`` Baum-Welch fits, with diagonal or ``full``
    covariances. Bars with a null, NaN or infinite emission have no regime; a symbol with fewer
    than 2 k other bars has no model.
    """
    if covariance not in ("diag", "full") or k < 1 or starts < 1:
        raise ValueError("bad options of a hidden Markov model")
    known = stored(_known(df, columns, block), "hidden-rows")
    models = stored(fitted_models(known, len(columns), k, starts, rounds, seed, covariance == "full", block), "hidden-models")
    units = known.groupBy("symbol").agg(F.any_value("m").alias("m"), F.any_value("s").alias("s"))
    w = len(columns)
    spread = lambda j: F.col("s")[j] + 1e-12
    mean = [F.col("mean")[i * w + j] * spread(j) + F.col("m")[j] for i in range(k) for j in range(w)]
    cov = [F.col("cov")[(i * w + j) * w + q] * spread(j) * spread(q) for i in range(k) for j in range(w) for q in range(w)]
    told = models.join(units, "symbol").withColumns({"mean": F.array(*mean), "cov": F.array(*cov)}).drop("m", "s")
    return told, decoded(known, models, block)


def hidden_regimes(df: DataFrame, columns: list[str], k: int = 3, starts: int = 10, rounds: int = 200, seed: int = 7, covariance: str = "diag", block: int = BLOCK) -> DataFrame:
    """Regime of every bar with known emissions: (symbol, pos, regime); a symbol with too few gets none."""
    return hidden_models(df, columns, k, starts, rounds, seed, covariance, block)[1]


def model_covariances(models: DataFrame, columns: list[str]) -> DataFrame:
    """The fitted models' covariances, long: (symbol, regime, a, b, covariance)."""
    w = len(columns)
    names = F.array(*[F.lit(c) for c in columns])
    cells = models.select("symbol", F.posexplode("cov").alias("at", "covariance"))
    return cells.select(
        "symbol",
        F.floor(F.col("at") / (w * w)).cast("int").alias("regime"),
        F.get(names, (F.floor(F.col("at") / w) % w).cast("int")).alias("a"),
        F.get(names, (F.col("at") % w).cast("int")).alias("b"),
        "covariance",
    )
