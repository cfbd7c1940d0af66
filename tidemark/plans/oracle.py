"""Reference SQL (DuckDB): common table expressions that the queries' SQL builds on."""

from __future__ import annotations

BARS = """
daily AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS m,
         max(o_totalprice) AS mx, min(o_totalprice) AS mn, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL
), walk AS (
  SELECT *, round(100 * exp(sum((m - 252500) / 252500 * 0.02 * sqrt(volume)) OVER (PARTITION BY symbol ORDER BY date)), 4) AS close
  FROM daily
), opened AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 100.0) AS open FROM walk
), bars AS (
  SELECT symbol, date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS pos, open,
         round(greatest(open, close) * (1 + 0.005 * mx / 500000), 4) AS high,
         round(least(open, close) * (1 - 0.005 * (1 - mn / 500000)), 4) AS low, close, volume
  FROM opened
)"""

INDICATORS = """
moved AS (
  SELECT *, close - lag(close) OVER w AS mv, lag(close) OVER w AS pc,
         close / lag(close, 1) OVER w - 1 AS return_1d, close / lag(close, 5) OVER w - 1 AS return_5d,
         close / lag(close, 10) OVER w - 1 AS return_10d
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)
), ranged AS (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, greatest(mv, 0) AS gain, greatest(-mv, 0) AS loss,
         CASE WHEN pos = 0 THEN close ELSE 2.0 / 21 * close END * pow(19.0 / 21, -pos) AS wx
  FROM (SELECT * REPLACE (coalesce(pc, NULL) AS pc) FROM moved)
), rolled AS (
  SELECT *, CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_20,
         CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_50,
         CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS sma_200,
         CASE WHEN pos >= 19 THEN pow(19.0 / 21, pos) * sum(wx) OVER (PARTITION BY symbol ORDER BY pos) END AS ema_20,
         CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr_14,
         CASE WHEN count(mv) OVER w14 = 14 THEN
           CASE WHEN avg(gain) OVER w14 = 0 THEN 0.0 WHEN avg(loss) OVER w14 = 0 THEN 100.0
                ELSE 100 - 100 / (1 + (avg(gain) OVER w14) / (avg(loss) OVER w14)) END END AS rsi_14,
         CASE WHEN count(close) OVER w20 = 20 THEN 4 * (stddev_samp(close) OVER w20) / nullif(avg(close) OVER w20, 0) END AS bb_width_20,
         CASE WHEN count(return_1d) OVER w20 = 20 THEN (stddev_samp(return_1d) OVER w20) * sqrt(252) END AS realized_vol_20,
         CASE WHEN count(volume) OVER w20 = 20 THEN (volume - avg(volume) OVER w20) / nullif(stddev_samp(volume) OVER w20, 0) END AS volume_zscore_20
  FROM ranged
  WINDOW w14 AS (PARTITION BY symbol ORDER BY pos ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING),
         w50 AS (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING), w200 AS (PARTITION BY symbol ORDER BY pos ROWS 199 PRECEDING)
), ind AS (
  SELECT *, (close - sma_20) / nullif(atr_14, 0) AS dist_to_sma_20, (close - sma_50) / nullif(atr_14, 0) AS dist_to_sma_50,
         (close - sma_200) / nullif(atr_14, 0) AS dist_to_sma_200
  FROM rolled
)"""

LABELLED = """
lv0 AS (
  SELECT *, CASE WHEN count(high) OVER w = 126 THEN max(high) OVER w END AS nearest_resistance,
         CASE WHEN count(low) OVER w = 126 THEN min(low) OVER w END AS nearest_support
  FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT *, nearest_resistance - 0.5 * atr_14 AS resistance_zone_low, nearest_resistance + 0.5 * atr_14 AS resistance_zone_high,
         nearest_support - 0.5 * atr_14 AS support_zone_low, nearest_support + 0.5 * atr_14 AS support_zone_high,
         (nearest_resistance - close) / nullif(atr_14, 0) AS dist_to_resistance_atr,
         (close - nearest_support) / nullif(atr_14, 0) AS dist_to_support_atr
  FROM lv0
), st0 AS (
  SELECT *, coalesce(max(CASE WHEN close > resistance_zone_high THEN 1 ELSE 0 END)
                     OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) = 1 AS recent,
         coalesce(lag(close < support_zone_low) OVER (PARTITION BY symbol ORDER BY pos), false) AS was_below
  FROM lv
), lab AS (
  SELECT *, CAST(CASE
    WHEN close IS NULL OR sma_20 IS NULL OR sma_50 IS NULL OR atr_14 IS NULL OR bb_width_20 IS NULL OR nearest_support IS NULL
      OR nearest_resistance IS NULL OR support_zone_low IS NULL OR support_zone_high IS NULL OR resistance_zone_low IS NULL
      OR resistance_zone_high IS NULL OR dist_to_support_atr IS NULL OR dist_to_resistance_atr IS NULL THEN 11
    WHEN close < support_zone_low THEN 4
    WHEN was_below THEN 3
    WHEN recent AND close < resistance_zone_low THEN 9
    WHEN recent AND close BETWEEN resistance_zone_low AND resistance_zone_high THEN 8
    WHEN recent AND close > resistance_zone_high AND close > sma_20 AND sma_20 >= sma_50 THEN 10
    WHEN close > resistance_zone_high THEN 7
    WHEN close BETWEEN support_zone_low AND support_zone_high THEN 2
    WHEN close < resistance_zone_low AND dist_to_resistance_atr BETWEEN 0 AND 1 AND bb_width_20 <= 0.06 THEN 6
    WHEN dist_to_resistance_atr BETWEEN 0 AND 1 THEN 5
    WHEN dist_to_support_atr BETWEEN 0 AND 1 THEN 1
    ELSE 0 END AS INTEGER) AS state
  FROM st0
)"""

VOL = """
volr AS (
  SELECT *, list(realized_vol_20) FILTER (realized_vol_20 IS NOT NULL) OVER (PARTITION BY symbol ORDER BY pos ROWS 62 PRECEDING) AS seen,
         realized_vol_20 / nullif(lag(realized_vol_20, 21) OVER (PARTITION BY symbol ORDER BY pos), 0) - 1 AS change
  FROM lab
), volk AS (
  SELECT *, CASE WHEN len(seen) = 63 AND realized_vol_20 IS NOT NULL THEN
           (len(list_filter(seen, lambda x: x < realized_vol_20)) + (len(list_filter(seen, lambda x: x = realized_vol_20)) + 1) / 2.0) / 63 END AS vol_rank
  FROM volr
), vol AS (
  SELECT *, CAST(CASE WHEN vol_rank IS NULL THEN 1 WHEN change >= 0.25 THEN 4 WHEN change <= -0.25 THEN 3
                      WHEN vol_rank >= 2.0 / 3 THEN 2 WHEN vol_rank <= 1.0 / 3 THEN 0 ELSE 1 END AS INTEGER) AS vol_state
  FROM volk
)"""

#: Forward returns by horizon of labelled bars.
FORWARD = """
fwd AS (
  SELECT symbol, pos, date, close, state, h AS horizon, r FROM (
    SELECT symbol, pos, date, close, state, unnest([1, 5, 10, 20]) AS h,
           unnest([lead(close, 1) OVER w / close - 1, lead(close, 5) OVER w / close - 1,
                   lead(close, 10) OVER w / close - 1, lead(close, 20) OVER w / close - 1]) AS r
    FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY pos)
  ) WHERE r IS NOT NULL
)"""

WALKFORWARD = """
wf0 AS (
  SELECT symbol, date, pos, close, state, lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS r FROM lab
), wf1 AS (
  SELECT *, count(r) OVER w AS train_count, avg(r) OVER w AS train_mean FROM wf0
  WINDOW w AS (PARTITION BY symbol, state ORDER BY pos RANGE BETWEEN 257 PRECEDING AND 6 PRECEDING)
), wf AS (
  SELECT symbol, date, pos, close, state, train_count,
         CASE WHEN train_count >= 5 THEN train_mean - 0.0005 END AS ev_after_cost
  FROM wf1 WHERE pos >= 10
)"""


def selected(name: str, source: str, horizon: int = 5) -> str:
    """CTEs that pick non-overlapping signals (symbol, pos) of ``source`` one after another, as ``name``."""
    return f"""
{name}_s AS (
  SELECT symbol, pos, min(pos) OVER (PARTITION BY symbol ORDER BY pos RANGE BETWEEN {horizon + 2} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {source}
), {name} AS (
  SELECT symbol, min(pos) AS pos FROM {name}_s GROUP BY symbol
  UNION ALL SELECT s.symbol, s.nxt FROM {name} p JOIN {name}_s s ON s.symbol = p.symbol AND s.pos = p.pos WHERE s.nxt IS NOT NULL
)"""


def performance(prefix: str, source: str, trades: str, horizon: int = 5) -> str:
    """CTEs from ``trades`` (symbol, pos, net) and bars ``source``: {prefix}_eq and {prefix}_stats."""
    return f"""
{prefix}_eq AS (
  SELECT b.symbol, b.date, b.pos, coalesce(product(1 + t.net) OVER (PARTITION BY b.symbol ORDER BY b.pos), 1.0) AS equity
  FROM {source} b LEFT JOIN {trades} t ON b.symbol = t.symbol AND b.pos = t.pos + {horizon + 1}
), {prefix}_r AS (
  SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS r,
         equity / max(equity) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS d FROM {prefix}_eq
), {prefix}_b AS (
  SELECT symbol, max_by(equity, pos) - 1 AS total_return, min(d) AS max_drawdown,
         CASE WHEN stddev_pop(r) > 1e-8 THEN avg(r) / stddev_pop(r) * sqrt(252) END AS sharpe, count(*) AS bars
  FROM {prefix}_r GROUP BY symbol
), {prefix}_t AS (
  SELECT symbol, count(*) AS n, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(net) FILTER (net > 0) AS avg_win,
         avg(net) FILTER (net < 0) AS avg_loss
  FROM {trades} GROUP BY symbol
), {prefix}_stats AS (
  SELECT b.symbol, round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(sharpe, 6) AS sharpe,
         CAST(coalesce(n, 0) AS BIGINT) AS trade_count, round(win_rate, 6) AS win_rate, round(avg_win, 6) AS avg_win,
         round(avg_loss, 6) AS avg_loss, round({horizon} * coalesce(n, 0) / bars, 6) AS exposure_time
  FROM {prefix}_b b LEFT JOIN {prefix}_t t ON b.symbol = t.symbol
)"""


TRADED = (
    selected("sel", "(SELECT symbol, pos FROM (SELECT *, lead(close, 6) OVER (PARTITION BY symbol ORDER BY pos) AS x FROM wf_all) WHERE ev_after_cost > 0 AND x IS NOT NULL)")
    + """,
trd AS (
  SELECT l.symbol, l.pos, l.date, p.entry_date, p.exit_date, p.entry_price, p.exit_price,
         p.exit_price / p.entry_price - 1 AS gross, p.exit_price / p.entry_price - 1 - 0.0005 AS net
  FROM sel l0 JOIN lab l ON l.symbol = l0.symbol AND l.pos = l0.pos
  JOIN (SELECT symbol, pos, lead(date, 1) OVER w AS entry_date, lead(date, 6) OVER w AS exit_date,
               lead(close, 1) OVER w AS entry_price, lead(close, 6) OVER w AS exit_price
        FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY pos)) p ON p.symbol = l.symbol AND p.pos = l.pos
)"""
)
WF_ALL = """
wf_all AS (SELECT l.symbol, l.date, l.pos, l.close, wf.ev_after_cost FROM lab l LEFT JOIN wf ON l.symbol = wf.symbol AND l.pos = wf.pos)"""

PAIRS = """
known AS (SELECT symbol, pos, state, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS k FROM lab WHERE state IS NOT NULL),
pairs AS (
  SELECT * FROM (SELECT symbol, k, pos, state AS src, lead(state) OVER (PARTITION BY symbol ORDER BY pos) AS dst FROM known) WHERE dst IS NOT NULL
)"""

MATRIX = """
cells AS (SELECT symbol, src, dst, count(*) AS n FROM pairs GROUP BY ALL),
grid AS (
  SELECT s.symbol, CAST(a.a AS INTEGER) AS src, CAST(b.b AS INTEGER) AS dst
  FROM (SELECT DISTINCT symbol FROM pairs) s, range(12) a(a), range(12) b(b)
), mat AS (
  SELECT g.symbol, g.src, g.dst, coalesce(n, 0) AS n,
         coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g.symbol, g.src), 0),
                  CASE WHEN g.src = g.dst THEN 1.0 ELSE 0.0 END) AS p
  FROM grid g LEFT JOIN cells c ON g.symbol = c.symbol AND g.src = c.src AND g.dst = c.dst
)"""


def grid_stats(horizons=(5, 10), lookbacks=(126, 252), costs=(5.0, 10.0), minima=(5, 10)) -> str:
    """CTEs of the parameter grid's statistics, as ``grid_stats``: a backtest for each combination, whose
    key ("symbol|horizon|lookback|cost|minimum") stands in for the symbol."""
    parts, unions = [], []
    for h in horizons:
        values = [
            f"""SELECT symbol || '|{h}|{k}|{c}|{m}' AS symbol, date, pos, close,
                CASE WHEN pos >= {h + m} AND n{k} >= {m} THEN a{k} - {c / 1e4} END AS ev FROM gw{h}"""
            for k in lookbacks for c in costs for m in minima
        ]
        windows = ", ".join(
            f"count(r) OVER w{k} AS n{k}, avg(r) OVER w{k} AS a{k}" for k in lookbacks
        )
        frames = ", ".join(
            f"w{k} AS (PARTITION BY symbol, state ORDER BY pos RANGE BETWEEN {h + k} PRECEDING AND {h + 1} PRECEDING)" for k in lookbacks
        )
        parts.append(
            f"""gr{h} AS (SELECT symbol, date, pos, close, state, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY pos) / close - 1 AS r FROM lab),
            gw{h} AS (SELECT *, {windows} FROM gr{h} WINDOW {frames}),
            gb{h} AS ({" UNION ALL ".join(values)}),
            gx{h} AS (SELECT *, lead(close, 1) OVER (PARTITION BY symbol ORDER BY pos) AS a, lead(close, {h + 1}) OVER (PARTITION BY symbol ORDER BY pos) AS b FROM gb{h}),"""
            + selected(f"gs{h}", f"(SELECT symbol, pos FROM gx{h} WHERE ev > 0 AND b IS NOT NULL)", h)
            + f""", gt{h} AS (
              SELECT s.symbol, s.pos, x.b / x.a - 1 - CAST(split_part(s.symbol, '|', 4) AS DOUBLE) / 1e4 AS net FROM gs{h} s JOIN gx{h} x ON x.symbol = s.symbol AND x.pos = s.pos),"""
            + performance(f"gp{h}", f"gb{h}", f"gt{h}", h)
        )
        unions.append(f"SELECT * FROM gp{h}_stats")
    parts.append(
        f"""grid_stats AS (
          SELECT split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS INTEGER) AS horizon, CAST(split_part(symbol, '|', 3) AS INTEGER) AS lookback,
                 CAST(split_part(symbol, '|', 4) AS DOUBLE) AS cost_bps, CAST(split_part(symbol, '|', 5) AS INTEGER) AS min_samples, * EXCLUDE (symbol)
          FROM ({" UNION ALL ".join(unions)}))"""
    )
    return ", ".join(parts)


#: Transition probabilities of each anchor (symbol, k): m, from the pairs that end among the 252 bars before; unseen rows are the identity's.
STEPS = """
cells AS (
  SELECT q.symbol, q.k, p.src, p.dst, count(*) AS n FROM asked q JOIN pairs p ON p.symbol = q.symbol AND p.k >= q.a AND p.k <= q.b - 2 GROUP BY ALL
), seen AS (SELECT symbol, k, src, dst, n / sum(n) OVER (PARTITION BY symbol, k, src) AS p FROM cells),
m AS (
  SELECT * FROM seen
  UNION ALL SELECT q.symbol, q.k, CAST(s.s AS INTEGER), CAST(s.s AS INTEGER), 1.0 FROM asked q, range(12) s(s)
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.symbol = q.symbol AND c.k = q.k AND c.src = s.s)
), steps AS (
  SELECT symbol, k, 0 AS step, state AS dst, CAST(1 AS DOUBLE) AS p FROM asked
  UNION ALL SELECT v.symbol, v.k, v.step + 1, m.dst, sum(v.p * m.p) FROM steps v JOIN m ON m.symbol = v.symbol AND m.k = v.k AND m.src = v.dst
  WHERE v.step < {steps} GROUP BY v.symbol, v.k, v.step, m.dst
)"""


def query(body: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)}\n{body}"
