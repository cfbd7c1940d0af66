"""Fixed values of the state model."""

from __future__ import annotations

# The twelve states, regimes, horizons and cost defaults.
STATE_LABELS = {
    0: "FAR_FROM_LEVEL",
    1: "APPROACHING_SUPPORT",
    2: "TOUCHING_SUPPORT",
    3: "SUPPORT_RECLAIM",
    4: "SUPPORT_BREAKDOWN",
    5: "APPROACHING_RESISTANCE",
    6: "COMPRESSION_BELOW_RESISTANCE",
    7: "RESISTANCE_BREAKOUT",
    8: "BREAKOUT_RETEST",
    9: "FAILED_BREAKOUT",
    10: "CONTINUATION",
    11: "CHOP_OR_NO_EDGE",
}
VOL_LABELS = {0: "LOW_VOL", 1: "NORMAL_VOL", 2: "HIGH_VOL", 3: "VOL_COMPRESSION", 4: "VOL_EXPANSION"}
MACRO_LABELS = {0: "RISK_ON", 1: "RISK_OFF", 2: "NEUTRAL"}
N_STATES = 12
HORIZONS = (1, 5, 10, 20)
COST_BPS = 5.0
LOOKBACK = 252
ALPHA = 1e-6
LIQUIDITY_COST_BPS = {"NORMAL_LIQUIDITY": 5.0, "THIN_LIQUIDITY": 12.0, "STRESSED_LIQUIDITY": 30.0, "PANIC_LIQUIDITY": 80.0}
# What hidden regimes are fitted on, and the symbol lists.
EMISSION_COLUMNS = ("return_1d", "realized_vol_20", "atr_14", "volume_zscore_20", "dist_to_support_atr", "dist_to_resistance_atr")
ALL_SYMBOLS = "SPY QQQ IWM DIA XLK SMH XLE XLF XLI XLU XLV GLD SLV TLT UUP".split()
FIRST_SYMBOLS = "SPY QQQ IWM XLK SMH XLE XLF GLD TLT".split()
# Event days of 2024 to 2026.
EVENT_DATES = {
    # US consumer price index releases
    "CPI": """
        2024-01-11 2024-02-13 2024-03-12 2024-04-10 2024-05-15 2024-06-12
        2024-07-11 2024-08-14 2024-09-11 2024-10-10 2024-11-13 2024-12-11
        2025-01-15 2025-02-12 2025-03-12 2025-04-10 2025-05-13 2025-06-11
        2025-07-15 2025-08-12 2025-09-10 2025-10-15 2025-11-13 2025-12-10
        2026-01-14 2026-02-11 2026-03-11 2026-04-15 2026-05-13 2026-06-10
        2026-07-14 2026-08-12 2026-09-09 2026-10-14 2026-11-12 2026-12-09
    """.split(),
    # last days of Federal Open Market Committee meetings
    "FOMC": """
        2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
        2025-01-29 2025-03-19 2025-05-07 2025-06-18 2025-07-30 2025-09-17 2025-11-05 2025-12-17
        2026-01-28 2026-03-18 2026-04-29 2026-06-17 2026-07-29 2026-09-16 2026-11-04 2026-12-16
    """.split(),
}
