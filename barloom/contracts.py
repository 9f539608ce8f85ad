"""Constants and small dimension tables shared by every operator."""

from __future__ import annotations

from itertools import product

EPS = 1e-9

# --- fixed values: they must equal the published settings for results to match -------------------

PROFILES = {
    "FAST_SWING": {
        "lookahead": [10, 20],
        "tp": [0.05, 0.08],
        "sl": [-0.04, -0.05],
        "threshold": [0.50, 0.55, 0.60, 0.65, 0.70],
        "max_avg_holding_days": 15.0,
        "max_timeout_rate": 0.40,
    },
    "SWING": {
        "lookahead": [20, 30, 40],
        "tp": [0.08, 0.10],
        "sl": [-0.05, -0.07],
        "threshold": [0.50, 0.55, 0.60, 0.65, 0.70],
        "max_avg_holding_days": 25.0,
        "max_timeout_rate": 0.45,
    },
    "POSITION": {
        "lookahead": [40, 50, 60],
        "tp": [0.10, 0.15],
        "sl": [-0.07, -0.08, -0.10],
        "threshold": [0.50, 0.55, 0.60, 0.65, 0.70],
        "max_avg_holding_days": 40.0,
        "max_timeout_rate": 0.50,
    },
}

# the oldest, profile-free grid
GLOBAL_GRID = {
    "lookahead": [10, 20, 30, 40, 50, 60],
    "tp": [0.05, 0.08, 0.10, 0.15],
    "sl": [-0.04, -0.05, -0.07, -0.08, -0.10],
    "threshold": [0.60, 0.65, 0.70],
}

CV_SPLITS = 3
TRAIN_RATIO = 0.80
MIN_MERGED_ROWS = 100
MIN_LABELED_ROWS = 100
MIN_PERIOD_ROWS = 250
MIN_TRADES = 5
MIN_VALID_FOLDS = 1
MIN_PRECISION = 0.50
MIN_EXCESS_PRECISION = 0.00
MIN_AVG_RETURN = -0.02

EXPECTANCY_SCALE = 30.0
PRECISION_STD_WEIGHT = 0.30
TIMEOUT_WEIGHT = 0.10
HOLDING_WEIGHT = 0.05
TRADE_BONUS_CAP = 50
TRADE_BONUS = 0.001

STRONG_WATCH = 0.75
WEAK_SIGNAL = 0.55
MAX_HALF_KELLY_PCT = 10.0

GBT_TREES = 150
GBT_DEPTH = 4
GBT_STEP = 0.05
GBT_SEED = 42

QUARTER_LAG_DAYS = 45
Q4_LAG_DAYS = 90

PERIODS = [
    ("P1_2014_2018", "2014-01-01", "2018-12-31"),
    ("P2_2019_2021", "2019-01-01", "2021-12-31"),
    ("P3_2022_2023", "2022-01-01", "2023-12-31"),
    ("P4_2024_2026", "2024-01-01", "2026-12-31"),
]

# --------------------------------------------------------------------------------------------------


def grid_rows(name: str, spec: dict) -> list[dict]:
    """One profile as setup rows, numbered in lookahead, tp, sl, threshold order."""
    combos = product(spec["lookahead"], spec["tp"], spec["sl"], spec["threshold"])
    return [
        {
            "Profile": name,
            "LOOKAHEAD": lookahead,
            "TP": tp,
            "SL": sl,
            "THRESH": threshold,
            "Grid_Ordinal": ordinal,
            "Max_Avg_Holding_Days": float(spec.get("max_avg_holding_days", lookahead)),
            "Max_Timeout_Rate": float(spec.get("max_timeout_rate", 1.0)),
        }
        for ordinal, (lookahead, tp, sl, threshold) in enumerate(combos, start=1)
    ]


def profile_setups(profiles: dict | None = None) -> list[dict]:
    return [row for name, spec in (profiles or PROFILES).items() for row in grid_rows(name, spec)]
