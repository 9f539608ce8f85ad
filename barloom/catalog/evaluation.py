"""Registered queries: labels, folds, trade statistics, setup search.

Model probabilities are stood in for by deterministic columns in [0, 1]: RSI/100 for the baseline
set, distance from the 60-day high for the recovery set, efficiency ratio for the trend-recovery
set, a tenth of it for a set that never trades. Everything after the probability is the same either way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.catalog.base import JOINED, bars, ewm_cte, feature_frame, index_bars, query, returns_sql, roll
from barloom.operators import evaluate as E
from barloom.operators.labels import (
    add_paths, complete_rows, explode_labels, holdout_side, label_frame, label_setups, latest_complete, training_rows,
)
from barloom.operators.windows import Series
from barloom.plans import search
from barloom.plans.walkforward import period_features

NEEDED = ["Log_Return", "RSI_14", "Drawdown_60", "ER_10"]
WIDE = {
    "lookahead": [5, 10], "tp": [0.60, 1.50], "sl": [-0.40, -0.70],
    "threshold": [0.50, 0.55, 0.60, 0.65, 0.70], "max_avg_holding_days": 15.0, "max_timeout_rate": 0.40,
}
#: a near target and a far stop, so that setups pass every gate of the diagnostics
EASY = {
    "lookahead": [20], "tp": [0.02, 0.05], "sl": [-0.90], "threshold": [0.50, 0.60], "max_avg_holding_days": 15.0, "max_timeout_rate": 0.40,
}
SETUPS = K.profile_setups({**K.PROFILES, "WIDE": WIDE, "EASY": EASY})
GLOBAL = K.grid_rows("GLOBAL", K.GLOBAL_GRID)
FIXED = [s for s in SETUPS if s["Profile"] == "SWING" and s["LOOKAHEAD"] == 20 and s["TP"] == 0.10
         and s["SL"] == -0.07 and s["THRESH"] == 0.50]
GRID = K.grid_rows("SWING", {**K.PROFILES["SWING"], "threshold": [0.55, 0.60, 0.65, 0.70]})
PERIODS = [
    ("P1", "1995-01-01", "1996-12-31"),
    ("P2", "1997-01-01", "1998-12-31"),
    ("P3", "1999-01-01", "2000-06-30"),
    ("P4", "2000-07-01", "2001-12-31"),
]
#: the second has too few bars for a hundred labels, the third for any
SHORT_PERIODS = [("Q1", "1995-01-01", "1995-11-30"), ("Q2", "1996-01-01", "1996-05-10"), ("Q3", "1997-01-01", "1997-04-10")]
SHORT_ROWS = 60
KEYS = ["ticker"]


def scores():
    return {
        "baseline": F.col("RSI_14") / 100,
        "candidate_recovery_v1": F.col("Drawdown_60") + 1,
        "candidate_trend_recovery_v1": F.col("ER_10"),
        # never reaches a threshold
        "candidate_quiet_v1": F.col("ER_10") / 10,
    }


def one_score():
    return {"baseline": F.col("RSI_14") / 100}


def contrarian_score():
    """High after falls, so that in a series that returns to its mean setups beat the base rate."""
    return {"baseline": 1 - F.col("RSI_14") / 100}


def complete():
    return complete_rows(NEEDED)


def frame(spark, sf_dir):
    return feature_frame(spark, sf_dir, columns=NEEDED)


def periods_frame(spark, sf_dir, periods=PERIODS, min_rows=K.MIN_PERIOD_ROWS):
    return period_features(bars(spark, sf_dir), index_bars(spark, sf_dir), periods, NEEDED, min_rows)


def metrics(spark, sf_dir, setups=SETUPS, scored=one_score):
    return search.grid_metrics(frame(spark, sf_dir), KEYS, setups, complete(), scored())


# ---- SQL side ------------------------------------------------------------------------------------



def period_joined(periods: list[tuple[str, str, str]], min_rows: int = 250) -> str:
    rows = ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in periods)
    return f"""{JOINED.split(', j AS MATERIALIZED')[0]}, periods(label, lo, hi) AS (VALUES {rows}),
in_period AS (SELECT b.* REPLACE (b.ticker || '|' || label AS ticker), label,
    count(*) OVER (PARTITION BY b.ticker, label) AS n_rows
  FROM bars b JOIN periods ON b.date BETWEEN lo AND hi),
index_count AS (SELECT label FROM index_bars JOIN periods ON date BETWEEN lo AND hi GROUP BY 1 HAVING count(*) >= {min_rows}),
j AS MATERIALIZED (SELECT b.* EXCLUDE (label, n_rows), i.vn_close,
    row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS rn
  FROM in_period b JOIN index_bars i ON b.date = i.date
  WHERE n_rows >= {min_rows} AND label IN (SELECT label FROM index_count))"""


PERIOD_JOINED = period_joined(PERIODS)


def frame_sql(joined: str = JOINED) -> str:
    return f"""{returns_sql(joined)}, {ewm_cte('e', {'g': ('gain', 1 / 14), 'l': ('loss', 1 / 14)})},
f0 AS (SELECT ticker, date, rn, close, count(*) OVER (PARTITION BY ticker) AS n,
    (100 - 100 / (1 + g / (l + 1e-9))) / 100 AS s1,
    close / ({roll('max', 'close', 60)} + 1e-9) - 1 + 1 AS s2,
    abs(close - c10) / ({roll('sum', 'step', 10)} + 1e-9) AS s3
  FROM ret JOIN e USING (ticker, rn)),
f AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN rn >= 60 THEN 1 ELSE 0 END) OVER
    (PARTITION BY ticker ORDER BY rn) AS bigint) - 1 AS rank FROM f0)"""


def labels_sql(grid: list[tuple[int, float, float]], joined: str = JOINED, every_row: bool = False) -> str:
    tps, sls = sorted({g[1] for g in grid}), sorted({g[2] for g in grid})
    rows = ", ".join(f"({la}, {tp}, {sl}, {tps.index(tp) + 1}, {sls.index(sl) + 1})" for la, tp, sl in grid)
    tp_hits = ", ".join(f"min(j) FILTER (m >= {tp!r}::double)" for tp in tps)
    sl_hits = ", ".join(f"min(j) FILTER (m <= {sl!r}::double)" for sl in sls)
    keep = "" if every_row else "AND rn >= 60"
    return f"""{frame_sql(joined)}, moves AS MATERIALIZED (
  SELECT a.ticker, a.rn, b.rn - a.rn AS j, (b.close - a.close) / a.close AS m
  FROM f a JOIN f b ON a.ticker = b.ticker AND b.rn > a.rn AND b.rn <= a.rn + {max(g[0] for g in grid)}),
hits AS (SELECT ticker, rn, [{tp_hits}] AS tps, [{sl_hits}] AS sls FROM moves GROUP BY 1, 2),
setups(la, tp, sl, ti, si) AS (VALUES {rows}),
exits AS (SELECT f.*, la, tp::double AS tp, sl::double AS sl, CASE WHEN tps[ti] <= la THEN tps[ti] END AS tp_at,
    CASE WHEN sls[si] <= la THEN sls[si] END AS sl_at
  FROM f JOIN hits USING (ticker, rn) CROSS JOIN setups WHERE rn + la <= n {keep}),
held AS (SELECT *, CASE WHEN sl_at IS NOT NULL AND (tp_at IS NULL OR sl_at <= tp_at) THEN 'sl'
      WHEN tp_at IS NOT NULL THEN 'tp' ELSE 'timeout' END AS reason,
    CASE WHEN sl_at IS NULL AND tp_at IS NULL THEN la WHEN sl_at IS NULL THEN tp_at
      WHEN tp_at IS NULL THEN sl_at WHEN sl_at < tp_at THEN sl_at ELSE tp_at END AS hold FROM exits),
lab0 AS (SELECT held.*, m AS ret, count(*) OVER (PARTITION BY held.ticker, la, tp, sl) AS size
  FROM held JOIN moves ON moves.ticker = held.ticker AND moves.rn = held.rn AND j = hold),
lab AS MATERIALIZED (SELECT *, CASE WHEN rank < size - 3 * (size // 4) THEN 0
    ELSE 1 + (rank - (size - 3 * (size // 4))) // (size // 4) END AS segment FROM lab0)"""


def folds_sql(
    setups: list[dict], sets: dict[str, str], joined: str = JOINED
) -> str:
    thresholds = ", ".join(f"({t}::double)" for t in sorted({s["THRESH"] for s in setups}))
    scored = " UNION ALL ".join(f"SELECT *, '{name}' AS fs, {col} AS score FROM lab" for name, col in sets.items())
    return f"""{labels_sql(label_setups(setups), joined)}, scored AS ({scored}),
seg AS (SELECT ticker, fs, la, tp, sl, size, segment, count(*) AS n, sum(CASE WHEN reason = 'tp' THEN 1 ELSE 0 END) AS pos
  FROM scored WHERE size >= 100 GROUP BY ALL),
train AS (SELECT *, sum(n) OVER w AS train_n, sum(pos) OVER w AS train_pos FROM seg
  WINDOW w AS (PARTITION BY ticker, fs, la, tp, sl ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
thr(th) AS (VALUES {thresholds}),
hit AS (SELECT ticker, fs, la, tp, sl, segment, th, count(*) AS trades, sum(CASE WHEN reason = 'tp' THEN 1 ELSE 0 END) AS correct,
    sum(ret) AS ret, sum(hold) AS hold, sum(CASE WHEN reason = 'timeout' THEN 1 ELSE 0 END) AS timeouts
  FROM scored JOIN thr ON score >= th GROUP BY ALL),
fold AS MATERIALIZED (SELECT ticker, fs, la, tp, sl, size, segment, th, n, pos, train_n, train_pos,
    coalesce(trades, 0) AS trades, coalesce(correct, 0) AS correct, coalesce(ret, 0) AS ret, coalesce(hold, 0) AS hold,
    coalesce(timeouts, 0) AS timeouts
  FROM train CROSS JOIN thr LEFT JOIN hit USING (ticker, fs, la, tp, sl, segment, th)
  WHERE segment > 0 AND train_pos > 0 AND train_pos < train_n)"""


def metrics_sql(setups: list[dict], sets: dict[str, str], joined: str = JOINED) -> str:
    names = ", ".join(f"('{name}')" for name in sets)
    return f"""{folds_sql(setups, sets, joined)}, expected AS (
  SELECT ticker, fs, la, tp::double AS tp, sl::double AS sl, th
  FROM (SELECT DISTINCT ticker FROM f) s CROSS JOIN (VALUES {names}) n(fs) CROSS JOIN setups CROSS JOIN thr),
m AS MATERIALIZED (
  SELECT *, trades_n AS Trades, CASE WHEN trades_n > 0 THEN correct_n / trades_n ELSE 0 END AS Validation_Precision,
    CASE WHEN valid > 1 THEN spread WHEN trades_n > 0 THEN 0 END AS Precision_Std,
    CASE WHEN trades_n > 0 THEN pos_n / test_n END AS Base_Rate,
    correct_n / nullif(trades_n, 0) - CASE WHEN trades_n > 0 THEN pos_n / test_n END AS Excess_Precision,
    correct_n / nullif(trades_n, 0) / (CASE WHEN trades_n > 0 THEN pos_n / test_n END + 1e-9) AS Precision_Lift,
    ret_n / nullif(trades_n, 0) AS Avg_Return, hold_n / nullif(trades_n, 0) AS Avg_Holding_Days,
    out_n / nullif(trades_n, 0) AS Timeout_Rate,
    ret_n / nullif(trades_n, 0) / (hold_n / nullif(trades_n, 0) + 1e-9) AS Expectancy_Per_Day
  FROM (SELECT * REPLACE (coalesce(rows_n, 0) AS rows_n, coalesce(trades_n, 0) AS trades_n, coalesce(valid, 0) AS valid)
    FROM expected LEFT JOIN (SELECT ticker, la, tp, sl, max(size) AS rows_n FROM lab GROUP BY ALL) r USING (ticker, la, tp, sl)
    LEFT JOIN (SELECT ticker, fs, la, tp, sl, th, CAST(sum(trades) AS double) AS trades_n,
      CAST(sum(correct) AS double) AS correct_n, CAST(sum(pos) AS double) AS pos_n, CAST(sum(n) AS double) AS test_n,
      count(CASE WHEN trades > 0 THEN 1 END) AS valid, stddev_pop(CASE WHEN trades > 0 THEN correct / trades END) AS spread,
      avg(CASE WHEN trades > 0 THEN correct / trades END) AS mean_precision,
      sum(ret) AS ret_n, CAST(sum(hold) AS double) AS hold_n, CAST(sum(timeouts) AS double) AS out_n
    FROM fold GROUP BY ALL) sums USING (ticker, fs, la, tp, sl, th)) filled)"""


def setups_values(setups: list[dict]) -> str:
    rows = ", ".join(
        f"('{s['Profile']}', {s['LOOKAHEAD']}, {s['TP']}::double, {s['SL']}::double, {s['THRESH']}::double, "
        f"{s['Grid_Ordinal']}, {s['Max_Avg_Holding_Days']}::double, {s['Max_Timeout_Rate']}::double)"
        for s in setups
    )
    return f"grid(profile, la, tp, sl, th, ordinal, max_hold, max_out) AS (VALUES {rows})"


def graded_sql(
    setups: list[dict], sets: dict[str, str], joined: str = JOINED, cost: float = 0.0, min_edge: float = 0.0
) -> str:
    return f"""{metrics_sql(setups, sets, joined)}, {setups_values(setups)},
g0 AS (SELECT m.*, profile, ordinal, max_hold, max_out,
    CASE WHEN tp - {cost} <= 0 THEN 1 ELSE (abs(sl) + {cost}) / ((tp - {cost}) + (abs(sl) + {cost})) END AS be,
    Excess_Precision + Expectancy_Per_Day * 30 + least(trades_n, 50) * 0.001 - Precision_Std * 0.3
      - Timeout_Rate * 0.1 - Avg_Holding_Days / max_hold * 0.05 AS score
  FROM m JOIN grid USING (la, tp, sl, th)),
g1 AS (SELECT *, CASE WHEN trades_n > 0 THEN Validation_Precision - be END AS edge FROM g0),
g AS MATERIALIZED (SELECT *, coalesce(valid >= 1 AND trades_n >= 5 AND Excess_Precision > 0 AND edge >= {min_edge} AND Avg_Return > 0
    AND Expectancy_Per_Day > 0 AND Avg_Holding_Days <= max_hold AND Timeout_Rate <= max_out, false) AS pass FROM g1),
graded AS MATERIALIZED (SELECT *, CASE WHEN trades_n = 0 THEN 'NO_SIGNAL' WHEN pass THEN 'TRADEABLE_EDGE'
    WHEN Excess_Precision > 0 AND Avg_Return > 0 AND Expectancy_Per_Day > 0 THEN 'RESEARCH_EDGE' ELSE 'NO_EDGE' END AS status
  FROM g)"""


def best_sql(*args, **options) -> str:
    return f"""{graded_sql(*args, **options)}, best AS MATERIALIZED (SELECT * EXCLUDE (pick) REPLACE (CASE WHEN score IS NOT NULL THEN la END AS la,
    CASE WHEN score IS NOT NULL THEN tp END AS tp, CASE WHEN score IS NOT NULL THEN sl END AS sl,
    CASE WHEN score IS NOT NULL THEN th END AS th, CASE WHEN score IS NOT NULL THEN be END AS be,
    CASE WHEN score IS NOT NULL THEN rows_n ELSE 0 END AS rows_n)
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fs, profile ORDER BY round(score, 10) DESC NULLS LAST, ordinal) AS pick
    FROM graded) r WHERE pick = 1)"""


METRIC_DIGITS = {
    "Validation_Precision": 9, "Precision_Std": 9, "Base_Rate": 9, "Excess_Precision": 9, "Precision_Lift": 7,
    "Avg_Return": 8, "Avg_Holding_Days": 8, "Expectancy_Per_Day": 8, "Timeout_Rate": 9,
}
METRIC_SQL = """la AS LOOKAHEAD, tp AS TP, sl AS SL, th AS THRESH, rows_n AS "Rows", CAST(Trades AS bigint) AS Trades,
  valid AS Valid_Folds, Validation_Precision, Precision_Std, Base_Rate, Excess_Precision, Precision_Lift, Avg_Return,
  Avg_Holding_Days, Expectancy_Per_Day, Timeout_Rate"""
METRIC_COLUMNS = [
    "LOOKAHEAD", "TP", "SL", "THRESH", "Rows", "Trades", "Valid_Folds", "Validation_Precision", "Precision_Std",
    "Base_Rate", "Excess_Precision", "Precision_Lift", "Avg_Return", "Avg_Holding_Days", "Expectancy_Per_Day",
    "Timeout_Rate",
]
GRADE_SQL = METRIC_SQL + """, score AS Score, be AS Breakeven_Precision, edge AS Edge_vs_Breakeven,
  pass AS Pass_Tradeable_Rule, status AS Research_Status"""
GRADE_COLUMNS = [
    *METRIC_COLUMNS, "Score", "Breakeven_Precision", "Edge_vs_Breakeven", "Pass_Tradeable_Rule", "Research_Status",
]
GRADE_DIGITS = {**METRIC_DIGITS, "Score": 8, "Breakeven_Precision": 9, "Edge_vs_Breakeven": 9}

S1 = {"baseline": "s1"}
CONTRARIAN = {"baseline": "(1 - s1)"}
S3 = {"baseline": "s1", "candidate_recovery_v1": "s2", "candidate_trend_recovery_v1": "s3", "candidate_quiet_v1": "s3 / 10"}
LABEL_GRID = [(20, 0.60, -0.40)]
ALL_LABELS = label_setups(SETUPS)


# ---- labels --------------------------------------------------------------------------------------


def _labels(spark, sf_dir, grid):
    df = feature_frame(spark, sf_dir, columns=[])
    return explode_labels(add_paths(df, Series(KEYS), max(g[0] for g in grid)).select(
        "ticker", "date", "future"
    ), grid)


@query(
    "tp_sl_labels",
    f"""WITH RECURSIVE {labels_sql(LABEL_GRID, every_row=True)} SELECT ticker, date, la AS LOOKAHEAD, tp AS TP, sl AS SL,
  CASE WHEN reason = 'tp' THEN 1 ELSE 0 END AS Target, CAST(hold AS int) AS Holding_Days, ret AS Exit_Return,
  reason AS Exit_Reason, CASE WHEN reason = 'timeout' THEN 1 ELSE 0 END AS Timeout FROM lab""",
)
def tp_sl_labels(spark, sf_dir):
    return _labels(spark, sf_dir, LABEL_GRID)


@query(
    "binary_labels",
    f"""WITH RECURSIVE {labels_sql([(30, 0.15, -0.10)], every_row=True)}
SELECT ticker, date, CASE WHEN reason = 'tp' THEN 1 ELSE 0 END AS Target FROM lab""",
)
def binary_labels(spark, sf_dir):
    return _labels(spark, sf_dir, [(30, 0.15, -0.10)]).select("ticker", "date", "Target")


@query(
    "label_grid",
    f"""WITH RECURSIVE {labels_sql(ALL_LABELS, every_row=True)} SELECT ticker, la AS LOOKAHEAD, tp AS TP, sl AS SL,
  reason AS Exit_Reason, count(*) AS n, CAST(sum(hold) AS bigint) AS days, avg(ret) AS mean_return FROM lab GROUP BY ALL""",
    {"mean_return": 7},
)
def label_grid(spark, sf_dir):
    return _labels(spark, sf_dir, ALL_LABELS).groupBy("ticker", "LOOKAHEAD", "TP", "SL", "Exit_Reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Holding_Days").alias("days"), F.avg("Exit_Return").alias("mean_return")
    )


def _labeled(spark, sf_dir, grid, carry=()):
    return label_frame(frame(spark, sf_dir), KEYS, grid, complete(), list(carry))


@query(
    "walkforward_folds",
    f"""WITH RECURSIVE {labels_sql(LABEL_GRID)} SELECT ticker, date, rank, size AS "Rows", CAST(segment AS int) AS segment FROM lab""",
)
def walkforward_folds(spark, sf_dir):
    return _labeled(spark, sf_dir, LABEL_GRID).select("ticker", "date", "rank", "Rows", "segment")


@query(
    "holdout_split",
    f"""WITH RECURSIVE {labels_sql(LABEL_GRID)} SELECT ticker, CASE WHEN rank < floor(size * 0.8) THEN 'train' ELSE 'test' END AS side,
  count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM lab GROUP BY ALL""",
)
def holdout_split(spark, sf_dir):
    df = _labeled(spark, sf_dir, LABEL_GRID)
    return df.groupBy("ticker", holdout_side(F.col("rank"), F.col("Rows")).alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "latest_training_frame",
    f"""WITH RECURSIVE {labels_sql(LABEL_GRID)}, latest AS (SELECT ticker, max(date) FILTER (rn >= 60) AS d, max(date) AS data_date,
    max_by(close, date) FILTER (rn >= 60) AS c FROM f GROUP BY 1)
SELECT ticker, d AS Latest_Feature_Date, data_date AS Latest_Data_Date, date_diff('day', d, data_date) AS Data_Lag_Days,
  c AS Latest_Close, count(*) AS training_rows, CAST(sum(CASE WHEN reason = 'tp' THEN 1 ELSE 0 END) AS bigint) AS positives
FROM lab JOIN latest USING (ticker) WHERE date < d GROUP BY ALL""",
)
def latest_training_frame(spark, sf_dir):
    features = frame(spark, sf_dir)
    latest = latest_complete(features, KEYS, complete(), [])
    train = training_rows(label_frame(features, KEYS, LABEL_GRID, complete(), []), latest, KEYS)
    counts = train.groupBy("ticker").agg(F.count(F.lit(1)).alias("training_rows"), F.sum("Target").alias("positives"))
    return latest.join(counts, KEYS)


# ---- folds and metrics ---------------------------------------------------------------------------


@query(
    "fold_trade_stats",
    f"""WITH RECURSIVE {folds_sql(SETUPS, S1)} SELECT ticker, fs AS Feature_Set, la AS LOOKAHEAD, tp AS TP, sl AS SL, th AS THRESH,
  size AS "Rows", CAST(segment AS int) AS Fold, n AS Test_Count, CAST(pos AS bigint) AS Test_Positive,
  CAST(train_n AS bigint) AS Train_Count, CAST(train_pos AS bigint) AS Train_Positive, CAST(trades AS bigint) AS Fold_Trades,
  CAST(correct AS bigint) AS Fold_Correct, ret AS Return_Sum, CAST(hold AS bigint) AS Holding_Sum,
  CAST(timeouts AS bigint) AS Timeout_Sum FROM fold""",
    {"Return_Sum": 5},
)
def fold_trade_stats(spark, sf_dir):
    carry = [F.lit("baseline").alias("Feature_Set"), (F.col("RSI_14") / 100).alias("score")]
    labeled = _labeled(spark, sf_dir, ALL_LABELS, carry)
    return E.fold_stats(labeled, ["ticker", "Feature_Set"], sorted({s["THRESH"] for s in SETUPS}))


@query(
    "class_weights",
    f"""WITH RECURSIVE {folds_sql(FIXED, S1)} SELECT DISTINCT ticker, segment::int AS Fold, CAST(train_n AS bigint) AS Train_Count,
  CAST(train_pos AS bigint) AS Train_Positive,
  CASE WHEN train_pos = 0 THEN 1 ELSE (train_n - train_pos) / CAST(train_pos AS double) END AS weight FROM fold""",
    {"weight": 8},
)
def class_weights(spark, sf_dir):
    labeled = _labeled(spark, sf_dir, label_setups(FIXED), [(F.col("RSI_14") / 100).alias("score")])
    folds = E.fold_stats(labeled, KEYS, [0.5])
    return folds.select(
        "ticker", "Fold", "Train_Count", "Train_Positive",
        E.class_weight(F.col("Train_Count"), F.col("Train_Positive")).alias("weight"),
    )


@query(
    "fold_scaler_stats",
    f"""WITH RECURSIVE {labels_sql(label_setups(FIXED))}, x AS (SELECT ticker, la, tp, sl, fold, s1 * 100 AS a, s2 - 1 AS b
    FROM lab JOIN (VALUES (1), (2), (3)) k(fold) ON segment < fold)
SELECT ticker, la AS LOOKAHEAD, tp AS TP, sl AS SL, fold AS Fold, count(*) AS Train_Count, 'RSI_14' AS Feature, avg(a) AS Mean,
  stddev_pop(a) AS Std FROM x GROUP BY ALL
UNION ALL SELECT ticker, la, tp, sl, fold, count(*), 'Drawdown_60', avg(b), stddev_pop(b) FROM x GROUP BY ALL""",
    {"Mean": 6, "Std": 6},
)
def fold_scaler_stats(spark, sf_dir):
    columns = ["RSI_14", "Drawdown_60"]
    return E.fold_scalers(_labeled(spark, sf_dir, label_setups(FIXED), columns), KEYS, columns)


@query(
    "setup_metrics",
    f"""WITH RECURSIVE {metrics_sql(SETUPS, S1)} SELECT ticker, fs AS Feature_Set, {METRIC_SQL} FROM m""",
    METRIC_DIGITS,
)
def setup_metrics(spark, sf_dir):
    return metrics(spark, sf_dir).select("ticker", "Feature_Set", *METRIC_COLUMNS)


@query(
    "fixed_setup_results",
    f"""WITH RECURSIVE {graded_sql(FIXED, S3, cost=0.005, min_edge=0.02)}
SELECT ticker, fs AS Feature_Set, profile AS Profile, {GRADE_SQL} FROM graded""",
    GRADE_DIGITS,
)
def fixed_setup_results(spark, sf_dir):
    """One fixed setup for every ticker and feature set (the cost moves break-even and pass flag)."""
    m = metrics(spark, sf_dir, FIXED, scores)
    graded = search.profile_results(m, FIXED, cost=0.005, min_edge=0.02)
    return graded.select("ticker", "Feature_Set", "Profile", *GRADE_COLUMNS)


@query(
    "reoptimized_best",
    f"""WITH RECURSIVE {best_sql(SETUPS, S1)} SELECT ticker, fs AS Feature_Set, profile AS Profile, {GRADE_SQL},
  CASE profile WHEN 'FAST_SWING' THEN 40 WHEN 'SWING' THEN 60 WHEN 'POSITION' THEN 90 WHEN 'EASY' THEN 4 ELSE 40 END AS Evaluated_Setups FROM best""",
    GRADE_DIGITS,
)
def reoptimized_best(spark, sf_dir):
    results = search.profile_results(metrics(spark, sf_dir), SETUPS)
    best = search.best_setups(results, ["ticker", "Feature_Set"], SETUPS)
    return best.select("ticker", "Feature_Set", "Profile", *GRADE_COLUMNS, "Evaluated_Setups")


DIAGNOSED = """diag AS MATERIALIZED (SELECT *, concat_ws(',', CASE WHEN valid < 1 THEN 'insufficient_valid_folds' END,
    CASE WHEN trades_n < 5 THEN 'insufficient_trades' END, CASE WHEN Validation_Precision < 0.5 THEN 'low_precision' END,
    CASE WHEN Excess_Precision < 0 THEN 'low_excess_precision' END, CASE WHEN Avg_Return <= -0.02 THEN 'non_positive_avg_return' END,
    CASE WHEN Avg_Holding_Days > max_hold THEN 'avg_holding_too_long' END,
    CASE WHEN Timeout_Rate > max_out THEN 'timeout_rate_too_high' END) AS reasons
  FROM graded WHERE trades_n > 0)"""


@query(
    "reject_reasons",
    f"""WITH RECURSIVE {graded_sql(SETUPS, CONTRARIAN)}, {DIAGNOSED} SELECT ticker, profile AS Profile, reasons AS Reject_Reasons,
  reasons = '' AS Valid, {METRIC_SQL}, score AS Score FROM diag""",
    {**METRIC_DIGITS, "Score": 8},
)
def reject_reasons(spark, sf_dir):
    diagnostics, _ = search.optimize_profiles(metrics(spark, sf_dir, scored=contrarian_score), SETUPS, KEYS)
    return diagnostics.select("ticker", "Profile", "Reject_Reasons", "Valid", *METRIC_COLUMNS, "Score")


@query(
    "diagnostics_ranking",
    f"""WITH RECURSIVE {graded_sql(SETUPS, S1)}, {DIAGNOSED} SELECT ticker, profile AS Profile, la AS LOOKAHEAD, tp AS TP, sl AS SL,
  th AS THRESH, row_number() OVER (PARTITION BY ticker, profile ORDER BY (reasons = '') DESC, round(score, 10) DESC NULLS LAST, ordinal)
    AS "Rank" FROM diag""",
)
def diagnostics_ranking(spark, sf_dir):
    diagnostics, _ = search.optimize_profiles(metrics(spark, sf_dir), SETUPS, KEYS)
    ranked = search.rank_diagnostics(diagnostics, KEYS)
    return ranked.select("ticker", "Profile", "LOOKAHEAD", "TP", "SL", "THRESH", "Rank")


@query(
    "profile_best_valid",
    f"""WITH RECURSIVE {graded_sql(SETUPS, CONTRARIAN)}, {DIAGNOSED} SELECT ticker, profile AS Profile, {METRIC_SQL}, score AS Score
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, profile ORDER BY round(score, 10) DESC, ordinal) AS pick
  FROM diag WHERE reasons = '') r WHERE pick = 1""",
    {**METRIC_DIGITS, "Score": 8},
)
def profile_best_valid(spark, sf_dir):
    _, best = search.optimize_profiles(metrics(spark, sf_dir, scored=contrarian_score), SETUPS, KEYS)
    return best.select("ticker", "Profile", *METRIC_COLUMNS, "Score")


@query(
    "global_grid_best",
    f"""WITH RECURSIVE {graded_sql(GLOBAL, S1)} SELECT ticker, la AS LOOKAHEAD, tp AS TP, sl AS SL, th AS THRESH,
  CAST(trades_n AS bigint) AS Trades, mean_precision AS Mean_Fold_Precision, simple AS Score FROM (SELECT *, mean_precision + trades_n * 0.001 AS simple,
    row_number() OVER (PARTITION BY ticker ORDER BY round(mean_precision + trades_n * 0.001, 10) DESC, ordinal) AS pick
  FROM graded WHERE trades_n >= 5) r WHERE pick = 1""",
    {"Mean_Fold_Precision": 9, "Score": 9},
)
def global_grid_best(spark, sf_dir):
    best = search.global_grid_best(metrics(spark, sf_dir, GLOBAL), ["ticker"], GLOBAL)
    return best.select("ticker", "LOOKAHEAD", "TP", "SL", "THRESH", "Trades", "Mean_Fold_Precision", "Score")


@query(
    "resolved_setups",
    f"""WITH RECURSIVE {graded_sql(SETUPS, CONTRARIAN)}, {DIAGNOSED},
valid_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, profile ORDER BY round(score, 10) DESC, ordinal) AS first
    FROM diag WHERE reasons = '' AND ticker NOT LIKE 'Brand#2%') r WHERE first = 1),
pool AS (SELECT DISTINCT p_brand AS ticker, 'WIDE' AS profile, 5 AS la, 0.6::double AS tp, -0.4::double AS sl, 0.5::double AS th,
    NULL::double AS score, 'cli_explicit' AS source, 0 AS priority FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_brand LIKE 'Brand#1%'
  UNION ALL SELECT ticker, profile, la, tp, sl, th, score, 'best_params', 1 FROM valid_best
  UNION ALL SELECT ticker, profile, la, tp, sl, th, score, 'setup_diagnostics_fallback', 2 FROM diag)
SELECT ticker, profile AS Profile, la AS LOOKAHEAD, tp AS TP, sl AS SL, th AS THRESH, source AS Setup_Source
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, profile ORDER BY priority, round(score, 10) DESC, la, tp, sl, th) AS pick FROM pool) r
WHERE pick = 1""",
)
def resolved_setups(spark, sf_dir):
    diagnostics, best = search.optimize_profiles(metrics(spark, sf_dir, scored=contrarian_score), SETUPS, KEYS)
    # some tickers have a setup of their own for one profile, some have no best parameters
    best = best.where("ticker NOT LIKE 'Brand#2%'")
    explicit = bars(spark, sf_dir).select("ticker").distinct().where("ticker LIKE 'Brand#1%'").select(
        "ticker", F.lit("WIDE").alias("Profile"), F.lit(5).alias("LOOKAHEAD"), F.lit(0.6).alias("TP"), F.lit(-0.4).alias("SL"), F.lit(0.5).alias("THRESH"))
    return search.resolve_setups(explicit, best, diagnostics, ["ticker", "Profile"])
