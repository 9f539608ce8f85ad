"""Registered queries: experiment roll-ups, walk-forward stability, decisions, signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.catalog import features as _families, statements as _statements  # noqa: F401  (their SQL is read below)
from barloom.catalog.base import BARS, QUERIES, RETURNS, feature_frame, query, roll
from barloom.catalog.evaluation import (
    DIAGNOSED, FIXED, GRADE_COLUMNS, GRADE_DIGITS, GRADE_SQL, GRID, KEYS, PERIOD_JOINED, S1, S3, best_sql, complete,
    NEEDED, SHORT_PERIODS, SHORT_ROWS, labels_sql, frame, frame_sql, graded_sql, metrics, period_joined, periods_frame, scores,
)
from barloom.operators import decide as D
from barloom.operators import stability as S
from barloom.operators.evaluate import fold_scalers
from barloom.operators.labels import enough_rows, label_frame, label_setups, latest_complete
from barloom.operators.registry import VALUATION, feature_health, feature_sets
from barloom.operators.valuation import merge_valuation
from barloom.plans import search, signal
from barloom.plans import walkforward as W
from barloom.session import cut_lineage, work_folder
from barloom.sources import results

SWING = K.grid_rows("SWING", K.PROFILES["SWING"])
COST, MIN_EDGE = 0.003, 0.02

HEALTH_SETS = {
    "returns": ["Log_Return", "Relative_Strength", "Volume"],
    "recovery": ["Drawdown_60", "Log_Return", "Distance_52W_High", "Not_There"],
}


@query(
    "feature_health",
    f"""WITH {RETURNS}, v AS (SELECT ticker, r AS "Log_Return", rel AS "Relative_Strength", volume AS "Volume",
    close / ({roll('max', 'close', 60)} + 1e-9) - 1 AS "Drawdown_60",
    close / ({roll('max', 'close', 252)} + 1e-9) - 1 AS "Distance_52W_High" FROM ret),
long AS (SELECT ticker, Feature, value FROM v UNPIVOT INCLUDE NULLS (value FOR Feature IN
    ("Log_Return", "Relative_Strength", "Volume", "Drawdown_60", "Distance_52W_High")) u),
stats AS (SELECT ticker, Feature, 1.0::double - count(value) / CAST(count(*) AS double) AS miss, count(DISTINCT value) AS uniq,
    avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY 1, 2
  UNION ALL SELECT DISTINCT ticker, 'Not_There', 1.0::double, 0, NULL, NULL FROM v),
sets(fs, Feature) AS (VALUES ('returns', 'Log_Return'), ('returns', 'Relative_Strength'), ('returns', 'Volume'),
  ('recovery', 'Drawdown_60'), ('recovery', 'Log_Return'), ('recovery', 'Distance_52W_High'), ('recovery', 'Not_There'))
SELECT ticker, fs AS Feature_Set, Feature, miss AS Missing_Pct, uniq AS Unique_Count, mean AS Mean, sd AS Std,
  uniq <= 1 OR sd IS NULL OR sd = 0 AS Zero_Variance, CASE WHEN Feature = 'Not_There' THEN 'missing_column'
    WHEN uniq <= 1 OR sd IS NULL OR sd = 0 THEN 'zero_variance' WHEN miss > 0.3 THEN 'high_missing' ELSE 'ok' END AS Status
FROM stats JOIN sets USING (Feature)""",
    {"Missing_Pct": 9, "Mean": 6, "Std": 5},
)
def feature_health_query(spark, sf_dir):
    names = [c for columns in HEALTH_SETS.values() for c in columns]
    return feature_health(feature_frame(spark, sf_dir, columns=names), KEYS, HEALTH_SETS)


REGISTRY = feature_sets()
REGISTERED = list(dict.fromkeys(c for columns in REGISTRY.values() for c in columns))
_FAMILIES = [
    "log_return", "rsi_14", "ema_structure", "macd_hist", "bollinger", "volatility", "relative_strength", "foreign_flow",
    "momentum_family", "trend_quality", "volume_family", "recovery_family", "recovery_quality", "liquidity_cost", "noise_filter",
]
_JOINED = " ".join(f"LEFT JOIN ({QUERIES[n].sql}) {n} ON {n}.ticker = b.ticker AND {n}.date = b.date" for n in _FAMILIES) + " ".join(
    f" LEFT JOIN ({QUERIES[n].sql}) {n} ON {n}.ticker = upper(b.ticker) AND {n}.date = b.date" for n in ("valuation_ratios", "pb_percentile")
)
#: rolling means and deviations of equal windows differ in the last bits, which are no distinct values
NOISY = [
    "RS_Trend", "Foreign_Mutation", "Volatility", "VN_Volatility", "Volatility_Z_60", "Downside_Volatility_20", "Dist_BB_Upper",
    "Dist_BB_Lower", "BB_Position", "Momentum_Dropoff_Z_14", "Dollar_Volume_Z_60", "PB_Z_756",
]
NOISE_DIGITS = 9


def _column(name: str) -> str:
    value = "b.volume" if name == "Volume" else f"CAST({name} AS double)"
    return f'round({value}, {NOISE_DIGITS}) AS "{name}"' if name in NOISY else f'{value} AS "{name}"'


_MEMBERS = ", ".join(f"('{name}', '{c}')" for name, columns in REGISTRY.items() for c in columns)


@query(
    "feature_health_registry",
    f"""WITH {BARS}, v AS MATERIALIZED (SELECT b.ticker, {', '.join(map(_column, REGISTERED))}
  FROM (SELECT ticker, date, volume FROM bars) b {_JOINED}),
long AS (SELECT ticker, Feature, value FROM v UNPIVOT INCLUDE NULLS (value FOR Feature IN ({', '.join(f'"{c}"' for c in REGISTERED)})) u),
stats AS (SELECT ticker, Feature, 1.0::double - count(value) / CAST(count(*) AS double) AS miss, count(DISTINCT value) AS uniq,
    avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY 1, 2),
sets(fs, Feature) AS (VALUES {_MEMBERS})
SELECT ticker, fs AS Feature_Set, Feature, miss AS Missing_Pct, uniq AS Unique_Count,
  CASE WHEN abs(mean) < sd * 1e-9 THEN 0 ELSE mean END AS Mean, sd AS Std,
  uniq <= 1 OR sd IS NULL OR sd = 0 AS Zero_Variance, CASE
    WHEN uniq <= 1 OR sd IS NULL OR sd = 0 THEN 'zero_variance' WHEN miss > 0.3 THEN 'high_missing' ELSE 'ok' END AS Status
FROM stats JOIN sets USING (Feature)""",
    {"Missing_Pct": 9},
    {"Mean": 6, "Std": 6},
)
def feature_health_registry(spark, sf_dir):
    """Every feature of the registry's 25 sets, valuation included; ``NOISY`` ones at nine decimals."""
    left = feature_frame(spark, sf_dir, columns=REGISTERED).withColumn("shown", F.col("ticker")).withColumn("ticker", F.upper("ticker"))
    wide = merge_valuation(left, _statements.valuation(spark, sf_dir), VALUATION)
    rounded = {c: F.round(c, NOISE_DIGITS) for c in NOISY}
    health = feature_health(wide.withColumns({"ticker": F.col("shown"), **rounded}), KEYS, REGISTRY)
    # what is left of a mean of nothing depends on the order of summing
    return health.withColumn("Mean", F.when(F.abs("Mean") < F.col("Std") * 1e-9, 0.0).otherwise(F.col("Mean")))


BASELINE = REGISTRY["baseline"]


@query(
    "fold_scaler_set",
    f"""WITH RECURSIVE {labels_sql(label_setups(FIXED))}, v AS MATERIALIZED (SELECT b.ticker, b.date, {', '.join(map(_column, BASELINE))}
  FROM (SELECT ticker, date, volume FROM bars) b {_JOINED}),
x AS (SELECT ticker, date, Feature, value FROM v UNPIVOT (value FOR Feature IN ({', '.join(f'"{c}"' for c in BASELINE)})) u),
stats AS (SELECT ticker, la AS LOOKAHEAD, tp AS TP, sl AS SL, fold AS Fold, Feature, count(*) AS Train_Count, avg(value) AS mean, stddev_pop(value) AS sd
  FROM lab JOIN (VALUES (1), (2), (3)) k(fold) ON segment < fold JOIN x USING (ticker, date) GROUP BY ALL)
SELECT * EXCLUDE (mean, sd), CASE WHEN abs(mean) < sd * 1e-9 THEN 0 ELSE mean END AS Mean, sd AS Std FROM stats""",
    significant={"Mean": 6, "Std": 6},
)
def fold_scaler_set(spark, sf_dir):
    """The scaler of every column of the baseline set, per training fold."""
    features = feature_frame(spark, sf_dir, columns=sorted({*BASELINE, *NEEDED}))
    rounded = features.withColumns({c: F.round(c, NOISE_DIGITS) for c in NOISY if c in BASELINE})
    labeled = label_frame(rounded, KEYS, label_setups(FIXED), complete(), BASELINE).where(enough_rows())
    stats = fold_scalers(labeled, KEYS, BASELINE)
    return stats.withColumn("Mean", F.when(F.abs("Mean") < F.col("Std") * 1e-9, 0.0).otherwise(F.col("Mean")))


# ---- experiments ---------------------------------------------------------------------------------


def experiments(spark, sf_dir):
    return matrix_of(cut_lineage(metrics(spark, sf_dir, SWING, scores)), SWING)


def matrix_of(m, setups):
    """Both modes of every set; the frozen setup is the baseline's."""
    diagnostics, valid = search.optimize_profiles(m.where("Feature_Set = 'baseline'"), setups, KEYS)
    chosen = search.resolve_setups(None, valid, diagnostics, ["ticker", "Profile"])
    return search.experiment_matrix(m, setups, chosen, COST, MIN_EDGE)


def experiments_sql(setups, sets):
    return f"""{best_sql(setups, sets, cost=COST, min_edge=MIN_EDGE)}, {DIAGNOSED},
chosen AS (SELECT ticker, profile, la, tp, sl, th FROM (SELECT *, row_number() OVER
    (PARTITION BY ticker, profile ORDER BY (reasons = '') DESC, round(score, 10) DESC, la, tp, sl, th) AS pick
  FROM diag WHERE fs = 'baseline') r WHERE pick = 1),
res0 AS (SELECT *, 'reoptimized' AS mode FROM best
  UNION ALL BY NAME SELECT graded.*, 'fixed_setup' AS mode FROM graded JOIN chosen USING (ticker, profile, la, tp, sl, th)),
res AS MATERIALIZED (SELECT a.*, a.score - b.score AS d_score, a.edge - b.edge AS d_edge, a.Avg_Return - b.Avg_Return AS d_ret,
    a.Expectancy_Per_Day - b.Expectancy_Per_Day AS d_exp, a.Timeout_Rate - b.Timeout_Rate AS d_out,
    a.trades_n - b.trades_n AS d_trades, a.Validation_Precision - b.Validation_Precision AS d_prec,
    a.Excess_Precision - b.Excess_Precision AS d_exc, a.Avg_Holding_Days - b.Avg_Holding_Days AS d_hold
  FROM res0 a LEFT JOIN (SELECT * FROM res0 WHERE fs = 'baseline') b USING (ticker, profile, mode))"""


EXPERIMENTS = experiments_sql(SWING, S3)
DELTA_SQL = """d_score AS Score_Delta_vs_Baseline, d_prec AS Validation_Precision_Delta_vs_Baseline,
  d_exc AS Excess_Precision_Delta_vs_Baseline, d_edge AS Edge_vs_Breakeven_Delta_vs_Baseline,
  d_ret AS Avg_Return_Delta_vs_Baseline, d_exp AS Expectancy_Per_Day_Delta_vs_Baseline,
  d_hold AS Avg_Holding_Days_Delta_vs_Baseline, d_out AS Timeout_Rate_Delta_vs_Baseline,
  CAST(d_trades AS bigint) AS Trades_Delta_vs_Baseline"""
DELTA_DIGITS = {f"{m}_Delta_vs_Baseline": 8 for m in S.EXPERIMENT_METRICS if m != "Trades"}
RESULT_SQL = "ticker AS Ticker, profile AS Profile, mode AS Experiment_Mode, fs AS Feature_Set"


@query(
    "experiment_matrix",
    f"WITH RECURSIVE {EXPERIMENTS} SELECT {RESULT_SQL}, {GRADE_SQL}, {DELTA_SQL} FROM res",
    {**GRADE_DIGITS, **DELTA_DIGITS},
)
def experiment_matrix(spark, sf_dir):
    deltas = [f"{m}_Delta_vs_Baseline" for m in S.EXPERIMENT_METRICS]
    return experiments(spark, sf_dir).select(*D.RESULT_KEYS, *GRADE_COLUMNS, *deltas)


VERDICT = """CASE WHEN status = 'TRADEABLE_EDGE' AND d_edge > 0 THEN 'TRADEABLE_UPGRADE'
  WHEN d_score < 0 AND d_edge <= 0 AND d_ret <= 0 THEN 'DROP_CANDIDATE'
  WHEN d_edge > 0 AND d_ret > 0 AND d_exp > 0 AND coalesce(d_out, 0) <= 0.1 AND coalesce(d_trades, 0) >= -0.3 * greatest(trades_n, 1)
    THEN 'ACCEPT_CANDIDATE' ELSE 'RESEARCH_ONLY' END"""


@query(
    "feature_set_decision",
    f"""WITH RECURSIVE {EXPERIMENTS} SELECT {RESULT_SQL}, {VERDICT} AS Decision, status AS Research_Status
FROM res WHERE fs <> 'baseline'""",
)
def feature_set_decision(spark, sf_dir):
    decisions = D.feature_set_decisions(experiments(spark, sf_dir))
    return decisions.select(*D.RESULT_KEYS, "Decision", "Research_Status")


@query(
    "tradeable_report",
    f"""WITH RECURSIVE {EXPERIMENTS} SELECT {RESULT_SQL}, CASE WHEN fs <> 'baseline' THEN {VERDICT} END AS Decision
FROM res WHERE upper(profile) = 'SWING' AND mode = 'reoptimized' AND pass""",
)
def tradeable_report(spark, sf_dir):
    results = experiments(spark, sf_dir)
    report = D.attach_decisions(results, D.feature_set_decisions(results))
    return D.filter_report(report, profile="swing", mode="reopt", only_tradeable=True).select(
        *D.RESULT_KEYS, "Decision"
    )


@query(
    "ablation_deltas",
    f"""WITH RECURSIVE {EXPERIMENTS}, fam AS (SELECT * FROM res WHERE fs = 'candidate_trend_recovery_v1')
SELECT {RESULT_SQL}, 'candidate_full' AS Short_Feature, a.score - b.score AS Score_Delta_vs_Full,
  a.edge - b.edge AS Edge_vs_Breakeven_Delta_vs_Full, a.Avg_Return - b.Avg_Return AS Avg_Return_Delta_vs_Full,
  CAST(a.trades_n - b.trades_n AS bigint) AS Trades_Delta_vs_Full
FROM fam a JOIN (SELECT ticker, profile, mode, score, edge, Avg_Return, trades_n FROM fam) b USING (ticker, profile, mode)
UNION ALL SELECT a.ticker, a.profile, a.mode, 'ablation_trend_recovery_minus_trend_v1', 'minus_trend', a.score - b.score,
  a.edge - b.edge, a.Avg_Return - b.Avg_Return, CAST(a.trades_n - b.trades_n AS bigint)
FROM res a JOIN fam b USING (ticker, profile, mode) WHERE a.fs = 'candidate_recovery_v1'""",
    {"Score_Delta_vs_Full": 8, "Edge_vs_Breakeven_Delta_vs_Full": 8, "Avg_Return_Delta_vs_Full": 8},
)
def ablation_deltas(spark, sf_dir):
    """The recovery set is the trend-recovery set without its trend columns, and stands for it."""
    results = experiments(spark, sf_dir)
    name = F.when(
        F.col("Feature_Set") == "candidate_recovery_v1", "ablation_trend_recovery_minus_trend_v1"
    ).otherwise(F.col("Feature_Set"))
    out = D.ablation_deltas(results.withColumn("Feature_Set", name), ["Ticker", "Profile"])
    return out.select(
        *D.RESULT_KEYS, "Short_Feature", "Score_Delta_vs_Full", "Edge_vs_Breakeven_Delta_vs_Full",
        "Avg_Return_Delta_vs_Full", "Trades_Delta_vs_Full",
    )


_LABEL = "la || 'D | TP ' || printf('%.0f%%', tp * 100) || ' | SL ' || printf('%.0f%%', sl * 100) || ' | TH ' || printf('%.2f', th)"
_MODE = "CASE mode WHEN 'reoptimized' THEN 'reopt' WHEN 'fixed_setup' THEN 'fixed' ELSE mode END"


@query(
    "summary_view",
    f"""WITH RECURSIVE {EXPERIMENTS} SELECT ticker AS Ticker, profile AS Profile, fs AS Feature, {_MODE} AS Mode, {_LABEL} AS Setup,
  coalesce(printf('%.4f', score), '') AS Score, coalesce(printf('%.2f%%', edge * 100), '') AS Edge,
  coalesce(printf('%.2f%%', Avg_Return * 100), '') AS AvgRet, coalesce(printf('%.2f%%', Expectancy_Per_Day * 100), '') AS Exp_Day,
  coalesce(printf('%.2f%%', Timeout_Rate * 100), '') AS Timeout, CAST(CAST(trades_n AS bigint) AS varchar) AS Trades,
  status AS Status FROM res""",
)
def summary_view(spark, sf_dir):
    return D.summary_view(experiments(spark, sf_dir))


@query(
    "risk_view",
    f"""WITH RECURSIVE {EXPERIMENTS} SELECT ticker AS Ticker, profile AS Profile, fs AS Feature, {_MODE} AS Mode,
  coalesce(printf('%.2f%%', Validation_Precision * 100), '') AS "Precision", coalesce(printf('%.2f%%', be * 100), '') AS BE,
  coalesce(printf('%.2f%%', edge * 100), '') AS Edge, coalesce(printf('%.2f', Avg_Holding_Days), '') AS HoldD,
  coalesce(printf('%.2f%%', Timeout_Rate * 100), '') AS Timeout, CAST(CAST(trades_n AS bigint) AS varchar) AS Trades FROM res""",
)
def risk_view(spark, sf_dir):
    return D.risk_view(experiments(spark, sf_dir))


@query(
    "top_feature_sets",
    f"""WITH RECURSIVE {EXPERIMENTS} SELECT {RESULT_SQL}, edge AS Edge_vs_Breakeven FROM res
ORDER BY round(edge, 10) DESC NULLS LAST, ticker, profile, mode, fs LIMIT 20""",
    {"Edge_vs_Breakeven": 10},
)
def top_feature_sets(spark, sf_dir):
    results = experiments(spark, sf_dir).withColumn("Edge_vs_Breakeven", F.round("Edge_vs_Breakeven", 10))
    return S.top(results, "Edge_vs_Breakeven", 20, D.RESULT_KEYS).select(*D.RESULT_KEYS, "Edge_vs_Breakeven")


# ---- periods -------------------------------------------------------------------------------------

_WHO = "split_part(ticker, '|', 1) AS ticker, split_part(ticker, '|', 2) AS Period_Label"


@query(
    "period_features",
    f"""WITH RECURSIVE {frame_sql(PERIOD_JOINED)} SELECT {_WHO}, date, s1 * 100 AS RSI_14, s2 - 1 AS Drawdown_60, s3 AS ER_10 FROM f""",
    {"RSI_14": 5, "Drawdown_60": 6, "ER_10": 5},
)
def period_features(spark, sf_dir):
    return periods_frame(spark, sf_dir).select("ticker", "Period_Label", "date", "RSI_14", "Drawdown_60", "ER_10")


def _with_period_deltas(source: str, names: dict[str, str]) -> str:
    deltas = ", ".join(f"a.{col} - b.{col} AS d_{short}" for short, col in names.items())
    return f"""SELECT a.* REPLACE (split_part(a.ticker, '|', 1) AS ticker), split_part(a.ticker, '|', 2) AS label, {deltas}
  FROM {source} a LEFT JOIN (SELECT * FROM {source} WHERE fs = 'baseline') b USING (ticker, profile)"""


_DELTAS = {"score": "score", "edge": "edge", "ret": "Avg_Return"}
PERIOD_BEST = f"""{best_sql(SWING, S3, PERIOD_JOINED, 0.0, MIN_EDGE)},
wf AS MATERIALIZED ({_with_period_deltas('best', _DELTAS)})"""

_STABLE = """count(DISTINCT label) AS Periods, CAST(sum(CAST(pass AS int)) AS bigint) AS Pass_Periods, avg(score) AS Avg_Score,
    min(score) AS Min_Score, avg(edge) AS Avg_Edge, min(edge) AS Min_Edge, avg(Avg_Return) AS Avg_Return,
    min(Avg_Return) AS Min_Return, avg(Expectancy_Per_Day) AS Avg_Expectancy_Per_Day, avg(Timeout_Rate) AS Avg_Timeout_Rate,
    CAST(sum(trades_n) AS bigint) AS Total_Trades, avg(trades_n) AS Avg_Trades"""


def stable_sql(source: str, by: str, flag: str, more: str = "") -> str:
    return f"""SELECT *, Pass_Periods / CAST(Periods AS double) AS Pass_Rate, coalesce(Pass_Periods / CAST(Periods AS double) >= 0.75
    AND Min_Edge >= {MIN_EDGE} AND Avg_Return > 0 AND Total_Trades >= 100, false) AS {flag}
  FROM (SELECT {by}, {_STABLE}{more} FROM {source} GROUP BY ALL) s"""


STABLE_DIGITS = {
    "Avg_Score": 8, "Min_Score": 8, "Avg_Edge": 9, "Min_Edge": 9, "Avg_Return": 8, "Min_Return": 8,
    "Avg_Expectancy_Per_Day": 8, "Avg_Timeout_Rate": 9, "Avg_Trades": 6, "Pass_Rate": 9,
}


def walkforward(spark, sf_dir):
    return W.walkforward(periods_frame(spark, sf_dir), SWING, complete(), scores(), 0.0, MIN_EDGE)


@query(
    "period_baseline_deltas",
    f"""WITH RECURSIVE {PERIOD_BEST} SELECT ticker, label AS Period_Label, profile AS Profile, fs AS Feature_Set, {GRADE_SQL},
  d_score AS Score_Delta_vs_Period_Baseline, d_edge AS Edge_vs_Breakeven_Delta_vs_Period_Baseline,
  d_ret AS Avg_Return_Delta_vs_Period_Baseline FROM wf""",
    {**GRADE_DIGITS, "Score_Delta_vs_Period_Baseline": 8, "Edge_vs_Breakeven_Delta_vs_Period_Baseline": 8,
     "Avg_Return_Delta_vs_Period_Baseline": 8},
)
def period_baseline_deltas(spark, sf_dir):
    results, _ = walkforward(spark, sf_dir)
    return D.period_view(results).select(
        "ticker", "Period_Label", "Profile", "Feature_Set", "Score_Delta_vs_Period_Baseline",
        "Edge_vs_Breakeven_Delta_vs_Period_Baseline", "Avg_Return_Delta_vs_Period_Baseline",
    ).join(results.select("ticker", "Period_Label", "Profile", "Feature_Set", *GRADE_COLUMNS),
           ["ticker", "Period_Label", "Profile", "Feature_Set"])


_RANKED = "row_number() OVER (PARTITION BY ticker, Profile ORDER BY {order}) AS \"Rank\""


def _order(columns: list[str], tie: str) -> str:
    rounded = [c if c.endswith(("Candidate", "Trades")) else f"round({c}, 10)" for c in columns]
    return ", ".join(f"{c} DESC NULLS LAST" for c in rounded) + f", {tie}"


def ranked(df, order, tie_break):
    """Rank with scores rounded to ten digits, so that equal results do not depend on summing order."""
    floats = [c for c in order if not c.endswith(("Candidate", "Trades"))]
    keys = {f"__{c}": F.round(c, 10) for c in floats}
    by = [f"__{c}" if c in floats else c for c in order]
    return S.rank(df.withColumns(keys), ["ticker", "Profile"], by, tie_break).drop(*keys)


@query(
    "stability_score",
    f"""WITH RECURSIVE {PERIOD_BEST}, s AS ({stable_sql("(SELECT * FROM wf WHERE fs <> 'baseline') w",
        "ticker, profile AS Profile, fs AS Feature_Set", "Stable_Strict_Candidate")})
SELECT *, {_RANKED.format(order=_order(S.STABLE_ORDER, 'Feature_Set'))} FROM s""",
    STABLE_DIGITS,
)
def stability_score(spark, sf_dir):
    _, stable = walkforward(spark, sf_dir)
    return ranked(stable, S.STABLE_ORDER, ["Feature_Set"])


PERIOD_FIXED = f"""{graded_sql(FIXED, S3, PERIOD_JOINED, 0.0, MIN_EDGE)},
fz AS MATERIALIZED ({_with_period_deltas('graded', _DELTAS)})"""


@query(
    "frozen_walkforward",
    f"""WITH RECURSIVE {PERIOD_FIXED}, s AS ({stable_sql("(SELECT * FROM fz WHERE fs <> 'baseline') w",
        "ticker, profile AS Profile, fs AS Feature_Set", "Frozen_Strict_Candidate",
        ", avg(d_score) AS Avg_Score_Delta, avg(d_edge) AS Avg_Edge_Delta, avg(d_ret) AS Avg_Return_Delta")})
SELECT *, {_RANKED.format(order=_order(S.FROZEN_ORDER, 'Feature_Set'))} FROM s""",
    {**STABLE_DIGITS, "Avg_Score_Delta": 8, "Avg_Edge_Delta": 8, "Avg_Return_Delta": 8},
)
def frozen_walkforward(spark, sf_dir):
    _, stable = W.frozen_walkforward(periods_frame(spark, sf_dir), FIXED[0], complete(), scores(), 0.0, MIN_EDGE)
    return ranked(stable, S.FROZEN_ORDER, ["Feature_Set"])


SHORT_FIXED = f"""{graded_sql(FIXED, S3, period_joined(SHORT_PERIODS, SHORT_ROWS), 0.0, MIN_EDGE)},
sz AS MATERIALIZED (SELECT * REPLACE (split_part(ticker, '|', 1) AS ticker), split_part(ticker, '|', 2) AS label FROM graded)"""


@query(
    "short_period_results",
    f"""WITH RECURSIVE {SHORT_FIXED} SELECT ticker, label AS Period_Label, fs AS Feature_Set, {GRADE_SQL},
  CASE WHEN rows_n < 100 THEN 'insufficient_labeled_rows' ELSE '' END AS Reject_Note FROM sz""",
    GRADE_DIGITS,
)
def short_period_results(spark, sf_dir):
    """A frozen setup over periods that give more than, fewer than and none of the labels a fold needs."""
    return _short(spark, sf_dir)[0].select("ticker", "Period_Label", "Feature_Set", *GRADE_COLUMNS, "Reject_Note")


@query(
    "short_period_stability",
    f"""WITH RECURSIVE {SHORT_FIXED} {stable_sql("sz", "ticker, fs AS Feature_Set", "Frozen_Strict_Candidate")}""",
    STABLE_DIGITS,
)
def short_period_stability(spark, sf_dir):
    """Periods without a signal count in the pass rate."""
    return S.stability(_short(spark, sf_dir)[0], ["ticker", "Feature_Set"], MIN_EDGE, "Frozen_Strict_Candidate")


def _short(spark, sf_dir):
    features = periods_frame(spark, sf_dir, SHORT_PERIODS, SHORT_ROWS)
    return W.frozen_grid(features, FIXED, complete(), scores(), 0.0, MIN_EDGE)



PERIOD_GRID = f"""{graded_sql(GRID, S3, PERIOD_JOINED, 0.0, MIN_EDGE)},
gz AS (SELECT * REPLACE (split_part(ticker, '|', 1) AS ticker), split_part(ticker, '|', 2) AS label FROM graded),
gs AS MATERIALIZED ({stable_sql("gz", "ticker, profile AS Profile, fs || '|L' || la || '|TP' || tp || '|SL' || sl || '|TH' || th AS Setup_ID, "
        "fs AS Feature_Set, la AS LOOKAHEAD, tp AS TP, sl AS SL, th AS THRESH", "Frozen_Strict_Candidate")})"""


def grid(spark, sf_dir):
    _, stable = W.frozen_grid(periods_frame(spark, sf_dir), GRID, complete(), scores(), 0.0, MIN_EDGE)
    return stable


@query(
    "grid_result_scan",
    f"""WITH RECURSIVE {PERIOD_GRID} SELECT Feature_Set, CAST(LOOKAHEAD AS double) AS LOOKAHEAD, TP, SL, THRESH,
  CAST(Pass_Periods AS double) AS Pass_Periods, Avg_Edge, Min_Edge, Avg_Return, CAST(Total_Trades AS double) AS Total_Trades,
  Frozen_Strict_Candidate, true AS Tagged FROM gs""",
    {c: STABLE_DIGITS[c] for c in ("Avg_Edge", "Min_Edge", "Avg_Return")},
)
def grid_result_scan(spark, sf_dir):
    """Grid results written as CSV files, a folder per ticker, and found again beside files that are none."""
    path = f"{work_folder(spark).rstrip('/')}/grid-results-{uuid.uuid4().hex}"
    stable = cut_lineage(grid(spark, sf_dir))
    results.save(stable.withColumn("folder", F.col("ticker")), f"{path}/grid", "csv", ["folder"])
    results.save(stable.select("ticker", "Feature_Set"), f"{path}/other", "csv")
    found = results.scan_grid_results(spark, path)
    tagged = F.startswith("Source_File", F.lit("grid/folder=")) & F.col("Source_Modified").isNotNull()
    return found.withColumn("Tagged", tagged).drop("Source_File", "Source_Modified")


@query(
    "frozen_grid_stability",
    f"WITH RECURSIVE {PERIOD_GRID} SELECT *, {_RANKED.format(order=_order(S.GRID_ORDER, 'Setup_ID'))} FROM gs",
    STABLE_DIGITS,
)
def frozen_grid_stability(spark, sf_dir):
    return ranked(grid(spark, sf_dir), S.GRID_ORDER, ["Setup_ID"])


# ---- candidates ----------------------------------------------------------------------------------

CANDIDATE_KEYS = ["ticker", "Profile"]
_BEST_ORDER = "round(Min_Edge, 10) DESC, round(Avg_Return, 10) DESC, Total_Trades DESC, LOOKAHEAD, TP, SL DESC, THRESH"
CANDIDATES = f"""{PERIOD_GRID},
cand AS (SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, Profile
    ORDER BY Frozen_Strict_Candidate DESC, Pass_Periods DESC, {_BEST_ORDER}) AS pick
  FROM gs WHERE Feature_Set IN ('candidate_recovery_v1', 'candidate_trend_recovery_v1') AND TP = 0.1) r WHERE pick = 1),
base AS (SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, Profile
    ORDER BY Pass_Periods DESC, {_BEST_ORDER}) AS pick FROM gs WHERE Feature_Set = 'baseline') r WHERE pick = 1)"""


def _rounded(df):
    """Choices compare ten digits; the exact values stay beside them."""
    names = ("Min_Edge", "Avg_Return")
    return df.withColumns({f"Exact_{c}": F.col(c) for c in names} | {c: F.round(c, 10) for c in names})


def candidates(spark, sf_dir):
    names = ["candidate_recovery_v1", " candidate_trend_recovery_v1"]
    return D.select_candidate(_rounded(grid(spark, sf_dir)), CANDIDATE_KEYS, names, tp=0.10)


@query(
    "candidate_select",
    f"""WITH RECURSIVE {CANDIDATES} SELECT ticker, Profile, Setup_ID, Periods, Pass_Periods, Min_Edge, Avg_Return, Total_Trades
FROM cand""",
    {"Min_Edge": 9, "Avg_Return": 8},
)
def candidate_select(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        "ticker", "Profile", "Setup_ID", "Periods", "Pass_Periods", F.col("Exact_Min_Edge").alias("Min_Edge"),
        F.col("Exact_Avg_Return").alias("Avg_Return"), "Total_Trades",
    )


_CHECKS = """SELECT ticker, Profile, unnest(['Pass_Periods >= 3', 'Min_Edge >= 2.00%', 'Avg_Return >= 2.00%', 'Total_Trades >= 100']) AS Rule,
  unnest([CAST(Pass_Periods AS varchar), printf('%.2f%%', round(Min_Edge, 10) * 100), printf('%.2f%%', round(Avg_Return, 10) * 100),
    format('{:,}', Total_Trades)]) AS Observed,
  unnest([CASE WHEN Pass_Periods >= 3 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN Min_Edge >= 0.02 THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN Avg_Return >= 0.02 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN Total_Trades >= 100 THEN 'PASS' ELSE 'FAIL' END]) AS Status
FROM cand"""


@query("acceptance_checks", f"WITH RECURSIVE {CANDIDATES} {_CHECKS}")
def acceptance_checks(spark, sf_dir):
    return D.acceptance_checks(candidates(spark, sf_dir), CANDIDATE_KEYS)


@query(
    "promotion_decision",
    f"""WITH RECURSIVE {CANDIDATES} SELECT ticker, Profile, CASE WHEN Frozen_Strict_Candidate AND Pass_Periods >= 3 AND Min_Edge >= 0.02
    AND Avg_Return >= 0.02 AND Total_Trades >= 100 THEN 'PROMOTE_TO_PRODUCTION_CANDIDATE'
  WHEN Frozen_Strict_Candidate THEN 'KEEP_AS_RESEARCH_CANDIDATE' ELSE 'RESEARCH_ONLY' END AS Decision FROM cand""",
)
def promotion_decision(spark, sf_dir):
    rows = cut_lineage(candidates(spark, sf_dir))
    return D.promotion(rows, D.acceptance_checks(rows, CANDIDATE_KEYS), CANDIDATE_KEYS).drop("Reason")


@query(
    "baseline_comparison",
    f"""WITH RECURSIVE {CANDIDATES}, pair AS (SELECT ticker, Profile, round(c.Min_Edge, 10) AS e1, round(b.Min_Edge, 10) AS e2,
    round(c.Avg_Return, 10) AS r1, round(b.Avg_Return, 10) AS r2, c.Total_Trades AS t1, b.Total_Trades AS t2
  FROM cand c JOIN base b USING (ticker, Profile))
SELECT ticker, Profile, unnest(['Min Edge', 'Avg Return', 'Total Trades']) AS Metric,
  unnest([printf('%.2f%%', e1 * 100), printf('%.2f%%', r1 * 100), format('{{:,}}', t1)]) AS Candidate,
  unnest([printf('%.2f%%', e2 * 100), printf('%.2f%%', r2 * 100), format('{{:,}}', t2)]) AS Baseline,
  unnest([printf('%.2f%%', (e1 - e2) * 100), printf('%.2f%%', (r1 - r2) * 100), format('{{:,}}', t1 - t2)]) AS Delta FROM pair""",
)
def baseline_comparison(spark, sf_dir):
    rows = cut_lineage(_rounded(grid(spark, sf_dir)))
    names = ["candidate_recovery_v1", "candidate_trend_recovery_v1"]
    chosen = D.select_candidate(rows, CANDIDATE_KEYS, names, tp=0.10)
    return D.compare_with_baseline(chosen, D.select_baseline(rows, CANDIDATE_KEYS, "baseline"), CANDIDATE_KEYS)


@query(
    "research_evidence",
    f"""WITH RECURSIVE {PERIOD_GRID} SELECT ticker, 'recovery_alias' AS Feature_Set, Pass_Periods, Min_Edge, Avg_Return FROM gs
WHERE Feature_Set = 'candidate_recovery_v1' AND LOOKAHEAD = 20 AND TP = 0.1 AND SL = -0.07 AND THRESH = 0.55""",
    {"Min_Edge": 9, "Avg_Return": 8},
)
def research_evidence(spark, sf_dir):
    """Evidence for a signal whose feature set goes by an alias and whose setup has float noise."""
    stable = cut_lineage(grid(spark, sf_dir))
    wanted = stable.select("ticker").distinct().select(
        "ticker", F.lit("recovery_alias").alias("Feature_Set"), F.lit(20).alias("LOOKAHEAD"),
        F.lit(0.1 + 1e-12).alias("TP"), F.lit(-0.07).alias("SL"), F.lit(0.55).alias("THRESH"),
    )
    found = D.research_evidence(wanted, stable, ["ticker"], {"recovery_alias": "candidate_recovery_v1"})
    return found.select("ticker", "Feature_Set", "evidence.*")


# ---- signals -------------------------------------------------------------------------------------


def latest(spark, sf_dir):
    return latest_complete(frame(spark, sf_dir), KEYS, complete(), ["RSI_14"]).withColumn(
        "probability", F.col("RSI_14") / 100
    )


LATEST = f"""{frame_sql()}, latest AS (SELECT ticker, max(date) FILTER (rn >= 60) AS d, max_by(close, date) FILTER (rn >= 60) AS c,
  max_by(s1, date) FILTER (rn >= 60) AS p FROM f GROUP BY 1)"""
_BE = "((0.005 + 0.07) / (0.1 + 0.07))"


@query(
    "signal_action",
    f"""WITH RECURSIVE {LATEST} SELECT ticker, d AS Latest_Feature_Date, c AS Latest_Close, p AS probability,
  CAST({_BE} AS double) AS breakeven_precision, CASE WHEN p >= 0.5 AND p >= {_BE} + 0.02 THEN 'BUY' WHEN p >= 0.5 THEN 'WATCHLIST'
    WHEN p >= 0.45 THEN 'WATCHLIST' ELSE 'HOLD' END AS action FROM latest""",
    {"probability": 7, "breakeven_precision": 9},
)
def signal_action(spark, sf_dir):
    decided = signal.decide(latest(spark, sf_dir), FIXED[0], 0.005, 0.02, 0.05)
    return decided.select("ticker", "Latest_Feature_Date", "Latest_Close", "probability", "breakeven_precision", "action")


_TIER = "CASE WHEN p >= 0.75 THEN 'STRONG WATCH' WHEN p >= th THEN 'VALID ENTRY' WHEN p >= 0.55 THEN 'WEAK SIGNAL' ELSE 'NO TRADE' END"
_KELLY = "least(greatest((Validation_Precision - (1 - Validation_Precision) / (tp / abs(sl))) / 2 * 100, 0), 10)"


@query(
    "radar_summary",
    f"""WITH RECURSIVE {best_sql(SWING, S1)}, latest AS (SELECT ticker, max(date) FILTER (rn >= 60) AS d,
  max_by(s1, date) FILTER (rn >= 60) AS p FROM f GROUP BY 1),
tier AS (SELECT *, {_TIER} AS tier FROM best JOIN latest USING (ticker) WHERE score IS NOT NULL),
sized AS (SELECT *, CAST(CASE WHEN tier IN ('VALID ENTRY', 'STRONG WATCH') THEN {_KELLY} ELSE 0 END AS double) AS pct FROM tier)
SELECT ticker, profile AS Profile, d AS Latest_Feature_Date, p AS probability, tier AS Signal, pct AS Half_Kelly_Pct,
  printf('%.1f%%', pct) AS Position_Size FROM sized""",
    {"probability": 7, "Half_Kelly_Pct": 7},
)
def radar_summary(spark, sf_dir):
    results = search.profile_results(metrics(spark, sf_dir, SWING), SWING)
    best = search.best_setups(results, ["ticker", "Feature_Set"], SWING)
    return signal.radar_summary(best, latest(spark, sf_dir)).select(
        "ticker", "Profile", "Latest_Feature_Date", "probability", "Signal", "Half_Kelly_Pct", "Position_Size"
    )


# the published production candidate: 34 features
MODEL_SET = "candidate_cost_resilient_recovery_no_noise_v1"
MODEL_COLUMNS = feature_sets()[MODEL_SET]


def signal_evidence(spark, sf_dir):
    """What the frozen grid over all periods says about the production setup; RSI stands in for its probability there."""
    _, stable = W.frozen_grid(periods_frame(spark, sf_dir), FIXED[:1], complete(), {MODEL_SET: F.col("RSI_14") / 100}, 0.0, MIN_EDGE)
    stable = cut_lineage(stable)
    setup = {c: FIXED[0][c] for c in search.SETUP_KEY}
    wanted = stable.select("ticker").distinct().select(
        "ticker", F.lit(MODEL_SET).alias("Feature_Set"), *[F.lit(value).alias(c) for c, value in setup.items()])
    return D.research_evidence(wanted, stable, ["ticker"]).select("ticker", "evidence.*")


def model_signals(spark, sf_dir, **options):
    features = feature_frame(spark, sf_dir, columns=MODEL_COLUMNS)
    return signal.latest_signals(features, MODEL_COLUMNS, FIXED[0], MODEL_SET, "SWING", **options)


@query("gbt_signal")
def gbt_signal(spark, sf_dir):
    """Latest nested signal rows from a boosted-tree panel model of the published size."""
    return model_signals(spark, sf_dir, evidence=signal_evidence(spark, sf_dir)).select("ticker", F.to_json(F.struct("*")).alias("payload"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """The importance of every feature, not only of the ten that a signal row names."""
    rows = model_signals(spark, sf_dir, top=len(MODEL_COLUMNS))
    return rows.select(F.inline("top_model_features")).distinct()
