"""Registered queries: joins and windowed features."""

from __future__ import annotations

import hashlib

from barloom.catalog.base import (
    QUERIES, BARS, INDEX_BARS, JOINED, RETURNS, bars, ewm_cte, feature_frame, index_bars, joined, lag, query, roll,
)
from barloom.operators.features import add_features, join_benchmark
from barloom.sources.bars import bucketed_bars
from barloom.sources.results import save_bucketed

ID = ["ticker", "date"]


def _family(name: str, sql: str, digits: dict[str, int | None], **options) -> None:
    """Register a feature family; the frame is pruned to the columns the family asks for. Columns
    with digits ``None`` are compared unrounded: they hold no sum or logarithm."""

    @query(name, sql, {c: n for c, n in digits.items() if n is not None})
    def build(spark, sf_dir):
        return feature_frame(spark, sf_dir, columns=list(digits), **options).select(*ID, *digits)


query("bars", f"WITH {BARS} SELECT * FROM bars")(bars)
query("index_bars", f"WITH {INDEX_BARS} SELECT * FROM index_bars")(index_bars)


@query(
    "index_join",
    f"WITH {JOINED} SELECT ticker, date, close, volume, vn_close FROM j",
)
def index_join(spark, sf_dir):
    return joined(spark, sf_dir).select(*ID, "close", "volume", "vn_close")


_family("log_return", f"WITH {RETURNS} SELECT ticker, date, r AS Log_Return FROM ret", {"Log_Return": 6})

_family(
    "rsi_14",
    f"""WITH RECURSIVE {RETURNS}, {ewm_cte('e', {'g': ('gain', 1 / 14), 'l': ('loss', 1 / 14)})}
SELECT ticker, date, 100 - 100 / (1 + g / (l + 1e-9)) AS RSI_14 FROM ret JOIN e USING (ticker, rn)""",
    {"RSI_14": 5},
)


@query("bucketed_features", QUERIES["rsi_14"].sql, {"RSI_14": 5})
def bucketed_features(spark, sf_dir):
    """Bars kept in a bucketed table, from which the feature stack needs no shuffle."""
    table = "bars_" + hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()
    save_bucketed(bars(spark, sf_dir), table, ["ticker"], buckets=8)
    stored = join_benchmark(bucketed_bars(spark, table), index_bars(spark, sf_dir))
    return add_features(stored, columns=["RSI_14"]).select(*ID, "RSI_14")


_family(
    "ema_structure",
    f"""WITH RECURSIVE {RETURNS},
{ewm_cte('e', {'e13': ('close', 2 / 14), 'e21': ('close', 2 / 22), 'e55': ('close', 2 / 56)})}
SELECT ticker, date, e13 AS EMA_13, e21 AS EMA_21, e55 AS EMA_55,
  (e13 - e21) / (e21 + 1e-9) AS EMA_13_21_Cross, (close - e13) / (e13 + 1e-9) AS Dist_EMA_13
FROM ret JOIN e USING (ticker, rn)""",
    {"EMA_13": 4, "EMA_21": 4, "EMA_55": 4, "EMA_13_21_Cross": 6, "Dist_EMA_13": 6},
)

_family(
    "macd_hist",
    f"""WITH RECURSIVE {RETURNS}, {ewm_cte('e', {'e10': ('close', 2 / 11), 'e50': ('close', 2 / 51)})},
m AS MATERIALIZED (SELECT ticker, rn, e10 - e50 AS macd FROM e),
{ewm_cte('s', {'signal': ('macd', 2 / 101)}, base='m')}
SELECT ticker, date, macd AS MACD_10_50, signal AS MACD_Signal_100, macd - signal AS MACD_Hist_Custom
FROM ret JOIN m USING (ticker, rn) JOIN s USING (ticker, rn)""",
    {"MACD_10_50": 4, "MACD_Signal_100": 4, "MACD_Hist_Custom": 4},
)

_family(
    "bollinger",
    f"""WITH {RETURNS}, bb AS (SELECT ticker, date, close, {roll('avg', 'close', 20)} AS mid,
  {roll('stddev_pop', 'close', 20)} AS sd FROM ret)
SELECT ticker, date, mid AS BB_Mid, sd AS BB_Std, mid + 2 * sd AS BB_Upper, mid - 2 * sd AS BB_Lower,
  (close - (mid + 2 * sd)) / (mid + 2 * sd + 1e-9) AS Dist_BB_Upper,
  (close - (mid - 2 * sd)) / (mid - 2 * sd + 1e-9) AS Dist_BB_Lower,
  (close - mid) / (2 * sd + 1e-9) AS BB_Position FROM bb""",
    {"BB_Mid": 4, "BB_Std": 4, "BB_Upper": 4, "BB_Lower": 4, "Dist_BB_Upper": 4, "Dist_BB_Lower": 4,
     "BB_Position": 4},
)

_family(
    "volatility",
    f"WITH {RETURNS} SELECT ticker, date, {roll('stddev_samp', 'r', 20)} AS Volatility FROM ret",
    {"Volatility": 5},
)

_family(
    "relative_strength",
    f"""WITH RECURSIVE {RETURNS}, {ewm_cte('e', {'e20': ('vn_close', 2 / 21)})}
SELECT ticker, date, vn_r AS VN_Return, {roll('stddev_samp', 'vn_r', 20)} AS VN_Volatility,
  rel AS Relative_Strength, {roll('avg', 'rel', 10)} AS RS_Trend, e20 AS VN_EMA20,
  (vn_close - e20) / (e20 + 1e-9) AS Market_Distance_EMA FROM ret JOIN e USING (ticker, rn)""",
    {"VN_Return": 6, "VN_Volatility": 5, "Relative_Strength": 6, "RS_Trend": 6, "VN_EMA20": 4,
     "Market_Distance_EMA": 6},
)

_family(
    "foreign_flow",
    f"""WITH {RETURNS}, n AS (SELECT ticker, date, net_volume_foreign AS v,
  {roll('sum', 'net_volume_foreign', 5)} AS s5, {roll('avg', 'net_volume_foreign', 20)} AS m20,
  {roll('stddev_samp', 'net_volume_foreign', 20)} AS d20, {roll('sum', 'volume', 5)} AS v5 FROM ret)
SELECT ticker, date, s5 AS Foreign_Net_5D, m20 AS Foreign_Net_20D_Mean, d20 AS Foreign_Net_20D_Std,
  (v - m20) / (d20 + 1e-9) AS Foreign_Mutation, s5 / (v5 + 1e-9) AS Foreign_Net_5D_Ratio FROM n""",
    {"Foreign_Net_5D": 2, "Foreign_Net_20D_Mean": 4, "Foreign_Net_20D_Std": 4, "Foreign_Mutation": 4, "Foreign_Net_5D_Ratio": 6},
)

_family(
    "momentum_family",
    f"""WITH RECURSIVE {RETURNS}, {ewm_cte('e', {'ewr': ('r', 2 / 11)}, seed_row=2)}
SELECT ret.ticker, date, close - c14 AS Momentum_14, close - c14 AS Abs_Momentum_14,
  ln(close / (c14 + 1e-9)) AS Log_Momentum_14, ewr AS EWM_Return_10,
  {lag('r', 14)} AS Momentum_Dropoff_14,
  abs({lag('r', 14)}) / ({roll('stddev_samp', 'r', 60)} + 1e-9) AS Momentum_Dropoff_Z_14
FROM (SELECT * FROM ret) ret LEFT JOIN (SELECT ticker AS t, rn AS k, ewr FROM e) e ON t = ticker AND k = rn""",
    {"Momentum_14": None, "Abs_Momentum_14": None, "Log_Momentum_14": 6, "EWM_Return_10": 6,
     "Momentum_Dropoff_14": 6, "Momentum_Dropoff_Z_14": 4},
)

_family(
    "trend_quality",
    f"""WITH RECURSIVE {RETURNS},
{ewm_cte('e', {'e13': ('close', 2 / 14), 'e21': ('close', 2 / 22), 'e55': ('close', 2 / 56)})},
t AS (SELECT * FROM ret JOIN e USING (ticker, rn))
SELECT ticker, date, e13 / {lag('e13')} - 1 AS EMA_13_Slope, (e21 - e55) / (e55 + 1e-9) AS EMA_21_55_Gap,
  abs(close - c10) / ({roll('sum', 'step', 10)} + 1e-9) AS ER_10 FROM t""",
    {"EMA_13_Slope": 6, "EMA_21_55_Gap": 6, "ER_10": 5},
)

_family(
    "volume_family",
    f"""WITH {RETURNS} SELECT ticker, date, volume / ({roll('avg', 'volume', 20)} + 1e-9) AS Volume_Ratio_20,
  ln((volume + 1e-9) / (v1 + 1e-9)) AS Log_Volume_Change FROM ret""",
    {"Volume_Ratio_20": 6, "Log_Volume_Change": 6},
)

_family(
    "recovery_family",
    f"""WITH {RETURNS} SELECT ticker, date, close / ({roll('max', 'close', 60)} + 1e-9) - 1 AS Drawdown_60,
  close / ({roll('max', 'close', 252)} + 1e-9) - 1 AS Distance_52W_High,
  close / ({roll('min', 'close', 252)} + 1e-9) - 1 AS Distance_52W_Low FROM ret""",
    {"Drawdown_60": None, "Distance_52W_High": None, "Distance_52W_Low": None},
)



def _recovery_quality(low: str) -> str:
    return f"""WITH RECURSIVE {RETURNS}, {ewm_cte('e', {'e55': ('close', 2 / 56)})},
w AS (SELECT a.ticker, a.date, a.rn AS now, unnest(range(0, 60)) AS back FROM ret a WHERE a.rn >= 60),
p AS (SELECT w.ticker, w.date, max_by(w.back, (-b.close, w.back)) AS days
  FROM w JOIN ret b ON b.ticker = w.ticker AND b.rn = w.now - w.back GROUP BY 1, 2),
q AS (SELECT ret.*, e55, {roll('min', low, 20)} AS low20, {roll('min', 'close', 60)} AS min60,
  {roll('max', 'close', 60)} AS max60 FROM ret JOIN e USING (ticker, rn))
SELECT ticker, date, close / (min60 + 1e-9) - 1 AS Recovery_20_From_60D_Low,
  (close / c10 - 1) / 10 AS Recovery_Slope_10, CAST(p.days AS double) AS Days_Since_60D_Low,
  CASE WHEN close > e55 THEN 1.0::double ELSE 0 END AS Reclaim_EMA55,
  (close - e55) / (e55 + 1e-9) AS Dist_EMA55,
  CASE WHEN low20 > {lag('low20', 20)} THEN 1.0::double ELSE 0 END AS Higher_Low_20,
  (close / (min60 + 1e-9) - 1) / (abs(close / (max60 + 1e-9) - 1) + 1e-9) AS Drawdown_Recovery_Ratio
FROM q LEFT JOIN p USING (ticker, date)"""


_QUALITY = {
    "Recovery_20_From_60D_Low": None, "Recovery_Slope_10": None, "Days_Since_60D_Low": None,
    "Reclaim_EMA55": None, "Dist_EMA55": 6, "Higher_Low_20": None, "Drawdown_Recovery_Ratio": None,
}
_family("recovery_quality", _recovery_quality("close"), _QUALITY)
_family(
    "recovery_quality_low_column",
    f"SELECT ticker, date, Higher_Low_20 FROM ({_recovery_quality('low')}) q",
    {"Higher_Low_20": None},
    low_source="low",
)

_family(
    "liquidity_cost",
    f"""WITH {RETURNS} SELECT ticker, date, dv AS Dollar_Volume, ln(dv + 1e-9) AS Log_Dollar_Volume,
  (dv - {roll('avg', 'dv', 60)}) / ({roll('stddev_samp', 'dv', 60)} + 1e-9) AS Dollar_Volume_Z_60,
  volume / ({roll('avg', 'volume', 20)} + 1e-9) AS Volume_Dry_Up_20,
  {roll('avg', 'impact', 20)} AS Amihud_Illiquidity_20,
  dv / ({roll('avg', 'dv', 20)} + 1e-9) AS Liquidity_Shock_20 FROM ret""",
    {"Dollar_Volume": None, "Log_Dollar_Volume": 6, "Dollar_Volume_Z_60": 4, "Volume_Dry_Up_20": 6,
     "Amihud_Illiquidity_20": 10, "Liquidity_Shock_20": 5},
)

_family(
    "noise_filter",
    f"""WITH {RETURNS}, v AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS vol FROM ret)
SELECT ticker, date, (vol - {roll('avg', 'vol', 60)}) / ({roll('stddev_samp', 'vol', 60)} + 1e-9) AS Volatility_Z_60,
  {roll('stddev_samp', 'fall', 20)} AS Downside_Volatility_20,
  abs(close - c20) / ({roll('sum', 'step', 20)} + 1e-9) AS Trend_Efficiency_20,
  abs(close - c20) / ({roll('sum', 'step', 20)} + 1e-9) AS ER_20,
  abs(close - c30) / ({roll('sum', 'step', 30)} + 1e-9) AS ER_30 FROM v""",
    {"Volatility_Z_60": 4, "Downside_Volatility_20": 5, "Trend_Efficiency_20": 5, "ER_20": 5, "ER_30": 5},
)
