import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.features import add_features
from barloom.operators.windows import Ewm, Series, add_ewm, ewm_block_rows, ewm_of_ewm
from series import make_bars


def test_ewm_matches_recursion_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    n = 9000  # several blocks of 2048 rows
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    pdf = pd.DataFrame({"k": "a", "date": np.arange(n), "x": x})
    pdf["y"] = pdf["x"].diff()
    specs = [Ewm.span("e10", "x", 10), Ewm.span("e50", "x", 50), Ewm.span("e100", "x", 100),
             Ewm("w14", "x", 1 / 14), Ewm.span("second", "y", 10, seed_row=2)]
    s = Series(["k"])
    df = spark.createDataFrame(pdf.astype({"y": object}).where(pdf.notna(), None), "k string, date long, x double, y double")
    df = add_ewm(df.withColumn("rn", s.row_number()), s, specs, "rn")
    df = df.withColumn("signal", ewm_of_ewm(100, 10, F.col("e100"), F.col("e10")))
    out = df.orderBy("date").toPandas()
    for name, span in (("e10", 10), ("e50", 50), ("e100", 100)):
        np.testing.assert_allclose(out[name], pdf["x"].ewm(span=span, adjust=False).mean(), rtol=1e-12)
    np.testing.assert_allclose(out["w14"], pdf["x"].ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-12)
    expected = pdf["x"].ewm(span=10, adjust=False).mean().ewm(span=100, adjust=False).mean()
    np.testing.assert_allclose(out["signal"], expected, rtol=1e-11)
    assert pd.isna(out["second"][0])
    np.testing.assert_allclose(out["second"][1:], pdf["y"].ewm(span=10, adjust=False).mean()[1:], atol=1e-10)


def test_ewm_spans_too_far_apart_are_refused():
    with pytest.raises(ValueError):
        ewm_block_rows([Ewm.span("a", "x", 2), Ewm.span("b", "x", 200)])


def test_roll_needs_enough_non_null_values(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, None, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "k string, date int, x double")
    s = Series(["k"])
    out = df.select(
        "date", s.roll("x", 2, F.avg).alias("m"), s.roll("x", 3, F.stddev_samp, 2).alias("d")
    ).orderBy("date").collect()
    assert [r.m for r in out] == [None, None, None, 3.5, 4.5]
    assert [None if r.d is None else round(r.d, 6) for r in out] == [None, None, 1.414214, 0.707107, 1.0]


def _expected(g: pd.DataFrame) -> pd.DataFrame:
    c, v, n, vn = g["close"], g["volume"], g["net_volume_foreign"], g["vn_close"]
    r = np.log(c / c.shift())
    gain = c.diff().clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-c.diff()).clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False).mean()
    macd = c.ewm(span=10, adjust=False).mean() - c.ewm(span=50, adjust=False).mean()
    dv, vol = c * v, r.rolling(20).std()
    low20 = c.rolling(20).min()
    return pd.DataFrame({
        "RSI_14": 100 - 100 / (1 + gain / (loss + 1e-9)),
        "MACD_Hist_Custom": macd - macd.ewm(span=100, adjust=False).mean(),
        "BB_Std": c.rolling(20).std(ddof=0),
        "Volatility": vol,
        "EWM_Return_10": r.ewm(span=10, adjust=False).mean(),
        "Distance_52W_High": c / (c.rolling(252).max() + 1e-9) - 1,
        "Days_Since_60D_Low": c.rolling(60).apply(lambda w: 59 - int(np.argmin(w)), raw=True),
        "Higher_Low_20": (low20 > low20.shift(20)).astype(float),
        "Reclaim_EMA55": (c > c.ewm(span=55, adjust=False).mean()).astype(float),
        "Volatility_Z_60": (vol - vol.rolling(60).mean()) / (vol.rolling(60).std() + 1e-9),
        "Downside_Volatility_20": r.where(r < 0, 0.0).rolling(20).std(),
        "Amihud_Illiquidity_20": (r.abs() / (dv + 1e-9)).rolling(20).mean(),
        "Foreign_Mutation": (n - n.rolling(20).mean()) / (n.rolling(20).std() + 1e-9),
        "RS_Trend": (r - np.log(vn / vn.shift())).rolling(10).mean(),
        "ER_30": (c - c.shift(30)).abs() / (c.diff().abs().rolling(30).sum() + 1e-9),
    })


def test_features_match_pandas(spark):
    pdf = make_bars()
    got = add_features(spark.createDataFrame(pdf)).orderBy("ticker", "date").toPandas()
    for ticker, g in pdf.groupby("ticker"):
        want = _expected(g.reset_index(drop=True))
        have = got[got["ticker"] == ticker].reset_index(drop=True)
        for name in want:
            np.testing.assert_allclose(have[name], want[name], rtol=1e-8, atol=1e-10, err_msg=name)


def test_first_row_of_rsi_is_zero_and_flags_are_never_null(spark):
    got = add_features(spark.createDataFrame(make_bars(1, 30)), columns=["RSI_14", "Reclaim_EMA55", "Higher_Low_20"])
    rows = got.orderBy("date").collect()
    assert rows[0].RSI_14 == 0.0
    assert all(r.Reclaim_EMA55 is not None and r.Higher_Low_20 == 0.0 for r in rows)


def test_missing_foreign_flow_is_zero(spark):
    df = spark.createDataFrame(make_bars(1, 30)).drop("net_volume_foreign")
    row = add_features(df, columns=["Foreign_Net_5D", "Foreign_Mutation"], foreign=False).first()
    assert (row.Foreign_Net_5D, row.Foreign_Mutation) == (0.0, 0.0)
