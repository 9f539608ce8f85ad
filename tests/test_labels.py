import numpy as np
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.operators import evaluate as E
from barloom.operators.labels import (
    add_paths, complete_rows, explode_labels, fold_segment, label_frame, latest_complete, training_rows,
)
from barloom.operators.windows import Series
from barloom.plans import search
from series import make_bars

GRID = [(5, 0.04, -0.03), (10, 0.06, -0.03), (10, 0.20, -0.20)]


def literal_label(close, i, lookahead, tp, sl):
    for j in range(1, lookahead + 1):
        move = (close[i + j] - close[i]) / close[i]
        if move <= sl:
            return 0, j, move, "sl", 0
        if move >= tp:
            return 1, j, move, "tp", 0
    return 0, lookahead, move, "timeout", 1


def bars(spark, rows=300, tickers=2):
    pdf = make_bars(tickers, rows)
    return pdf, spark.createDataFrame(pdf).withColumnRenamed("close", "Close")


def test_labels_match_a_literal_loop(spark):
    pdf, df = bars(spark)
    s = Series(["ticker"])
    out = explode_labels(add_paths(df, s, 10).select("ticker", "date", "future"), GRID).toPandas()
    seen = 0
    for ticker, g in pdf.groupby("ticker"):
        close, dates = g["close"].to_numpy(), list(g["date"])
        mine = out[out["ticker"] == ticker].set_index(["date", "LOOKAHEAD", "TP"])
        for la, tp, sl in GRID:
            for i in range(len(close) - la):
                row = mine.loc[(dates[i], la, tp)]
                want = literal_label(close, i, la, tp, sl)
                got = (row.Target, row.Holding_Days, row.Exit_Return, row.Exit_Reason, row.Timeout)
                assert got == want
                seen += 1
    # the last rows have no label, whatever happened before the end
    assert seen == len(out)
    assert {"sl", "tp", "timeout"} == set(out["Exit_Reason"])


def test_fold_segments_follow_the_expanding_split(spark):
    for n in (100, 103, 250):
        test = n // 4
        want = [0 if i < n - 3 * test else 1 + (i - (n - 3 * test)) // test for i in range(n)]
        df = spark.range(n).select(fold_segment(F.col("id"), F.lit(n)).alias("s"), "id").orderBy("id")
        assert [r.s for r in df.collect()] == want


def literal_metrics(close, score, ok, la, tp, sl, threshold):
    labeled = [(literal_label(close, i, la, tp, sl), score[i]) for i in range(len(close) - la) if ok[i]]
    n = len(labeled)
    test = n // 4
    trades = correct = tested = positive = returns = 0
    precisions = []
    for fold in range(3):
        start = n - (3 - fold) * test
        train = [x[0][0] for x in labeled[:start]]
        if len(set(train)) < 2:
            continue
        part = labeled[start:start + test]
        tested += len(part)
        positive += sum(x[0][0] for x in part)
        hits = [x[0] for x in part if x[1] >= threshold]
        if hits:
            precisions.append(sum(h[0] for h in hits) / len(hits))
            trades += len(hits)
            correct += sum(h[0] for h in hits)
            returns += sum(h[2] for h in hits)
    return n, trades, correct, positive / max(tested, 1), len(precisions), np.std(precisions), returns


def test_grid_metrics_match_a_literal_evaluation(spark):
    pdf, _ = bars(spark, 400)
    rng = np.random.default_rng(1)
    pdf["score"] = rng.uniform(0, 1, len(pdf))
    pdf["ok"] = rng.uniform(0, 1, len(pdf)) > 0.1
    df = spark.createDataFrame(pdf).withColumnRenamed("close", "Close")
    setups = K.grid_rows("P", {"lookahead": [5, 10], "tp": [0.04], "sl": [-0.03], "threshold": [0.5, 0.9]})
    got = search.grid_metrics(df, ["ticker"], setups, F.col("ok"), {"baseline": F.col("score")}).toPandas()
    assert len(got) == 8
    for _, row in got.iterrows():
        g = pdf[pdf["ticker"] == row.ticker]
        n, trades, correct, base, folds, spread, returns = literal_metrics(
            g["close"].to_numpy(), g["score"].to_numpy(), g["ok"].to_numpy(),
            row.LOOKAHEAD, row.TP, row.SL, row.THRESH,
        )
        assert (row.Rows, row.Trades, row.Valid_Folds) == (n, trades, folds)
        np.testing.assert_allclose(
            [row.Validation_Precision, row.Base_Rate, row.Precision_Std, row.Avg_Return],
            [correct / trades, base, spread, returns / trades], atol=1e-12,
        )


def test_single_class_training_folds_are_left_out_with_their_base_counts(spark):
    rows = [("a", 5, 0.1, -0.1, 200, seg, 0.9, int(seg > 1 and i % 2), 0.0, 1, 0)
            for seg in range(4) for i in range(50)]
    df = spark.createDataFrame(
        rows, "ticker string, LOOKAHEAD int, TP double, SL double, Rows long, segment int, score double, "
        "Target int, Exit_Return double, Holding_Days int, Timeout int")
    folds = {r.Fold: r for r in E.fold_stats(df, ["ticker"], [0.5]).collect()}
    # folds 1 and 2 train on negatives only
    assert set(folds) == {3}
    assert folds[3].Train_Count == 150 and folds[3].Train_Positive == 25


def test_too_few_rows_give_no_folds(spark):
    _, df = bars(spark, 90, 1)
    df = df.withColumn("score", F.lit(0.9))
    labeled = label_frame(df, ["ticker"], [(5, 0.04, -0.03)], F.lit(True), ["score"])
    assert E.fold_stats(labeled, ["ticker"], [0.5]).count() == 0


def test_no_trades_keep_null_metrics_and_zero_precision(spark):
    _, df = bars(spark, 200, 1)
    setups = K.grid_rows("P", {"lookahead": [5], "tp": [0.04], "sl": [-0.03], "threshold": [0.5]})
    metrics = search.grid_metrics(df, ["ticker"], setups, F.lit(True), {"baseline": F.lit(0.1)})
    row = search.profile_results(metrics, setups).first()
    assert (row.Trades, row.Validation_Precision, row.Research_Status) == (0, 0.0, "NO_SIGNAL")
    assert row.Score is None and row.Base_Rate is None and row.Pass_Tradeable_Rule is False
    best = search.best_setups(search.profile_results(metrics, setups), ["ticker", "Feature_Set"], setups)
    filled = best.first()
    assert (filled.Research_Status, filled.Reject_Note) == ("NO_SIGNAL", "no_valid_evaluation")
    assert filled.LOOKAHEAD is None and (filled.Trades, filled.Rows, filled.Evaluated_Setups) == (0, 0, 1)


def test_equal_scores_go_to_the_earlier_grid_row(spark):
    setups = K.grid_rows("P", {"lookahead": [5, 6], "tp": [0.1], "sl": [-0.1], "threshold": [0.5]})
    rows = [("a", "P", s["LOOKAHEAD"], 0.25 + i * 1e-14, s["Grid_Ordinal"]) for i, s in enumerate(setups)]
    df = spark.createDataFrame(rows, "ticker string, Profile string, LOOKAHEAD int, Score double, Grid_Ordinal int")
    best = search.best_setups(df, ["ticker"], setups).first()
    assert (best.LOOKAHEAD, best.Evaluated_Setups) == (5, 2)


def test_setup_precedence(spark):
    schema = "ticker string, Profile string, LOOKAHEAD int, TP double, SL double, THRESH double, Score double"
    best = spark.createDataFrame([("a", "P", 5, .1, -.1, .5, 0.2), ("a", "P", 6, .1, -.1, .5, 0.3)], schema)
    diag = spark.createDataFrame([("a", "P", 7, .1, -.1, .5, 0.9), ("b", "P", 8, .1, -.1, .5, None),
                                  ("b", "P", 9, .1, -.1, .5, -1.0)], schema)
    got = {r.ticker: (r.LOOKAHEAD, r.Setup_Source) for r in search.resolve_setups(None, best, diag, ["ticker", "Profile"]).collect()}
    assert got == {"a": (6, "best_params"), "b": (9, "setup_diagnostics_fallback")}


def test_training_rows_stop_before_the_latest_complete_row(spark):
    _, df = bars(spark, 150, 1)
    last = df.agg(F.max("date")).first()[0]
    df = df.withColumn("x", F.when(F.col("date") < last, 1.0))
    latest = latest_complete(df, ["ticker"], complete_rows(["x"]), ["x"])
    row = latest.first()
    assert (row.Latest_Data_Date - row.Latest_Feature_Date).days == row.Data_Lag_Days == 1
    train = training_rows(label_frame(df, ["ticker"], [(5, .04, -.03)], complete_rows(["x"]), []), latest, ["ticker"])
    assert train.count() == 145 and train.agg(F.max("date")).first()[0] < row.Latest_Feature_Date
