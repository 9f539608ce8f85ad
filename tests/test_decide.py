import pytest
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.operators import decide as D
from barloom.operators import evaluate as E
from barloom.operators import stability as S
from barloom.operators.joins import keep_long_series, spread_periods

# fixed values: published results of one feature set over four periods
# period, tp, sl, score, precision, precision std, excess, edge, trades, folds, return, holding, per day, timeout
PUBLISHED = [
    ("P1", 0.08, -0.05, 0.0831838980764759, 0.5178197064989518, 0.1572661839863822, 0.0795218341585262,
     0.1332043218835671, 477, 3, 0.0326694444001676, 18.465408805031448, 0.0017692239984146, 0.1530398322851153),
    ("P2", 0.10, -0.07, 0.4555776698087884, 0.6309523809523809, 0.2023809523809524, 0.3309523809523809,
     0.2191876750700279, 84, 2, 0.0678330993916437, 11.273809523809524, 0.0060168747079119, 0.2261904761904762),
    ("P3", 0.10, -0.05, 0.2018511620029596, 0.6736842105263158, 0.2052457149112737, 0.0564002599090318,
     0.3403508771929824, 95, 3, 0.0692700605936321, 11.189473684210526, 0.0061906451136471, 0.0631578947368421),
    ("P4", 0.08, -0.07, 0.259935204006541, 0.6825396825396826, 0.1188450988117449, 0.1985214176994999,
     0.2158730158730159, 126, 3, 0.0481565561744328, 16.547619047619047, 0.0029101803729553, 0.0714285714285714),
]
NAMES = ["Period_Label", "TP", "SL", "Published_Score", "Validation_Precision", "Precision_Std", "Excess_Precision",
         "Published_Edge", "Trades", "Valid_Folds", "Avg_Return", "Avg_Holding_Days", "Expectancy_Per_Day", "Timeout_Rate"]


@pytest.fixture(scope="module")
def graded(spark):
    df = spark.createDataFrame(PUBLISHED, NAMES).withColumns(
        {"Max_Avg_Holding_Days": F.lit(25.0), "Max_Timeout_Rate": F.lit(0.45), "Feature_Set": F.lit("candidate")})
    return E.grade(df, 0.0, 0.02).cache()


def test_score_edge_and_status_follow_published_rows(graded):
    for r in graded.collect():
        assert r.Score == pytest.approx(r.Published_Score, abs=1e-12)
        assert r.Edge_vs_Breakeven == pytest.approx(r.Published_Edge, abs=1e-12)
        assert (r.Pass_Tradeable_Rule, r.Research_Status) == (True, "TRADEABLE_EDGE")


def test_stability_follows_published_summary(graded):
    r = S.stability(graded, ["Feature_Set"], 0.02).first()
    assert (r.Periods, r.Pass_Periods, r.Pass_Rate, r.Total_Trades, r.Avg_Trades) == (4, 4, 1.0, 782, 195.5)
    assert r.Avg_Score == pytest.approx(0.25013698347369123, abs=1e-12)
    assert r.Avg_Edge == pytest.approx(0.22715397250489833, abs=1e-12)
    assert r.Min_Edge == pytest.approx(0.1332043218835671, abs=1e-12)
    assert r.Avg_Timeout_Rate == pytest.approx(0.12845419366025124, abs=1e-12)
    assert r.Stable_Strict_Candidate is True


def test_reject_reasons(spark):
    rows = [  # fixed values: published diagnostics
        (0.2747252747252747, 0.0639215856607161, 637, 3, 0.0117626180049822, 6.79905808477237, 0.401883830455259,
         "low_precision,timeout_rate_too_high"),
        (0.2443729903536977, 0.0397177422201887, 622, 3, 0.0064170960596309, 6.454983922829582, 0.3569131832797427,
         "low_precision"),
        (0.1983805668016194, -0.0124231222629391, 247, 3, -0.0018753281484906, 6.809716599190283, 0.4251012145748988,
         "low_precision,low_excess_precision,timeout_rate_too_high"),
        (0.6, 0.1, 4, 0, -0.02, 16.0, 0.1,
         "insufficient_valid_folds,insufficient_trades,non_positive_avg_return,avg_holding_too_long"),
        (0.6, 0.1, 50, 3, 0.01, 5.0, 0.1, ""),
    ]
    names = ["Validation_Precision", "Excess_Precision", "Trades", "Valid_Folds", "Avg_Return", "Avg_Holding_Days",
             "Timeout_Rate", "want"]
    df = spark.createDataFrame(rows, names).withColumns(
        {"Max_Avg_Holding_Days": F.lit(15.0), "Max_Timeout_Rate": F.lit(0.40)})
    assert all(r.got == r.want for r in df.withColumn("got", E.reject_reasons()).collect())


DELTAS = [f"{m}_Delta_vs_Baseline" for m in
          ("Score", "Edge_vs_Breakeven", "Avg_Return", "Expectancy_Per_Day", "Timeout_Rate", "Trades")]


@pytest.mark.parametrize("deltas,status,want", [
    ((0.1, 0.1, 0.1, 0.1, 0.05, -10), "RESEARCH_EDGE", "ACCEPT_CANDIDATE"),
    ((0.1, 0.1, 0.1, 0.1, None, None), "RESEARCH_EDGE", "ACCEPT_CANDIDATE"),
    ((0.1, 0.1, 0.1, 0.1, 0.2, 0), "RESEARCH_EDGE", "RESEARCH_ONLY"),
    ((0.1, 0.1, 0.1, 0.1, 0.0, -31), "RESEARCH_EDGE", "RESEARCH_ONLY"),
    ((-0.1, 0.0, 0.0, 0.1, 0.0, 0), "NO_EDGE", "DROP_CANDIDATE"),
    ((-0.1, 0.1, 0.0, 0.1, 0.0, 0), "TRADEABLE_EDGE", "TRADEABLE_UPGRADE"),
    ((None, None, None, None, None, None), "TRADEABLE_EDGE", "RESEARCH_ONLY"),
])
def test_verdicts(spark, deltas, status, want):
    schema = "Ticker string, Profile string, Experiment_Mode string, Feature_Set string, Trades int, Research_Status string, " \
        + ", ".join(f"{d} double" for d in DELTAS)
    row = ("A", "P", "fixed_setup", "x", 100, status, *[None if d is None else float(d) for d in deltas])
    df = spark.createDataFrame([row, ("A", "P", "fixed_setup", "baseline", 1, status, *[0.0] * 6)], schema)
    out = D.feature_set_decisions(df).collect()
    assert [r.Decision for r in out] == [want]


def test_candidate_acceptance_and_promotion(spark):
    keys = ["ticker", "Profile"]
    schema = ("ticker string, Profile string, Feature_Set string, LOOKAHEAD int, TP double, SL double, THRESH double, "
              "Pass_Periods int, Min_Edge double, Avg_Return double, Total_Trades int, Frozen_Strict_Candidate string")
    rows = [
        ("A", "P", "no_noise", 40, 0.1, -0.05, 0.6, 3, 0.0733333333333333, 0.0348225473244018, 887, "True"),
        ("A", "P", "no_noise", 20, 0.1, -0.05, 0.6, 4, 0.2, 0.2, 900, "False"),
        ("A", "P", "other", 40, 0.1, -0.05, 0.6, 4, 0.2, 0.2, 900, "True"),
        ("A", "P", "baseline", 20, 0.1, -0.05, 0.6, 2, 0.01, 0.02, 1900, "False"),
        ("B", "P", "no_noise", 40, 0.1, -0.05, 0.6, 3, 0.0133, 0.03, 99, "true"),
        ("C", "P", "no_noise", 40, 0.1 + 1e-12, -0.05, 0.6, 1, None, -0.01, 10, "0"),
    ]
    grid = spark.createDataFrame(rows, schema)
    best = D.select_candidate(grid, keys, ["no_noise", "minus_noise"], tp=0.1)
    assert {r.ticker: r.LOOKAHEAD for r in best.collect()} == {"A": 40, "B": 40, "C": 40}
    checks = D.acceptance_checks(best, keys, min_trades=300)
    a = [(r.Rule, r.Observed, r.Status) for r in checks.where("ticker = 'A'").collect()]
    assert a == [("Pass_Periods >= 3", "3", "PASS"), ("Min_Edge >= 2.00%", "7.33%", "PASS"),
                 ("Avg_Return >= 2.00%", "3.48%", "PASS"), ("Total_Trades >= 300", "887", "PASS")]
    c = {r.Rule: (r.Observed, r.Status) for r in checks.where("ticker = 'C'").collect()}
    assert c["Min_Edge >= 2.00%"] == ("n/a", "FAIL")
    got = {r.ticker: r.Decision for r in D.promotion(best, checks, keys).collect()}
    assert got == {"A": "PROMOTE_TO_PRODUCTION_CANDIDATE", "B": "KEEP_AS_RESEARCH_CANDIDATE", "C": "RESEARCH_ONLY"}
    base = D.select_baseline(grid, keys, "baseline")
    compared = {r.Metric: (r.Candidate, r.Baseline, r.Delta) for r in D.compare_with_baseline(best, base, keys).collect()}
    assert compared["Total Trades"] == ("887", "1,900", "-1,013")
    assert compared["Min Edge"] == ("7.33%", "1.00%", "6.33%")


def test_ablation_uses_full_set_then_candidate(spark):
    rows = [("A", "P", "reoptimized", "ablation_trend_recovery_full_v1", 1.0), ("A", "P", "reoptimized", "candidate_trend_recovery_v1", 5.0),
            ("A", "P", "fixed_setup", "ablation_trend_recovery_minus_rsi_v1", 3.0), ("A", "P", "reoptimized", "ablation_trend_recovery_minus_rsi_v1", 4.0),
            ("B", "P", "reoptimized", "candidate_trend_recovery_v1", 2.0), ("B", "P", "reoptimized", "ablation_trend_recovery_minus_rsi_v1", 1.0),
            ("B", "P", "reoptimized", "baseline", 9.0)]
    df = spark.createDataFrame(rows, "Ticker string, Profile string, Experiment_Mode string, Feature_Set string, Score double")
    df = df.withColumns({m: F.col("Score") for m in S.PERIOD_METRICS if m != "Score"})
    got = {(r.Ticker, r.Experiment_Mode, r.Short_Feature): r.Score_Delta_vs_Full for r in D.ablation_deltas(df, ["Ticker", "Profile"]).collect()}
    assert got == {("A", "reoptimized", "full"): 0.0, ("A", "reoptimized", "candidate_full"): 4.0,
                   ("A", "fixed_setup", "minus_rsi"): 2.0, ("A", "reoptimized", "minus_rsi"): 3.0,
                   ("B", "reoptimized", "candidate_full"): 0.0, ("B", "reoptimized", "minus_rsi"): -1.0}


def test_deltas_without_baseline_are_null(spark):
    df = spark.createDataFrame([("P1", "baseline", 1.0), ("P1", "x", 3.0), ("P2", "x", 5.0)],
                               "Period_Label string, Feature_Set string, Score double")
    got = {(r.Period_Label, r.Feature_Set): r.Score_d for r in S.add_deltas(df, ["Period_Label"], ["Score"], "d").collect()}
    assert got == {("P1", "baseline"): 0.0, ("P1", "x"): 2.0, ("P2", "x"): None}


def test_periods_are_inclusive_and_may_overlap(spark):
    df = spark.createDataFrame([("A", "2018-12-31"), ("A", "2019-01-01"), ("A", "2030-01-01")], "ticker string, d string")
    df = df.select("ticker", F.to_date("d").alias("date"))
    periods = [*K.PERIODS, ("ALL", "2018-12-31", "2019-01-01")]
    got = sorted((r.Period_Label, str(r.date)) for r in spread_periods(df, periods).collect())
    assert got == [("ALL", "2018-12-31"), ("ALL", "2019-01-01"), ("P1_2014_2018", "2018-12-31"), ("P2_2019_2021", "2019-01-01")]
    assert keep_long_series(spread_periods(df, periods), ["Period_Label", "ticker"], 2).count() == 2
