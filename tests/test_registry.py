import pytest
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.operators import registry as G

SIZES = {  # fixed values: published set sizes
    "baseline": 18, "candidate_momentum_v1": 22, "candidate_trend_quality_v1": 22, "candidate_volume_v1": 21,
    "candidate_recovery_v1": 21, "candidate_light_combo_v1": 25, "candidate_valuation_v1": 23,
    "candidate_valuation_plus_trend_v1": 27, "candidate_recovery_valuation_v1": 26, "candidate_trend_recovery_v1": 25,
    "ablation_trend_recovery_full_v1": 25, "ablation_trend_recovery_minus_trend_v1": 21,
    "ablation_trend_recovery_minus_recovery_v1": 22, "ablation_trend_recovery_minus_rsi_v1": 24,
    "ablation_trend_recovery_minus_drawdown_recovery_v1": 20, "ablation_trend_recovery_minus_market_regime_v1": 21,
    "ablation_recovery_valuation_full_v1": 26, "ablation_recovery_valuation_minus_recovery_v1": 23,
    "ablation_recovery_valuation_minus_valuation_v1": 21, "candidate_cost_resilient_recovery_v1": 39,
    "ablation_cost_resilient_recovery_full_v1": 39, "candidate_cost_resilient_recovery_no_noise_v1": 34,
    "ablation_cost_resilient_recovery_minus_liquidity_v1": 33,
    "ablation_cost_resilient_recovery_minus_recovery_quality_v1": 32,
    "ablation_cost_resilient_recovery_minus_noise_filter_v1": 34,
}


def test_set_sizes():
    assert {name: len(columns) for name, columns in G.feature_sets().items()} == SIZES


def test_name_tokens_remove_look_alikes():
    sets = G.feature_sets()
    gone = set(sets["candidate_trend_recovery_v1"]) - set(sets["ablation_trend_recovery_minus_drawdown_recovery_v1"])
    assert gone == {"Drawdown_60", "Distance_52W_High", "Distance_52W_Low", "Dist_BB_Lower", "Market_Distance_EMA"}
    gone = set(sets["candidate_trend_recovery_v1"]) - set(sets["ablation_trend_recovery_minus_market_regime_v1"])
    assert gone == {"VN_Return", "VN_Volatility", "Relative_Strength", "Market_Distance_EMA"}


def test_set_algebra_as_tables(spark):
    members = G.feature_sets_frame(spark)
    assert members.count() == sum(SIZES.values())
    doubled = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "a"), ("s", 4, "c")],
                                    "feature_set string, ordinal int, feature string")
    distinct = G.ordered_distinct(doubled, ["feature_set"])
    assert sorted((r.ordinal, r.feature) for r in distinct.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    left = G.subtract(distinct, spark.createDataFrame([("b",)], "feature string"))
    assert sorted(r.feature for r in left.collect()) == ["a", "c"]
    full = members.where("feature_set = 'candidate_recovery_valuation_v1'")
    without = G.subtract(full, spark.createDataFrame([(c,) for c in G.VALUATION], "feature string"))
    assert without.count() == SIZES["ablation_recovery_valuation_minus_valuation_v1"]


def test_missing_columns_are_named(spark):
    df = spark.range(1).withColumn("RSI_14", F.lit(1.0))
    assert G.check_columns(df, ["rsi_14"]) == ["rsi_14"]
    with pytest.raises(ValueError, match="PB"):
        G.check_columns(df, ["RSI_14", "PB"])


def test_health_statuses(spark):
    rows = [("A", float(i), 5.0, None if i < 5 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "ticker string, ok double, flat double, thin double")
    got = {r.Feature: r for r in G.feature_health(df, ["ticker"], {"s": ["ok", "flat", "thin", "none"]}).collect()}
    assert {n: r.Status for n, r in got.items()} == {
        "ok": "ok", "flat": "zero_variance", "thin": "high_missing", "none": "missing_column"}
    assert (got["thin"].Missing_Pct, got["thin"].Unique_Count, got["none"].Missing_Pct) == (0.5, 5, 1.0)


def test_profile_grids():
    sizes = {name: len(K.grid_rows(name, spec)) for name, spec in K.PROFILES.items()}
    assert sizes == {"FAST_SWING": 40, "SWING": 60, "POSITION": 90}
    assert len(K.grid_rows("G", K.GLOBAL_GRID)) == 360
    first = K.grid_rows("FAST_SWING", K.PROFILES["FAST_SWING"])[:6]
    assert [s["THRESH"] for s in first] == [0.5, 0.55, 0.6, 0.65, 0.7, 0.5]
    assert first[5]["SL"] == -0.05 and first[5]["Grid_Ordinal"] == 6


def test_registered_health_covers_every_set(spark, small_sf):
    from barloom.catalog import QUERIES
    from check_oracle import compare, connect

    q = QUERIES["feature_health_registry"]
    got = q.run(spark, small_sf).toPandas()
    assert got.groupby("Feature_Set").Feature.nunique().to_dict() == SIZES
    assert got.Feature.nunique() == 55 and "missing_column" not in set(got.Status)
    assert compare(got, connect(small_sf).execute(q.oracle()).df()) == "ok"
