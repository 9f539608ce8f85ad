"""Named feature sets as data: additions, removals and name-token ablations.

``feature_sets()`` gives select lists; ``feature_sets_frame`` gives the same as a table
(feature_set, ordinal, feature) and derives ablations with joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: feature names and set names ----------------------------------------------------

BASELINE = [
    "Log_Return", "RSI_14", "Momentum_14", "Volatility", "Volume", "MACD_Hist_Custom",
    "EMA_13_21_Cross", "Dist_EMA_13", "Dist_BB_Upper", "Dist_BB_Lower", "VN_Return", "VN_Volatility",
    "Relative_Strength", "RS_Trend", "Market_Distance_EMA", "Foreign_Net_5D", "Foreign_Net_20D_Mean",
    "Foreign_Mutation",
]
MOMENTUM = ["Abs_Momentum_14", "Log_Momentum_14", "EWM_Return_10", "Momentum_Dropoff_Z_14"]
TREND = ["ER_10", "EMA_13_Slope", "EMA_21_55_Gap", "BB_Position"]
VOLUME = ["Volume_Ratio_20", "Log_Volume_Change", "Foreign_Net_5D_Ratio"]
RECOVERY = ["Drawdown_60", "Distance_52W_High", "Distance_52W_Low"]
LIGHT_COMBO = [
    "Log_Momentum_14", "EWM_Return_10", "Momentum_Dropoff_Z_14", "ER_10", "Volume_Ratio_20",
    "Drawdown_60", "Distance_52W_High",
]
VALUATION = ["PB", "Book_to_Market", "Log_PB", "PB_Z_756", "PB_Percentile_756"]
VALUATION_TREND = ["ER_10", "Volume_Ratio_20", "Drawdown_60", "Distance_52W_High"]
LIQUIDITY = [
    "Dollar_Volume", "Log_Dollar_Volume", "Dollar_Volume_Z_60", "Volume_Dry_Up_20",
    "Amihud_Illiquidity_20", "Liquidity_Shock_20",
]
RECOVERY_QUALITY = [
    "Recovery_20_From_60D_Low", "Recovery_Slope_10", "Days_Since_60D_Low", "Reclaim_EMA55",
    "Dist_EMA55", "Higher_Low_20", "Drawdown_Recovery_Ratio",
]
NOISE = ["Volatility_Z_60", "Downside_Volatility_20", "Trend_Efficiency_20", "ER_20", "ER_30"]

RSI_TOKENS = ["RSI"]
DRAWDOWN_TOKENS = ["DRAWDOWN", "RECOVERY", "52W", "LOW", "HIGH", "DISTANCE"]
MARKET_TOKENS = ["VN_", "VNINDEX", "MARKET", "INDEX", "RELATIVE", "RS_VN"]

# name -> (set it starts from, columns added, columns removed, name tokens removed)
SPECS: dict[str, tuple[str | None, list[str], list[str], list[str]]] = {
    "baseline": (None, BASELINE, [], []),
    "candidate_momentum_v1": ("baseline", MOMENTUM, [], []),
    "candidate_trend_quality_v1": ("baseline", TREND, [], []),
    "candidate_volume_v1": ("baseline", VOLUME, [], []),
    "candidate_recovery_v1": ("baseline", RECOVERY, [], []),
    "candidate_light_combo_v1": ("baseline", LIGHT_COMBO, [], []),
    "candidate_valuation_v1": ("baseline", VALUATION, [], []),
    "candidate_valuation_plus_trend_v1": ("candidate_valuation_v1", VALUATION_TREND, [], []),
    "candidate_recovery_valuation_v1": ("candidate_recovery_v1", VALUATION, [], []),
    "candidate_trend_recovery_v1": ("candidate_trend_quality_v1", RECOVERY, [], []),
    "ablation_trend_recovery_full_v1": ("candidate_trend_recovery_v1", [], [], []),
    "ablation_trend_recovery_minus_trend_v1": ("candidate_trend_recovery_v1", [], TREND, []),
    "ablation_trend_recovery_minus_recovery_v1": ("candidate_trend_recovery_v1", [], RECOVERY, []),
    "ablation_trend_recovery_minus_rsi_v1": ("candidate_trend_recovery_v1", [], [], RSI_TOKENS),
    "ablation_trend_recovery_minus_drawdown_recovery_v1": ("candidate_trend_recovery_v1", [], [], DRAWDOWN_TOKENS),
    "ablation_trend_recovery_minus_market_regime_v1": ("candidate_trend_recovery_v1", [], [], MARKET_TOKENS),
    "ablation_recovery_valuation_full_v1": ("candidate_recovery_valuation_v1", [], [], []),
    "ablation_recovery_valuation_minus_recovery_v1": ("candidate_recovery_valuation_v1", [], RECOVERY, []),
    "ablation_recovery_valuation_minus_valuation_v1": ("candidate_recovery_valuation_v1", [], VALUATION, []),
    "candidate_cost_resilient_recovery_v1": (
        "ablation_trend_recovery_minus_market_regime_v1", LIQUIDITY + RECOVERY_QUALITY + NOISE, [], [],
    ),
    "ablation_cost_resilient_recovery_full_v1": ("candidate_cost_resilient_recovery_v1", [], [], []),
    "candidate_cost_resilient_recovery_no_noise_v1": ("candidate_cost_resilient_recovery_v1", [], NOISE, []),
    "ablation_cost_resilient_recovery_minus_liquidity_v1": ("candidate_cost_resilient_recovery_v1", [], LIQUIDITY, []),
    "ablation_cost_resilient_recovery_minus_recovery_quality_v1": (
        "candidate_cost_resilient_recovery_v1", [], RECOVERY_QUALITY, [],
    ),
    "ablation_cost_resilient_recovery_minus_noise_filter_v1": ("candidate_cost_resilient_recovery_v1", [], NOISE, []),
}

# --------------------------------------------------------------------------------------------------


def feature_sets() -> dict[str, list[str]]:
    """Every set's ordered, distinct column list."""
    sets: dict[str, list[str]] = {}
    for name, (parent, added, removed, tokens) in SPECS.items():
        columns = dict.fromkeys([*sets.get(parent, []), *added])
        sets[name] = [
            c for c in columns if c not in removed and not any(t in c.upper() for t in tokens)
        ]
    return sets


def feature_sets_frame(spark: SparkSession, sets: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [
        (name, ordinal, feature)
        for name, columns in (sets or feature_sets()).items()
        for ordinal, feature in enumerate(columns, start=1)
    ]
    return spark.createDataFrame(rows, "feature_set string, ordinal int, feature string")


def ordered_distinct(members: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct features per set, each at its first ordinal, renumbered without gaps."""
    first = members.groupBy(*keys, "feature").agg(F.min("ordinal").alias("ordinal"))
    order = Window.partitionBy(*keys).orderBy("ordinal")
    return first.withColumn("ordinal", F.row_number().over(order))


def subtract(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Set difference on the feature name, order kept."""
    return members.join(removed.select("feature").distinct(), "feature", "left_anti")


def check_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The column list, or a ValueError naming what the frame lacks."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in have]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return columns


def feature_health(
    df: DataFrame, keys: list[str], sets: dict[str, list[str]], high_missing: float = 0.30
) -> DataFrame:
    """Per key, set and feature: missing share, distinct values, mean, deviation and a status.

    Statistics are computed once per feature, in one wide combining aggregation, and joined to the
    sets by name. Exact distinct counts are the only part that has to move values; they are spread
    by (key, feature, value), so no key or value gathers in one task.
    """
    have = {c.lower() for c in df.columns}
    names = sorted({c for columns in sets.values() for c in columns})
    present = [n for n in names if n.lower() in have]
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[x for n in present for x in (
            F.count(n).alias(f"c_{n}"), F.avg(n).alias(f"m_{n}"), F.stddev_samp(n).alias(f"s_{n}"))],
    )
    stats = wide.select(
        *keys,
        F.inline(F.array(*[
            F.struct(
                F.lit(n).alias("Feature"),
                (F.lit(1.0) - F.col(f"c_{n}") / F.col("rows")).alias("Missing_Pct")
                if n in present else F.lit(1.0).alias("Missing_Pct"),
                (F.col(f"m_{n}") if n in present else F.lit(None).cast("double")).alias("Mean"),
                (F.col(f"s_{n}") if n in present else F.lit(None).cast("double")).alias("Std"),
                F.lit(n in present).alias("present"),
            )
            for n in names
        ])),
    )
    values = df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("Feature"), F.col(n).cast("double").alias("value")) for n in present
        ])),
    ).where("value IS NOT NULL").distinct()
    distinct = values.groupBy(*keys, "Feature").agg(F.count(F.lit(1)).alias("Unique_Count"))
    members = [(name, feature) for name, columns in sets.items() for feature in columns]
    # the registry is a fixed list of a few hundred names
    registry = F.broadcast(df.sparkSession.createDataFrame(members, "Feature_Set string, Feature string"))
    joined = stats.join(distinct, [*keys, "Feature"], "left").join(registry, "Feature")
    unique = F.coalesce("Unique_Count", F.lit(0))
    flat = (unique <= 1) | F.col("Std").isNull() | (F.col("Std") == 0)
    return joined.select(
        *keys,
        "Feature_Set",
        "Feature",
        "Missing_Pct",
        unique.alias("Unique_Count"),
        "Mean",
        "Std",
        (~F.col("present") | flat).alias("Zero_Variance"),
        F.when(~F.col("present"), "missing_column")
        .when(flat, "zero_variance")
        .when(F.col("Missing_Pct") > high_missing, "high_missing")
        .otherwise("ok")
        .alias("Status"),
    )
