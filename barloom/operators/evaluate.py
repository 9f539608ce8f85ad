"""Walk-forward trade statistics and setup metrics for any score column.

``fold_stats`` is one map-side-combined aggregation over the exploded label rows: all thresholds
are conditional sums of the same pass, so they cost neither rows nor a second scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.functions.rules import breakeven_precision

SETUP = ["LOOKAHEAD", "TP", "SL"]


def segment_stats(labeled: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Per key, setup and segment: row and positive counts, and one struct of trade sums per
    threshold. Expects columns ``score``, the labels, ``segment`` and ``Rows``."""

    def when_hit(threshold: float, value) -> Column:
        return F.coalesce(F.sum(F.when(F.col("score") >= threshold, value)), F.lit(0))

    cells = {
        f"__{name}{i}": when_hit(threshold, value)
        for i, threshold in enumerate(thresholds)
        for name, value in (
            ("t", F.lit(1)), ("c", F.col("Target")), ("r", F.col("Exit_Return")),
            ("h", F.col("Holding_Days")), ("o", F.col("Timeout")),
        )
    }
    totals = labeled.groupBy(*keys, *SETUP, "Rows", "segment").agg(
        F.count(F.lit(1)).alias("count"), F.sum("Target").alias("positive"),
        *[column.alias(name) for name, column in cells.items()],
    )
    per_threshold = F.array(
        *[
            F.struct(
                F.lit(threshold).alias("THRESH"),
                F.col(f"__t{i}").alias("Fold_Trades"),
                F.col(f"__c{i}").alias("Fold_Correct"),
                F.col(f"__r{i}").cast("double").alias("Return_Sum"),
                F.col(f"__h{i}").alias("Holding_Sum"),
                F.col(f"__o{i}").alias("Timeout_Sum"),
            )
            for i, threshold in enumerate(thresholds)
        ]
    )
    return totals.select(
        *keys, *SETUP, "Rows", "segment", "count", "positive", per_threshold.alias("per_threshold")
    )


def fold_table(
    labeled: DataFrame, keys: list[str], thresholds: list[float], min_rows: int = K.MIN_LABELED_ROWS
) -> DataFrame:
    """Per key, setup, threshold and segment, with ``usable``: false for the first training rows, for keys with
    fewer labeled rows than ``min_rows`` and for folds whose training rows show a single class."""
    stats = segment_stats(labeled, keys, thresholds)
    earlier = Window.partitionBy(*keys, *SETUP).orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    stats = stats.withColumns(
        {"Train_Count": F.sum("count").over(earlier), "Train_Positive": F.sum("positive").over(earlier)}
    )
    two_classes = F.coalesce(F.expr("segment > 0 AND Train_Positive > 0 AND Train_Positive < Train_Count"), F.lit(False))
    return stats.select(
        *keys, *SETUP, "Rows", F.col("segment").alias("Fold"), (two_classes & (F.col("Rows") >= min_rows)).alias("usable"),
        F.col("count").alias("Test_Count"), F.col("positive").alias("Test_Positive"),
        "Train_Count", "Train_Positive",
        F.inline("per_threshold"),
    )


def fold_stats(
    labeled: DataFrame, keys: list[str], thresholds: list[float], min_rows: int = K.MIN_LABELED_ROWS
) -> DataFrame:
    """Per key, setup, threshold and fold. Folds that are not usable are left out, base counts included."""
    folds = fold_table(labeled.where(F.col("Rows") >= min_rows), keys, thresholds, min_rows)
    return folds.where("usable").drop("usable")


def class_weight(count: Column, positive: Column) -> Column:
    """Weight of the positive class: negatives per positive, 1 when there is no positive."""
    return F.when(positive == 0, 1.0).otherwise((count - positive) / F.nullif(positive, F.lit(0)))


def setup_metrics(folds: DataFrame, keys: list[str]) -> DataFrame:
    """The fold table to one row of raw metrics per key, setup and threshold. Only usable folds count; a key
    without any has a row with no trades."""
    traded = F.col("usable") & (F.col("Fold_Trades") > 0)
    precision = F.when(traded, F.col("Fold_Correct") / F.nullif(F.col("Fold_Trades"), F.lit(0)))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("usable"), F.col(c))), F.lit(0))
    sums = folds.groupBy(*keys, *SETUP, "THRESH").agg(
        F.max("Rows").alias("Rows"),
        total("Fold_Trades").alias("Trades"),
        total("Fold_Correct").alias("correct"),
        total("Test_Positive").alias("positive"),
        total("Test_Count").alias("tested"),
        F.count(precision).alias("Valid_Folds"),
        F.avg(precision).alias("Mean_Fold_Precision"),
        F.stddev_pop(precision).alias("spread"),
        total("Return_Sum").alias("returns"),
        total("Holding_Sum").alias("holding"),
        total("Timeout_Sum").alias("timeouts"),
    )
    trades = F.nullif(F.col("Trades"), F.lit(0))
    base_rate = F.when(F.col("Trades") > 0, F.col("positive") / F.greatest("tested", F.lit(1)))
    hit_rate = F.col("correct") / trades
    sums = sums.withColumns(
        {
            "Validation_Precision": F.coalesce(hit_rate, F.lit(0.0)),
            "Precision_Std": F.when(F.col("Valid_Folds") > 1, F.col("spread")).when(F.col("Trades") > 0, 0.0),
            "Base_Rate": base_rate,
            "Excess_Precision": hit_rate - base_rate,
            "Precision_Lift": hit_rate / (base_rate + K.EPS),
            "Avg_Return": F.col("returns") / trades,
            "Avg_Holding_Days": F.col("holding") / trades,
            "Timeout_Rate": F.col("timeouts") / trades,
        }
    )
    return sums.withColumn(
        "Expectancy_Per_Day", F.col("Avg_Return") / (F.col("Avg_Holding_Days") + K.EPS)
    ).drop("correct", "positive", "tested", "spread", "returns", "holding", "timeouts")


def score(max_holding: Column) -> Column:
    """Holding-aware ranking score of one row of raw metrics; null without trades."""
    c = F.col
    return (
        c("Excess_Precision")
        + c("Expectancy_Per_Day") * K.EXPECTANCY_SCALE
        + F.least(c("Trades"), F.lit(K.TRADE_BONUS_CAP)) * K.TRADE_BONUS
        - c("Precision_Std") * K.PRECISION_STD_WEIGHT
        - c("Timeout_Rate") * K.TIMEOUT_WEIGHT
        - c("Avg_Holding_Days") / max_holding * K.HOLDING_WEIGHT
    )


def grade(metrics: DataFrame, cost: float = 0.0, min_edge: float = 0.0) -> DataFrame:
    """Add score, break-even, edge, pass flag and research status. Expects the profile limits
    ``Max_Avg_Holding_Days`` and ``Max_Timeout_Rate`` on every row."""
    c = F.col
    df = metrics.withColumns(
        {
            "Breakeven_Precision": breakeven_precision(c("TP"), c("SL"), F.lit(cost)),
            "Score": score(c("Max_Avg_Holding_Days")),
        }
    ).withColumn(
        "Edge_vs_Breakeven",
        F.when(c("Trades") > 0, c("Validation_Precision") - c("Breakeven_Precision")),
    )
    gains = (c("Excess_Precision") > 0) & (c("Avg_Return") > 0) & (c("Expectancy_Per_Day") > 0)
    passed = (
        gains
        & (c("Valid_Folds") >= K.MIN_VALID_FOLDS)
        & (c("Trades") >= K.MIN_TRADES)
        & (c("Edge_vs_Breakeven") >= min_edge)
        & (c("Avg_Holding_Days") <= c("Max_Avg_Holding_Days"))
        & (c("Timeout_Rate") <= c("Max_Timeout_Rate"))
    )
    df = df.withColumn("Pass_Tradeable_Rule", F.coalesce(passed, F.lit(False)))
    return df.withColumn(
        "Research_Status",
        F.when(c("Trades") == 0, "NO_SIGNAL")
        .when(c("Pass_Tradeable_Rule"), "TRADEABLE_EDGE")
        .when(gains, "RESEARCH_EDGE")
        .otherwise("NO_EDGE"),
    )


def reject_reasons() -> Column:
    """Comma-joined list of the failed gates; empty when the setup is valid."""
    c = F.col
    # fixed values: reason names
    gates = [
        (c("Valid_Folds") < K.MIN_VALID_FOLDS, "insufficient_valid_folds"),
        (c("Trades") < K.MIN_TRADES, "insufficient_trades"),
        (c("Validation_Precision") < K.MIN_PRECISION, "low_precision"),
        (c("Excess_Precision") < K.MIN_EXCESS_PRECISION, "low_excess_precision"),
        (c("Avg_Return") <= K.MIN_AVG_RETURN, "non_positive_avg_return"),
        (c("Avg_Holding_Days") > c("Max_Avg_Holding_Days"), "avg_holding_too_long"),
        (c("Timeout_Rate") > c("Max_Timeout_Rate"), "timeout_rate_too_high"),
    ]
    return F.concat_ws(",", *[F.when(failed, name) for failed, name in gates])


def diagnose(metrics: DataFrame) -> DataFrame:
    """Setup diagnostics: traded setups with their score, reject reasons and validity."""
    df = metrics.where("Trades > 0").withColumns(
        {"Score": score(F.col("Max_Avg_Holding_Days")), "Reject_Reasons": reject_reasons()}
    )
    return df.withColumn("Valid", F.col("Reject_Reasons") == "")


def simple_score(metrics: DataFrame) -> DataFrame:
    """The oldest score: mean fold precision plus a trade bonus, from five trades up."""
    return metrics.where(F.col("Trades") >= K.MIN_TRADES).withColumn(
        "Score", F.col("Mean_Fold_Precision") + F.col("Trades") * K.TRADE_BONUS
    )


def fold_scalers(
    labeled: DataFrame, keys: list[str], columns: list[str], splits: int = K.CV_SPLITS
) -> DataFrame:
    """Mean and population deviation of each feature over each fold's training rows.

    A row of segment s trains folds s+1..splits; exploding those few fold numbers keeps the
    aggregation one pass with map-side combine."""
    folds = F.explode(F.sequence(F.col("segment") + 1, F.lit(splits))).alias("Fold")
    training = labeled.where(F.col("segment") < splits).select(*keys, *SETUP, *columns, folds)
    cells = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    cells += [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    stats = training.groupBy(*keys, *SETUP, "Fold").agg(F.count(F.lit(1)).alias("Train_Count"), *cells)
    per_feature = F.array(
        *[
            F.struct(F.lit(c).alias("Feature"), F.col(f"m{i}").alias("Mean"), F.col(f"s{i}").alias("Std"))
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(*keys, *SETUP, "Fold", "Train_Count", F.inline(per_feature))
