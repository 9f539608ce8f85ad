"""Roll-ups of experiment results: deltas against a baseline, stability over periods, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbers import strict_bool

BASELINE = "baseline"
EXPERIMENT_METRICS = [
    "Score", "Validation_Precision", "Excess_Precision", "Edge_vs_Breakeven", "Avg_Return",
    "Expectancy_Per_Day", "Avg_Holding_Days", "Timeout_Rate", "Trades",
]
PERIOD_METRICS = ["Score", "Edge_vs_Breakeven", "Avg_Return", "Expectancy_Per_Day", "Timeout_Rate", "Trades"]
FROZEN_METRICS = [
    "Score", "Validation_Precision", "Excess_Precision", "Edge_vs_Breakeven", "Avg_Return",
    "Expectancy_Per_Day", "Timeout_Rate", "Trades",
]


def add_deltas(
    results: DataFrame, keys: list[str], metrics: list[str], suffix: str, reference: Column | None = None
) -> DataFrame:
    """``<metric>_<suffix>``: each row minus the reference row of its key (default: the baseline
    feature set); null where the key has no reference.

    The reference rows are reduced to one per key by a combining aggregate and joined back."""
    is_reference = F.col("Feature_Set") == BASELINE if reference is None else reference
    row = F.struct(*metrics)
    base = results.where(is_reference).groupBy(*keys).agg(F.min_by(row, "Feature_Set").alias("__base"))
    joined = results.join(base, keys, "left")
    deltas = {f"{m}_{suffix}": F.col(m) - F.col(f"__base.{m}") for m in metrics}
    return joined.withColumns(deltas).drop("__base")


def stability(
    results: DataFrame,
    keys: list[str],
    min_edge: float,
    flag: str = "Stable_Strict_Candidate",
    mean_deltas: dict[str, str] | None = None,
) -> DataFrame:
    """Per key over its periods: pass counts, means and minima, and the strict flag."""
    passed = strict_bool("Pass_Tradeable_Rule").cast("int")
    out = results.groupBy(*keys).agg(
        F.countDistinct("Period_Label").alias("Periods"),
        F.sum(passed).alias("Pass_Periods"),
        F.avg("Score").alias("Avg_Score"),
        F.min("Score").alias("Min_Score"),
        F.avg("Edge_vs_Breakeven").alias("Avg_Edge"),
        F.min("Edge_vs_Breakeven").alias("Min_Edge"),
        F.avg("Avg_Return").alias("Mean_Return"),
        F.min("Avg_Return").alias("Min_Return"),
        F.avg("Expectancy_Per_Day").alias("Avg_Expectancy_Per_Day"),
        F.avg("Timeout_Rate").alias("Avg_Timeout_Rate"),
        F.sum("Trades").alias("Total_Trades"),
        F.avg("Trades").alias("Avg_Trades"),
        *[F.avg(source).alias(name) for name, source in (mean_deltas or {}).items()],
    ).withColumnRenamed("Mean_Return", "Avg_Return")
    out = out.withColumn("Pass_Rate", F.col("Pass_Periods") / F.nullif(F.col("Periods"), F.lit(0)))
    strict = (
        (F.col("Pass_Rate") >= 0.75)
        & (F.col("Min_Edge") >= min_edge)
        & (F.col("Avg_Return") > 0)
        & (F.col("Total_Trades") >= 100)
    )
    return out.withColumn(flag, F.coalesce(strict, F.lit(False)))


FROZEN_DELTAS = {
    "Avg_Score_Delta": "Score_Delta_vs_Period_Baseline",
    "Avg_Edge_Delta": "Edge_vs_Breakeven_Delta_vs_Period_Baseline",
    "Avg_Return_Delta": "Avg_Return_Delta_vs_Period_Baseline",
}

# ranking orders, most important first, all descending
STABLE_ORDER = ["Stable_Strict_Candidate", "Pass_Rate", "Avg_Edge", "Avg_Score"]
FROZEN_ORDER = ["Frozen_Strict_Candidate", "Pass_Rate", "Min_Edge", "Avg_Edge", "Avg_Score"]
GRID_ORDER = [*FROZEN_ORDER, "Total_Trades"]


def rank(df: DataFrame, within: list[str], order: list[str], tie_break: list[str]) -> DataFrame:
    """``Rank`` inside each group of results, descending with nulls last, ties broken by name."""
    window = Window.partitionBy(*within).orderBy(*[F.desc_nulls_last(c) for c in order], *tie_break)
    return df.withColumn("Rank", F.row_number().over(window))


def top(df: DataFrame, metric: str, count: int, tie_break: list[str]) -> DataFrame:
    """The report's top rows by one metric (a take-ordered: every task keeps ``count`` rows)."""
    return df.orderBy(F.desc_nulls_last(metric), *tie_break).limit(count)
