"""Period walk-forward, frozen walk-forward and frozen grid.

Periods are a key of the data, not a loop: bars are copied into the periods they fall in, features
are computed inside each period (so the warm-up repeats there), and every period of every ticker
goes through one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.functions.rules import setup_id
from barloom.operators.features import add_features, join_benchmark
from barloom.operators.joins import keep_long_series, spread_periods
from barloom.operators.stability import (
    FROZEN_DELTAS, FROZEN_METRICS, PERIOD_METRICS, add_deltas, stability,
)
from barloom.plans import search
from barloom.session import cut_lineage

PERIOD_KEYS = ["Period_Label", "ticker"]


def period_bars(
    bars: DataFrame, index_bars: DataFrame, periods: list[tuple[str, str, str]],
    min_rows: int = K.MIN_PERIOD_ROWS,
) -> DataFrame:
    """Bars joined with the benchmark, per period; periods too thin in either are left out."""
    in_period = keep_long_series(spread_periods(bars, periods), PERIOD_KEYS, min_rows)
    enough = (
        spread_periods(index_bars.select("date"), periods)
        .groupBy("Period_Label").count().where(F.col("count") >= min_rows).select("Period_Label")
    )
    # one row per period: a handful
    in_period = in_period.join(F.broadcast(enough), "Period_Label", "left_semi")
    return join_benchmark(in_period, index_bars)


def period_features(
    bars: DataFrame, index_bars: DataFrame, periods: list[tuple[str, str, str]],
    columns: list[str] | None = None, min_rows: int = K.MIN_PERIOD_ROWS,
) -> DataFrame:
    return add_features(period_bars(bars, index_bars, periods, min_rows), PERIOD_KEYS, columns)


def walkforward(
    features: DataFrame, setups: list[dict], complete: Column, scores: dict[str, Column],
    cost: float = 0.0, min_edge: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """Re-optimized search per period: (results with period deltas, stability per feature set)."""
    return reoptimized(search.grid_metrics(features, PERIOD_KEYS, setups, complete, scores), setups, cost, min_edge)


def reoptimized(
    metrics: DataFrame, setups: list[dict], cost: float = 0.0, min_edge: float = 0.02
) -> tuple[DataFrame, DataFrame]:
    """``walkforward`` from the raw metrics per period, of whatever scores."""
    keys = [*PERIOD_KEYS, "Feature_Set"]
    # one row per period, ticker, profile and set; read twice below
    best = cut_lineage(search.best_setups(search.profile_results(metrics, setups, cost, min_edge), keys, setups))
    results = add_deltas(
        best, ["Period_Label", "ticker", "Profile", "Experiment_Mode"], PERIOD_METRICS, "Delta_vs_Period_Baseline"
    )
    candidates = results.where("Feature_Set <> 'baseline'")
    return results, stability(candidates, ["ticker", "Profile", "Feature_Set"], min_edge)


def _graded(metrics: DataFrame, setups: list[dict], cost: float, min_edge: float) -> DataFrame:
    return search.profile_results(metrics, setups, cost, min_edge).withColumn(
        "Experiment_Mode", F.lit("fixed_setup")
    )


def frozen_walkforward(
    features: DataFrame, setup: dict, complete: Column, scores: dict[str, Column],
    cost: float = 0.0, min_edge: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """One fixed setup for every feature set and period: (results with deltas, stability)."""
    if "baseline" not in scores:
        raise ValueError("the baseline feature set is needed for the deltas")
    return frozen(search.grid_metrics(features, PERIOD_KEYS, [setup], complete, scores), setup, cost, min_edge)


def frozen(metrics: DataFrame, setup: dict, cost: float = 0.0, min_edge: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """``frozen_walkforward`` from the raw metrics per period, of whatever scores."""
    results = cut_lineage(_graded(metrics, [setup], cost, min_edge))
    results = add_deltas(
        results, ["Period_Label", "ticker", "Profile"], FROZEN_METRICS, "Delta_vs_Period_Baseline"
    )
    candidates = results.where("Feature_Set <> 'baseline'")
    return results, stability(
        candidates, ["ticker", "Profile", "Feature_Set"], min_edge, "Frozen_Strict_Candidate", FROZEN_DELTAS
    )


GRID_KEYS = ["ticker", "Profile", "Setup_ID", "Feature_Set", *search.SETUP_KEY]


def frozen_grid(
    features: DataFrame, setups: list[dict], complete: Column, scores: dict[str, Column],
    cost: float = 0.0, min_edge: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """Every setup of a grid, frozen, over all periods: (results, stability per setup)."""
    return grid(search.grid_metrics(features, PERIOD_KEYS, setups, complete, scores), setups, cost, min_edge)


def grid(metrics: DataFrame, setups: list[dict], cost: float = 0.0, min_edge: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """``frozen_grid`` from the raw metrics per period, of whatever scores."""
    results = _graded(metrics, setups, cost, min_edge)
    c = F.col
    results = results.withColumn(
        "Setup_ID", setup_id(c("Feature_Set"), c("LOOKAHEAD"), c("TP"), c("SL"), c("THRESH"))
    )
    return results, stability(results, GRID_KEYS, min_edge, "Frozen_Strict_Candidate")
