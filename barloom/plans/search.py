"""Setup search: fixed setups, re-optimized profiles, diagnostics, experiment matrix.

All searches share one shape: features -> forward paths -> explode label setups -> conditional sums.
Profiles and thresholds join afterwards, on the small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.operators import evaluate as E
from barloom.operators.labels import label_frame, label_setups
from barloom.operators.stability import EXPERIMENT_METRICS, add_deltas

SETUP_SCHEMA = (
    "Profile string, LOOKAHEAD int, TP double, SL double, THRESH double, Grid_Ordinal int, "
    "Max_Avg_Holding_Days double, Max_Timeout_Rate double"
)
SETUP_KEY = ["LOOKAHEAD", "TP", "SL", "THRESH"]


def setups_frame(spark: SparkSession, setups: list[dict]) -> DataFrame:
    """The grid as a dimension table (tens to hundreds of rows, written by hand)."""
    names = [part.split()[0] for part in SETUP_SCHEMA.split(", ")]
    return spark.createDataFrame([[s[n] for n in names] for s in setups], SETUP_SCHEMA)


def grid_metrics(
    features: DataFrame,
    keys: list[str],
    setups: list[dict],
    complete: Column,
    scores: dict[str, Column],
) -> DataFrame:
    """Raw metrics per key, feature set, setup and threshold. ``scores`` maps a feature-set name to
    its score column; sets share paths, labels and the pass over the data.

    Every key of ``features`` has a row for every set, setup and threshold: one without labeled rows, with too
    few of them or without a usable fold has no trades."""
    labeled = label_frame(
        features, keys, label_setups(setups), complete,
        [F.array(*[F.struct(F.lit(n).alias("Feature_Set"), s.alias("score")) for n, s in scores.items()]).alias("scored")],
        every_series=True,
    )
    labeled = labeled.select("*", F.inline("scored")).drop("scored")
    thresholds = sorted({s["THRESH"] for s in setups})
    out_keys = [*keys, "Feature_Set"]
    return E.setup_metrics(E.fold_table(labeled, out_keys, thresholds), out_keys)


def profile_results(
    metrics: DataFrame, setups: list[dict], cost: float = 0.0, min_edge: float = 0.0
) -> DataFrame:
    """Metrics of every setup of every profile, graded under the profile's limits."""
    # the grid is a fixed dimension of at most a few hundred rows
    grid = F.broadcast(setups_frame(metrics.sparkSession, setups))
    return noted(E.grade(metrics.join(grid, SETUP_KEY), cost, min_edge))


def noted(results: DataFrame) -> DataFrame:
    few = F.col("Rows") < K.MIN_LABELED_ROWS
    return results.withColumn("Reject_Note", F.when(few, "insufficient_labeled_rows").otherwise(""))


# fixed values: what a key and profile shows that no setup could be scored for
NO_SIGNAL = {
    "Validation_Precision": 0.0, "Trades": 0, "Valid_Folds": 0, "Rows": 0, "Research_Status": "NO_SIGNAL",
    "Pass_Tradeable_Rule": False, "Reject_Note": "no_valid_evaluation",
}


def best_setups(results: DataFrame, keys: list[str], setups: list[dict]) -> DataFrame:
    """Highest score per key and profile; scores equal to ten digits are ties, and the earlier grid
    row wins. A key and profile without any score gives a NO_SIGNAL row without a setup. ``Evaluated_Setups``
    is the size of the profile's grid."""
    evaluated: dict[str, int] = {}
    for s in setups:
        evaluated[s["Profile"]] = evaluated.get(s["Profile"], 0) + 1
    size = F.create_map(*[F.lit(x) for pair in evaluated.items() for x in pair])
    row = F.struct(*[c for c in results.columns if c not in (*keys, "Profile")])
    # an aggregate, not a ranking window: combines before it shuffles
    scored = F.col("Score").isNotNull()
    order = F.struct(F.round("Score", 10), -F.col("Grid_Ordinal"))
    best = results.groupBy(*keys, "Profile").agg(F.max_by(F.when(scored, row), F.when(scored, order)).alias("row"))
    unscored = {c: value for c, value in NO_SIGNAL.items() if c in results.columns}
    return best.select(*keys, "Profile", "row.*").fillna(unscored).withColumns(
        {
            "Experiment_Mode": F.lit("reoptimized"),
            "Evaluated_Setups": F.try_element_at(size, F.col("Profile")),
        }
    )


def fixed_results(
    metrics: DataFrame, chosen: DataFrame, keys: list[str], cost: float = 0.0, min_edge: float = 0.0
) -> DataFrame:
    """Grade each key's one chosen setup; ``chosen`` holds keys, Profile, setup and limits."""
    graded = noted(E.grade(metrics.join(chosen, [*keys, *SETUP_KEY]), cost, min_edge))
    return graded.withColumn("Experiment_Mode", F.lit("fixed_setup"))


def resolve_setups(
    explicit: DataFrame | None, best: DataFrame | None, diagnostics: DataFrame | None, keys: list[str]
) -> DataFrame:
    """The setup to freeze per key: an explicit one, else the best parameters by score, else the
    best diagnostics row with a score."""
    parts = []
    # fixed values: source names
    for priority, (frame, source) in enumerate(
        [(explicit, "cli_explicit"), (best, "best_params"), (diagnostics, "setup_diagnostics_fallback")]
    ):
        if frame is None:
            continue
        if "Score" not in frame.columns:
            frame = frame.withColumn("Score", F.lit(None).cast("double"))
        if source == "setup_diagnostics_fallback":
            frame = frame.where("Score IS NOT NULL")
        parts.append(
            frame.select(
                *keys, *SETUP_KEY, "Score", F.lit(source).alias("Setup_Source"),
                F.lit(-priority).alias("priority"),
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    row = F.struct(*SETUP_KEY, "Setup_Source")
    # ties break on the setup itself so the choice does not depend on partitioning
    order = F.struct("priority", F.round("Score", 10), *[-F.col(c) for c in SETUP_KEY])
    return union.groupBy(*keys).agg(F.max_by(row, order).alias("row")).select(*keys, "row.*")


def optimize_profiles(metrics: DataFrame, setups: list[dict], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(diagnostics of every traded setup, best valid setup per key and profile)."""
    grid = F.broadcast(setups_frame(metrics.sparkSession, setups))
    diagnostics = E.diagnose(metrics.join(grid, SETUP_KEY))
    return diagnostics, best_setups(diagnostics.where("Valid"), keys, setups)


def rank_diagnostics(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """Diagnostics order inside each key and profile: valid first, then score."""
    order = Window.partitionBy(*keys, "Profile").orderBy(
        F.desc("Valid"), F.desc_nulls_last(F.round("Score", 10)), "Grid_Ordinal"
    )
    return diagnostics.withColumn("Rank", F.row_number().over(order))


def global_grid_best(metrics: DataFrame, keys: list[str], setups: list[dict]) -> DataFrame:
    """Oldest search: one grid, no profile, score = mean fold precision + trade bonus."""
    grid = F.broadcast(
        setups_frame(metrics.sparkSession, setups).select(*SETUP_KEY, "Grid_Ordinal", "Profile")
    )
    return best_setups(E.simple_score(metrics.join(grid, SETUP_KEY)), keys, setups)


def experiment_matrix(
    metrics: DataFrame, setups: list[dict], chosen: DataFrame, cost: float = 0.0, min_edge: float = 0.0
) -> DataFrame:
    """Ticker x profile x feature set x {fixed, re-optimized} in one table, with deltas against the
    baseline set. ``chosen`` holds the frozen setup per (ticker, Profile). Metrics are read by both
    modes and by the choice, so the caller materializes them first."""
    results = profile_results(metrics, setups, cost, min_edge)
    best = best_setups(results, ["ticker", "Feature_Set"], setups)
    frozen = results.join(chosen, ["ticker", "Profile", *SETUP_KEY]).withColumn(
        "Experiment_Mode", F.lit("fixed_setup")
    )
    both = frozen.unionByName(best, allowMissingColumns=True).withColumnRenamed("ticker", "Ticker")
    return add_deltas(both, ["Ticker", "Profile", "Experiment_Mode"], EXPERIMENT_METRICS, "Delta_vs_Baseline")
