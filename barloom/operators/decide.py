"""Decisions over result tables: feature-set verdicts, ablation deltas, acceptance, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rules as R
from barloom.functions.numbers import is_close, strict_bool, value_matches
from barloom.operators.stability import PERIOD_METRICS

RESULT_KEYS = ["Ticker", "Profile", "Experiment_Mode", "Feature_Set"]


def feature_set_decisions(results: DataFrame) -> DataFrame:
    """Verdict per non-baseline row with ``*_Delta_vs_Baseline`` columns; the strongest rule wins."""
    c = F.col
    score, edge, gain, per_day, timeout, trades = (
        c(f"{m}_Delta_vs_Baseline")
        for m in ("Score", "Edge_vs_Breakeven", "Avg_Return", "Expectancy_Per_Day", "Timeout_Rate", "Trades")
    )
    fewer_allowed = -0.30 * F.greatest(F.coalesce(c("Trades"), F.lit(0)), F.lit(1))
    upgrade = (c("Research_Status") == "TRADEABLE_EDGE") & (edge > 0)
    drop = (score < 0) & (edge <= 0) & (gain <= 0)
    accept = (
        (edge > 0) & (gain > 0) & (per_day > 0)
        & (timeout.isNull() | (timeout <= 0.10))
        & (trades.isNull() | (trades >= fewer_allowed))
    )

    def verdict(name: str, reason: str) -> Column:
        return F.struct(F.lit(name).alias("Decision"), F.lit(reason).alias("Reason"))

    # fixed values: decision names and reason texts
    decision = (
        F.when(upgrade, verdict("TRADEABLE_UPGRADE", "Candidate improves baseline and reaches tradeable-edge status."))
        .when(drop, verdict("DROP_CANDIDATE", "Candidate weakens score, edge, and return versus baseline."))
        .when(accept, verdict(
            "ACCEPT_CANDIDATE",
            "Candidate improves edge, return, and expectancy without a major timeout penalty.",
        ))
        .otherwise(verdict("RESEARCH_ONLY", "Candidate has mixed or weak evidence."))
    )
    kept = [f"{m}_Delta_vs_Baseline" for m in (
        "Score", "Edge_vs_Breakeven", "Avg_Return", "Expectancy_Per_Day", "Timeout_Rate", "Trades")]
    return results.where(c("Feature_Set") != "baseline").select(
        *RESULT_KEYS, decision.alias("d"), "Research_Status", *kept
    ).select(*RESULT_KEYS, "d.*", "Research_Status", *kept)


def attach_decisions(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Left join of the decision report, one decision per key."""
    one = decisions.groupBy(*RESULT_KEYS).agg(
        F.min_by(F.struct("Decision", "Reason"), "Decision").alias("d")
    ).select(*RESULT_KEYS, "d.*")
    return results.join(one, RESULT_KEYS, "left")


def filter_report(
    results: DataFrame, ticker: str | None = None, profile: str | None = None, mode: str = "all",
    only_tradeable: bool = False,
) -> DataFrame:
    df = results
    if ticker:
        df = df.where(F.upper("Ticker") == ticker.upper())
    if profile:
        df = df.where(F.upper("Profile") == profile.upper())
    if mode != "all":
        df = df.where(F.col("Experiment_Mode") == {"reopt": "reoptimized", "fixed": "fixed_setup"}[mode])
    if only_tradeable:
        df = df.where(strict_bool("Pass_Tradeable_Rule"))
    return df


# fixed values: ablation families
FAMILIES = {
    "trend_recovery": [
        "ablation_trend_recovery_full_v1",
        "candidate_trend_recovery_v1",
        "ablation_trend_recovery_minus_trend_v1",
        "ablation_trend_recovery_minus_recovery_v1",
        "ablation_trend_recovery_minus_rsi_v1",
        "ablation_trend_recovery_minus_drawdown_recovery_v1",
        "ablation_trend_recovery_minus_market_regime_v1",
    ],
    "recovery_valuation": [
        "ablation_recovery_valuation_full_v1",
        "candidate_recovery_valuation_v1",
        "ablation_recovery_valuation_minus_recovery_v1",
        "ablation_recovery_valuation_minus_valuation_v1",
    ],
}


def ablation_deltas(results: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas of every family member against the family's full set, per key and mode.

    The full set is the family's first name; where a key has no such row, its second name. Modes
    without a reference of their own use the reoptimized one."""
    family = F.create_map(*[F.lit(x) for f, members in FAMILIES.items() for m in members for x in (m, f)])
    full = [members[0] for members in FAMILIES.values()]
    fallback = [members[1] for members in FAMILIES.values()]
    df = results.withColumn("Family", F.try_element_at(family, F.col("Feature_Set"))).where("Family IS NOT NULL")
    group = [*keys, "Family"]
    reference = df.where(F.col("Feature_Set").isin(full + fallback)).groupBy(*group, "Experiment_Mode").agg(
        F.max_by(F.struct(*PERIOD_METRICS), F.when(F.col("Feature_Set").isin(full), 1).otherwise(0)).alias("own"),
        F.max(F.col("Feature_Set").isin(full)).alias("is_full"),
    )
    # a family that has its full set in any mode takes no fallback
    has_full = reference.groupBy(*group).agg(
        F.max("is_full").alias("any_full"),
        F.max_by("own", F.struct("is_full", "Experiment_Mode")).alias("any"),
    )
    own = reference.join(has_full.select(*group, "any_full"), group).where(
        ~F.col("any_full") | F.col("is_full")
    ).select(*group, "Experiment_Mode", "own")
    df = df.join(has_full.select(*group, "any"), group).join(own, [*group, "Experiment_Mode"], "left")
    chosen = F.coalesce("own", "any")
    deltas = {f"{m}_Delta_vs_Full": F.col(m) - chosen[m] for m in PERIOD_METRICS}
    return df.withColumns({**deltas, "Short_Feature": R.short_name(F.col("Feature_Set"), R.SHORT_FEATURES)}).drop(
        "own", "any"
    )


def summary_view(results: DataFrame) -> DataFrame:
    """Compact display columns of a result table."""
    c = F.col
    return results.select(
        "Ticker", "Profile", c("Feature_Set").alias("Feature"),
        R.short_name(c("Experiment_Mode"), R.SHORT_MODES).alias("Mode"),
        R.setup_label(c("LOOKAHEAD"), c("TP"), c("SL"), c("THRESH")).alias("Setup"),
        R.number_text(c("Score"), 4).alias("Score"),
        R.percent_text(c("Edge_vs_Breakeven")).alias("Edge"),
        R.percent_text(c("Avg_Return")).alias("AvgRet"),
        R.percent_text(c("Expectancy_Per_Day")).alias("Exp_Day"),
        R.percent_text(c("Timeout_Rate")).alias("Timeout"),
        R.count_text(c("Trades")).alias("Trades"),
        F.coalesce("Research_Status", F.lit("")).alias("Status"),
    )


def risk_view(results: DataFrame) -> DataFrame:
    c = F.col
    return results.select(
        "Ticker", "Profile", c("Feature_Set").alias("Feature"),
        R.short_name(c("Experiment_Mode"), R.SHORT_MODES).alias("Mode"),
        R.percent_text(c("Validation_Precision")).alias("Precision"),
        R.percent_text(c("Breakeven_Precision")).alias("BE"),
        R.percent_text(c("Edge_vs_Breakeven")).alias("Edge"),
        R.number_text(c("Avg_Holding_Days"), 2).alias("HoldD"),
        R.percent_text(c("Timeout_Rate")).alias("Timeout"),
        R.count_text(c("Trades")).alias("Trades"),
    )


def period_view(results: DataFrame) -> DataFrame:
    """The columns of a per-period summary."""
    names = [
        "Period_Label", "Period_Start", "Period_End", "ticker", "Profile", "Feature_Set", "LOOKAHEAD", "TP",
        "SL", "THRESH", "Score", "Validation_Precision", "Breakeven_Precision", "Edge_vs_Breakeven",
        "Avg_Return", "Avg_Holding_Days", "Expectancy_Per_Day", "Timeout_Rate", "Trades", "Research_Status",
        "Pass_Tradeable_Rule", "Setup_ID", "Score_Delta_vs_Period_Baseline",
        "Edge_vs_Breakeven_Delta_vs_Period_Baseline", "Avg_Return_Delta_vs_Period_Baseline",
    ]
    return results.select(*[n for n in names if n in results.columns])


def select_candidate(
    grid: DataFrame, keys: list[str], feature_names: list[str] | None = None, lookahead: int | None = None,
    tp: float | None = None, sl: float | None = None, threshold: float | None = None,
) -> DataFrame:
    """Best grid row per key: strict, passed periods, edge, return, trades, recency."""
    df = grid
    if feature_names is not None:
        df = df.where(F.trim("Feature_Set").isin([n.strip() for n in feature_names]))
    for column, value in (("LOOKAHEAD", lookahead), ("TP", tp), ("SL", sl), ("THRESH", threshold)):
        df = df.where(value_matches(F.col(column), value))
    order = ["strict", "Pass_Periods", "Min_Edge", "Avg_Return", "Total_Trades"]
    df = df.withColumn("strict", strict_bool("Frozen_Strict_Candidate"))
    if "Source_Modified" in df.columns:
        order.append("Source_Modified")
    # the setup itself breaks the last ties
    rest = [-F.col("LOOKAHEAD"), -F.col("TP"), F.col("SL"), -F.col("THRESH")]
    row = F.struct(*[c for c in grid.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, *rest)).alias("row")).select(*keys, "row.*")


def select_baseline(grid: DataFrame, keys: list[str], feature_set: str) -> DataFrame:
    """Best row of the named baseline set per key; strictness and recency do not count."""
    order = ["Pass_Periods", "Min_Edge", "Avg_Return", "Total_Trades"]
    rest = [-F.col("LOOKAHEAD"), -F.col("TP"), F.col("SL"), -F.col("THRESH")]
    row = F.struct(*[c for c in grid.columns if c not in keys])
    df = grid.where(F.trim("Feature_Set") == feature_set.strip())
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, *rest)).alias("row")).select(*keys, "row.*")


def acceptance_checks(
    candidates: DataFrame, keys: list[str], min_pass_periods: int = 3, min_edge: float = 0.02,
    min_avg_return: float = 0.02, min_trades: int = 100,
) -> DataFrame:
    """(keys, Rule, Observed, Status): four rules per candidate row."""
    c = F.col

    def check(rule: str, observed: Column, passed: Column) -> Column:
        status = F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
        return F.struct(F.lit(rule).alias("Rule"), observed.alias("Observed"), status.alias("Status"))

    def percent(value: Column) -> Column:
        return R.percent_text(value, 2, "n/a")

    rules = F.array(
        check(f"Pass_Periods >= {min_pass_periods}", R.grouped_count_text(c("Pass_Periods")),
              c("Pass_Periods") >= min_pass_periods),
        check(f"Min_Edge >= {min_edge * 100:.2f}%", percent(c("Min_Edge")), c("Min_Edge") >= min_edge),
        check(f"Avg_Return >= {min_avg_return * 100:.2f}%", percent(c("Avg_Return")),
              c("Avg_Return") >= min_avg_return),
        check(f"Total_Trades >= {min_trades}", R.grouped_count_text(c("Total_Trades")),
              c("Total_Trades") >= min_trades),
    )
    return candidates.select(*keys, F.inline(rules))


def promotion(candidates: DataFrame, checks: DataFrame, keys: list[str]) -> DataFrame:
    """Promotion decision per candidate from its strict flag and its acceptance checks."""
    all_pass = checks.groupBy(*keys).agg(F.min(F.col("Status") == "PASS").alias("all_pass"))
    strict = strict_bool("Frozen_Strict_Candidate")

    def verdict(name: str, reason: str) -> Column:
        return F.struct(F.lit(name).alias("Decision"), F.lit(reason).alias("Reason"))

    # fixed values: decision names and reason texts
    decision = (
        F.when(strict & F.col("all_pass"), verdict(
            "PROMOTE_TO_PRODUCTION_CANDIDATE",
            "Frozen grid evidence satisfies the acceptance rules under the selected cost assumption.",
        ))
        .when(strict, verdict(
            "KEEP_AS_RESEARCH_CANDIDATE",
            "Frozen grid marks this as strict candidate, but at least one explicit acceptance rule failed.",
        ))
        .otherwise(verdict("RESEARCH_ONLY", "Evidence is not strong enough to promote this setup."))
    )
    return candidates.join(all_pass, keys).select(*keys, decision.alias("d")).select(*keys, "d.*")


def compare_with_baseline(candidates: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, Metric, Candidate, Baseline, Delta) as display texts."""
    metrics = {"Min Edge": "Min_Edge", "Avg Return": "Avg_Return", "Total Trades": "Total_Trades"}
    base = baselines.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics.values()])

    def texts(label: str, name: str) -> Column:
        show = R.grouped_count_text if name == "Total_Trades" else lambda v: R.percent_text(v, 2, "n/a")
        mine, theirs = F.col(name), F.col(f"b_{name}")
        return F.struct(
            F.lit(label).alias("Metric"), show(mine).alias("Candidate"), show(theirs).alias("Baseline"),
            show(mine - theirs).alias("Delta"),
        )

    rows = F.array(*[texts(label, name) for label, name in metrics.items()])
    return candidates.join(base, keys).select(*keys, F.inline(rows))


def research_evidence(
    signals: DataFrame, grid: DataFrame, keys: list[str], aliases: dict[str, str] | None = None
) -> DataFrame:
    """First grid row matching each signal's feature set and setup.

    Setups match within a float tolerance, so the join is on the key and the set name, and the
    tolerance is a filter on the few setups of that key. ``aliases`` maps set names that hold the
    same columns to one name."""
    name = F.col("Feature_Set")
    if aliases:
        name = R.short_name(name, aliases)
    right = grid.select(
        *keys, name.alias("__set"), *[F.col(c).alias(f"g_{c}") for c in ("LOOKAHEAD", "TP", "SL", "THRESH")],
        "Pass_Periods", "Min_Edge", "Avg_Return", "Setup_ID",
    )
    left = signals.withColumn("__set", name)
    match = F.lit(True)
    for c in ("LOOKAHEAD", "TP", "SL", "THRESH"):
        match = match & is_close(F.col(f"g_{c}"), F.col(c))
    found = left.select(*keys, "__set", "LOOKAHEAD", "TP", "SL", "THRESH").join(right, [*keys, "__set"]).where(match)
    first = found.groupBy(*keys, "__set", "LOOKAHEAD", "TP", "SL", "THRESH").agg(
        F.min_by(F.struct("Pass_Periods", "Min_Edge", "Avg_Return"), "Setup_ID").alias("evidence")
    )
    return left.join(first, [*keys, "__set", "LOOKAHEAD", "TP", "SL", "THRESH"], "left").drop("__set")
