"""Scalar decision rules and display formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.contracts import MAX_HALF_KELLY_PCT, STRONG_WATCH, WEAK_SIGNAL
from barloom.functions.numbers import bind


def breakeven_precision(tp: Column, sl: Column, cost: Column) -> Column:
    """Hit rate at which wins pay for losses after cost; 1 when a win does not even cover the cost."""
    win, loss = tp - cost, F.abs(sl) + cost
    return F.when(win <= 0, 1.0).otherwise(loss / (win + loss))


def checked_breakeven(tp: Column, sl: Column, cost: Column) -> Column:
    """(cost - sl) / (tp - sl), null unless tp > 0, sl < 0 and cost >= 0."""
    usable = (tp > 0) & (sl < 0) & (cost >= 0)
    return F.when(usable, (cost - sl) / (tp - sl))


def decide_action(probability: Column, threshold: Column, required: Column, margin: Column) -> Column:
    """struct(action, reason) for the latest probability."""
    # fixed values: action names and reason texts
    return (
        F.when(
            (probability >= threshold) & (probability >= required),
            _action("BUY", "Probability is above both the model threshold and the cost-adjusted minimum precision."),
        )
        .when(
            probability >= threshold,
            _action("WATCHLIST", "Probability is above threshold but below the cost-adjusted minimum precision."),
        )
        .when(probability >= threshold - margin, _action("WATCHLIST", "Probability is near the threshold."))
        .otherwise(_action("HOLD", "Probability is below the threshold."))
    )


def _action(name: str, reason: str) -> Column:
    return F.struct(F.lit(name).alias("action"), F.lit(reason).alias("reason"))


def classify_signal(probability: Column, threshold: Column) -> Column:
    return (
        F.when(probability >= STRONG_WATCH, "STRONG WATCH")
        .when(probability >= threshold, "VALID ENTRY")
        .when(probability >= WEAK_SIGNAL, "WEAK SIGNAL")
        .otherwise("NO TRADE")
    )


def half_kelly_pct(signal: Column, precision: Column, tp: Column, sl: Column) -> Column:
    """Half the Kelly fraction in percent, floored at 0 and capped; 0 for signals that are not entries."""
    reward_risk = tp / F.nullif(F.abs(sl), F.lit(0.0))
    fraction = precision - (1 - precision) / F.nullif(reward_risk, F.lit(0.0))
    capped = F.least(F.greatest(fraction / 2 * 100, F.lit(0.0)), F.lit(MAX_HALF_KELLY_PCT))
    tradable = signal.isin("VALID ENTRY", "STRONG WATCH") & (reward_risk > 0)
    return F.when(F.coalesce(tradable, F.lit(False)), capped).otherwise(0.0)


def _product_error(value: Column, scale: float) -> Column:
    """What ``value * scale`` loses to rounding, exactly (Dekker's product of split halves)."""
    splitter = 134217729.0
    s_high = splitter * scale - (splitter * scale - scale)
    s_low = scale - s_high
    high = value * splitter - (value * splitter - value)
    low = value - high
    return low * s_low - (value * scale - high * s_high - low * s_high - high * s_low)


def _fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of the double's exact value with ties to even, as C and Python format it;
    Java's formatter rounds the shortest decimal text up instead."""
    scale = float(10**digits)

    def text(v: Column) -> Column:
        scaled = v * scale
        error = F.when(scaled - F.floor(scaled) == 0.5, _product_error(v, scale)).otherwise(0.0)
        whole = F.when(error > 0, F.ceil(scaled)).when(error < 0, F.floor(scaled)).otherwise(F.rint(scaled))
        return F.format_string(f"%.{digits}f", whole / scale)

    return bind(value, text)


def percent_text(value: Column, digits: int = 2, missing: str = "") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.concat(_fixed(value * 100, digits), F.lit("%")))


def number_text(value: Column, digits: int = 4, missing: str = "") -> Column:
    return F.when(value.isNull(), missing).otherwise(_fixed(value, digits))


def count_text(value: Column, missing: str = "") -> Column:
    return F.when(value.isNull(), missing).otherwise(F.format_string("%d", value.cast("bigint")))


def grouped_count_text(value: Column, missing: str = "n/a") -> Column:
    """Whole number with thousands commas."""
    return F.when(value.isNull(), missing).otherwise(F.format_string("%,d", F.rint(value).cast("bigint")))


def setup_label(lookahead: Column, tp: Column, sl: Column, threshold: Column) -> Column:
    return F.concat(
        lookahead.cast("string"), F.lit("D | TP "), percent_text(tp, 0),
        F.lit(" | SL "), percent_text(sl, 0), F.lit(" | TH "), number_text(threshold, 2),
    )


def setup_id(feature_set: Column, lookahead: Column, tp: Column, sl: Column, threshold: Column) -> Column:
    parts = [feature_set, F.concat(F.lit("L"), lookahead.cast("string"))]
    parts += [F.concat(F.lit(tag), v.cast("string")) for tag, v in (("TP", tp), ("SL", sl), ("TH", threshold))]
    return F.concat_ws("|", *parts)


# fixed values: display names
SHORT_MODES = {"reoptimized": "reopt", "fixed_setup": "fixed"}
SHORT_FEATURES = {
    "ablation_trend_recovery_full_v1": "full",
    "candidate_trend_recovery_v1": "candidate_full",
    "ablation_trend_recovery_minus_trend_v1": "minus_trend",
    "ablation_trend_recovery_minus_recovery_v1": "minus_recovery",
    "ablation_trend_recovery_minus_rsi_v1": "minus_rsi",
    "ablation_trend_recovery_minus_drawdown_recovery_v1": "minus_drawdown_recovery",
    "ablation_trend_recovery_minus_market_regime_v1": "minus_market_regime",
    "ablation_recovery_valuation_full_v1": "full",
    "candidate_recovery_valuation_v1": "candidate_full",
    "ablation_recovery_valuation_minus_recovery_v1": "minus_recovery",
    "ablation_recovery_valuation_minus_valuation_v1": "minus_valuation",
}


def short_name(value: Column, names: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(item) for pair in names.items() for item in pair])
    return F.coalesce(F.try_element_at(lookup, value), value)
