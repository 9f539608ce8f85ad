"""Latest signals for any number of tickers, and the radar summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.functions import rules as R
from barloom.operators import model as M
from barloom.operators.labels import complete_rows, label_frame, latest_complete, training_rows
from barloom.session import cut_lineage

KEYS = ["ticker"]


def decide(latest: DataFrame, setup: dict, cost: float, min_edge: float, watch_margin: float) -> DataFrame:
    """Latest rows with ``probability`` to threshold, break-even, required precision and action."""
    tp, sl, threshold = (F.lit(float(setup[k])) for k in ("TP", "SL", "THRESH"))
    breakeven = R.checked_breakeven(tp, sl, F.lit(cost))
    df = latest.withColumns(
        {
            "threshold": threshold,
            "breakeven_precision": breakeven,
            "min_required_precision": breakeven + min_edge,
        }
    )
    action = R.decide_action(
        F.col("probability"), F.col("threshold"), F.col("min_required_precision"), F.lit(watch_margin)
    )
    return df.withColumn("d", action).select(*df.columns, "d.*")


def latest_signals(
    features: DataFrame, columns: list[str], setup: dict, feature_set: str, profile: str,
    cost: float = 0.005, min_edge: float = 0.02, watch_margin: float = 0.05,
    candidate_name: str = "", evidence: DataFrame | None = None, top: int = 10, **model_options,
) -> DataFrame:
    """Train on labeled rows before each ticker's latest complete row, score that row, decide, and
    return one nested row per ticker with enough labeled rows of both classes. ``evidence`` holds what earlier
    research found for a ticker's setup: (ticker, Pass_Periods, Min_Edge, Avg_Return)."""
    usable = complete_rows(columns)
    # latest rows and training rows both read the features, which are computed once
    features = cut_lineage(features.select(*KEYS, "date", "Close", *[c for c in columns if c != "Close"]))
    latest = cut_lineage(latest_complete(features, KEYS, usable, columns))
    grid = [(setup["LOOKAHEAD"], setup["TP"], setup["SL"])]
    train = cut_lineage(training_rows(label_frame(features, KEYS, grid, usable, columns), latest, KEYS))
    counts = train.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("training_rows"), F.sum("Target").alias("positives")
    )
    trainable = counts.where(
        (F.col("training_rows") >= K.MIN_LABELED_ROWS)
        & (F.col("positives") > 0) & (F.col("positives") < F.col("training_rows"))
    )
    if trainable.isEmpty():
        scored, ranked = latest.withColumn("probability", F.lit(None).cast("double")), []
    else:
        model = M.fit(train.join(trainable.select(*KEYS), KEYS, "left_semi"), columns, **model_options)
        scored = M.probability(model, latest).withColumnRenamed("score", "probability")
        ranked = M.top_features(model, columns, top)
    scored = scored.join(trainable, KEYS)
    decided = decide(scored, setup, cost, min_edge, watch_margin)
    importance = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(n).alias("feature"), F.lit(v).alias("importance"))
            for i, n, v in ranked
        ]
    ).cast("array<struct<rank:int,feature:string,importance:double>>")
    return payload(decided, setup, feature_set, profile, candidate_name, cost, min_edge, len(columns), importance, evidence)


def payload(
    decided: DataFrame, setup: dict, feature_set: str, profile: str, candidate_name: str, cost: float,
    min_edge: float, feature_count: int, importance: Column, evidence: DataFrame | None,
) -> DataFrame:
    """The nested signal row; ``evidence`` is (ticker, Pass_Periods, Min_Edge, Avg_Return)."""
    fields = ["Pass_Periods", "Min_Edge", "Avg_Return"]
    if evidence is not None:
        decided = decided.join(evidence.select("ticker", *fields), "ticker", "left")
    else:
        decided = decided.withColumns({f: F.lit(None).cast("double") for f in fields})
    c = F.col
    return decided.select(
        "ticker",
        F.lit(profile).alias("profile"),
        F.lit(candidate_name).alias("candidate_name"),
        F.struct(
            F.lit(feature_set).alias("feature_set"),
            F.lit(setup["LOOKAHEAD"]).alias("lookahead"), F.lit(setup["TP"]).alias("tp"),
            F.lit(setup["SL"]).alias("sl"), F.lit(setup["THRESH"]).alias("threshold"),
            F.lit(cost).alias("round_trip_cost"), F.lit(min_edge).alias("min_edge_vs_breakeven"),
        ).alias("setup"),
        F.struct(
            c("Latest_Feature_Date").alias("latest_feature_date"),
            c("Latest_Data_Date").alias("latest_data_date"),
            c("Data_Lag_Days").alias("data_lag_days"),
            c("Latest_Close").alias("latest_close"),
            c("training_rows"),
            F.lit(feature_count).alias("feature_columns"),
        ).alias("data"),
        F.struct(
            "probability", "threshold", "breakeven_precision", "min_required_precision", "action", "reason"
        ).alias("signal"),
        F.struct(
            c("Pass_Periods").alias("pass_periods"), c("Min_Edge").alias("min_edge"),
            c("Avg_Return").alias("avg_return"), F.lit(cost).alias("round_trip_cost"),
        ).alias("research_evidence"),
        importance.alias("top_model_features"),
    )


def radar_summary(best: DataFrame, latest: DataFrame) -> DataFrame:
    """Best setup per ticker and profile with the latest probability, its tier and position size; nothing for
    a profile without a scored setup."""
    df = best.where("Score IS NOT NULL").join(latest.select("ticker", "Latest_Feature_Date", "Latest_Close", "probability"), "ticker")
    df = df.withColumn("Signal", R.classify_signal(F.col("probability"), F.col("THRESH")))
    size = R.half_kelly_pct(F.col("Signal"), F.col("Validation_Precision"), F.col("TP"), F.col("SL"))
    return df.withColumns(
        {"Half_Kelly_Pct": size, "Position_Size": F.concat(R.number_text(size, 1), F.lit("%"))}
    )
