"""Registered queries: walk-forward evaluation with boosted trees, out of fold.

All models have the published size. The probabilities of a run are written once per application and read by every
query that needs them. Probabilities cannot be said in SQL: ``model_folds`` compares everything around them, and the
tests compare the other two with SQL over the written probabilities.
"""

from __future__ import annotations

import hashlib


from barloom.catalog.base import bars, feature_frame, index_bars, query
from barloom.catalog.decisions import (
    DELTA_DIGITS, DELTA_SQL, MIN_EDGE, RESULT_SQL, STABLE_DIGITS, SWING, experiments_sql, matrix_of, ranked, stable_sql, _DELTAS, _RANKED,
    _order, _with_period_deltas,
)
from barloom.catalog.evaluation import (
    GRADE_COLUMNS, GRADE_DIGITS, GRADE_SQL, JOINED, KEYS, NEEDED, PERIODS, best_sql, folds_sql, period_joined,
)
from barloom.operators import decide as D
from barloom.operators import stability as S
from barloom.operators.labels import complete_rows
from barloom.operators.registry import feature_sets
from barloom.plans import modelled
from barloom.plans import walkforward as W
from barloom.session import cut_lineage

MODEL_SETS = {name: feature_sets()[name] for name in ("baseline", "candidate_trend_quality_v1")}
MODEL_SETUPS = [s for s in SWING if (s["LOOKAHEAD"], s["TP"], s["SL"]) == (20, 0.10, -0.07)]
MODEL_PERIODS = [PERIODS[0], PERIODS[2]]
COLUMNS = sorted({c for columns in MODEL_SETS.values() for c in columns} | set(NEEDED))


def run_name(spark, sf_dir, what: str) -> str:
    """One run per application, so that a repeated query finds its probabilities and another one never does."""
    return f"models-{spark.sparkContext.applicationId}-{what}-{hashlib.md5(sf_dir.encode()).hexdigest()}"


def probabilities(spark, sf_dir, **options):
    features = feature_frame(spark, sf_dir, columns=COLUMNS)
    return modelled.out_of_fold(
        features, KEYS, MODEL_SETUPS, complete_rows(COLUMNS), MODEL_SETS, run_name(spark, sf_dir, "all"), **options)


def period_probabilities(spark, sf_dir, **options):
    """A panel per period."""
    features = W.period_features(bars(spark, sf_dir), index_bars(spark, sf_dir), MODEL_PERIODS, COLUMNS)
    return modelled.out_of_fold(
        features, W.PERIOD_KEYS, MODEL_SETUPS, complete_rows(COLUMNS), MODEL_SETS, run_name(spark, sf_dir, "periods"),
        per=["Period_Label"], **options)


@query(
    "model_folds",
    f"""WITH RECURSIVE {folds_sql(MODEL_SETUPS, dict.fromkeys(MODEL_SETS, "s1"), JOINED)}
SELECT ticker, fs AS Feature_Set, la AS LOOKAHEAD, tp::double AS TP, sl::double AS SL, segment AS Fold,
  CAST(train_n AS bigint) AS Train_Count, CAST(train_pos AS bigint) AS Train_Positive, n AS Test_Count,
  CAST(pos AS bigint) AS Test_Positive, n AS Scored, CAST(0 AS bigint) AS Out_Of_Range
FROM train WHERE segment > 0 AND train_pos > 0 AND train_pos < train_n""",
)
def model_folds(spark, sf_dir):
    """Every usable fold of every series, with the rows that its model was fitted on and scored."""
    return modelled.fold_report(probabilities(spark, sf_dir), KEYS)


@query("experiment_matrix_model", digits={**GRADE_DIGITS, **DELTA_DIGITS})
def experiment_matrix_model(spark, sf_dir):
    """Ticker x set x mode, traded on out-of-fold probabilities."""
    m = cut_lineage(modelled.model_metrics(probabilities(spark, sf_dir), KEYS, MODEL_SETUPS))
    return matrix_of(m, MODEL_SETUPS).select(
        *D.RESULT_KEYS, *GRADE_COLUMNS, *[f"{c}_Delta_vs_Baseline" for c in S.EXPERIMENT_METRICS])


@query("stability_model", digits=STABLE_DIGITS)
def stability_model(spark, sf_dir):
    """Re-optimized search per period on out-of-fold probabilities, rolled up per feature set."""
    m = modelled.model_metrics(period_probabilities(spark, sf_dir), W.PERIOD_KEYS, MODEL_SETUPS)
    _, stable = W.reoptimized(m, MODEL_SETUPS, 0.0, MIN_EDGE)
    return ranked(stable, S.STABLE_ORDER, ["Feature_Set"])


def written_score(name: str, key: str) -> str:
    """A set's probability of a labelled row, from a table ``oof`` of written probabilities."""
    return f"""(SELECT any_value(o.score) FROM oof o WHERE {key} = lab.ticker AND o.date = lab.date AND o.Feature_Set = '{name}'
      AND o.LOOKAHEAD = lab.la AND o.TP = lab.tp AND o.SL = lab.sl)"""


def matrix_sql() -> str:
    """``experiment_matrix_model`` over a table ``oof``."""
    sets = {name: written_score(name, "o.ticker") for name in MODEL_SETS}
    return f"WITH RECURSIVE {experiments_sql(MODEL_SETUPS, sets)} SELECT {RESULT_SQL}, {GRADE_SQL}, {DELTA_SQL} FROM res"


def stability_sql() -> str:
    """``stability_model`` over a table ``oof``."""
    sets = {name: written_score(name, "o.ticker || '|' || o.Period_Label") for name in MODEL_SETS}
    best = best_sql(MODEL_SETUPS, sets, period_joined(MODEL_PERIODS), 0.0, MIN_EDGE)
    stable = stable_sql("(SELECT * FROM wf WHERE fs <> 'baseline') w", "ticker, profile AS Profile, fs AS Feature_Set", "Stable_Strict_Candidate")
    return f"""WITH RECURSIVE {best}, wf AS MATERIALIZED ({_with_period_deltas('best', _DELTAS)}), s AS ({stable})
SELECT *, {_RANKED.format(order=_order(S.STABLE_ORDER, 'Feature_Set'))} FROM s"""
