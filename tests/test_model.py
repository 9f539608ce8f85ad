"""The registered model queries at the published size; trees are counted, not grown, to keep the test short."""

import inspect
import json

from barloom import contracts as K
from barloom.catalog import QUERIES
from barloom.operators import model as M
from barloom.operators.registry import feature_sets

COLUMNS = feature_sets()["candidate_cost_resilient_recovery_no_noise_v1"]


def test_model_queries_ask_for_the_published_size(spark, monkeypatch):
    asked, fit = [], M.fit

    def small(train, columns, **options):
        bound = inspect.signature(fit).bind(train, columns, **options)
        bound.apply_defaults()
        asked.append((columns, bound.arguments["trees"], bound.arguments["depth"]))
        return fit(train, columns, **{**options, "trees": 2, "depth": 2})

    monkeypatch.setattr(M, "fit", small)
    rows = [json.loads(r.payload) for r in QUERIES["gbt_signal"].run(spark, "/root/testdata/sf0.01").collect()]
    importance = QUERIES["feature_importance"].run(spark, "/root/testdata/sf0.01").collect()
    assert asked == [(COLUMNS, K.GBT_TREES, K.GBT_DEPTH)] * 2 and len(COLUMNS) == 34
    assert len(rows) == 25 and {r["data"]["feature_columns"] for r in rows} == {34}
    assert all(0 <= r["signal"]["probability"] <= 1 for r in rows)
    evidence = [r["research_evidence"] for r in rows]
    assert all(e["pass_periods"] is not None for e in evidence) and any("avg_return" in e for e in evidence)
    assert sorted(r.feature for r in importance) == sorted(COLUMNS)
    assert abs(sum(r.importance for r in importance) - 1) < 1e-9


def test_no_trainable_ticker_gives_no_signal(spark, small_sf):
    assert QUERIES["gbt_signal"].run(spark, small_sf).collect() == []
