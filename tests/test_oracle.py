"""A sample of registered queries against their SQL; ``check_oracle.py`` runs all of them."""

import pytest

from barloom.catalog import QUERIES
from check_oracle import compare, connect

SAMPLE = [
    "bars", "rsi_14", "macd_hist", "recovery_quality", "parse_number_market", "market_standardize", "file_audit",
    "book_equity", "asof_valuation", "pb_percentile", "tp_sl_labels", "fold_trade_stats", "reoptimized_best",
    "experiment_matrix", "stability_score", "acceptance_checks", "radar_summary",
]


@pytest.fixture(scope="module")
def duck(small_sf):
    return connect(small_sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small_sf, duck, name):
    q = QUERIES[name]
    assert compare(q.run(spark, small_sf).toPandas(), duck.execute(q.oracle()).df()) == "ok"


def test_every_query_but_the_model_has_sql():
    # the last two are compared with SQL over written probabilities in test_modelled.py
    assert {n for n, q in QUERIES.items() if q.sql is None} == {
        "gbt_signal", "feature_importance", "experiment_matrix_model", "stability_model"}
