"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Bars
are cut by brand and type, 150 tickers and about 300,000 bars at sf0.1.
"""

from __future__ import annotations

import json
import os
import time

from barloom import contracts as K
from barloom.catalog import QUERIES, base
from barloom.catalog.evaluation import FIXED, NEEDED, PERIODS, complete, one_score
from barloom.operators.registry import feature_sets
from barloom.plans import search
from barloom.plans.walkforward import frozen_grid, period_features
from barloom.session import build_session

TICKER = "p_brand || '/' || p_type"
SWING = K.grid_rows("SWING", K.PROFILES["SWING"])


def all_features(spark, sf_dir):
    names = sorted({c for columns in feature_sets().values() for c in columns})
    return base.feature_frame(spark, sf_dir, ticker=TICKER, columns=names)


def features(spark, sf_dir):
    return base.feature_frame(spark, sf_dir, ticker=TICKER, columns=NEEDED)


def flagship(spark, sf_dir):
    metrics = search.grid_metrics(features(spark, sf_dir), ["ticker"], FIXED, complete(), one_score())
    return search.profile_results(metrics, FIXED, cost=0.005, min_edge=0.02)


def profile_search(spark, sf_dir):
    metrics = search.grid_metrics(features(spark, sf_dir), ["ticker"], SWING, complete(), one_score())
    results = search.profile_results(metrics, SWING)
    return search.best_setups(results, ["ticker", "Feature_Set"], SWING)


def period_grid(spark, sf_dir):
    bars = base.bars(spark, sf_dir, TICKER)
    frame = period_features(bars, base.index_bars(spark, sf_dir), PERIODS, NEEDED)
    return frozen_grid(frame, SWING, complete(), one_score())[1]


def registered(name):
    return QUERIES[name].run


BENCH = {
    "flagship": flagship,
    "all_features": all_features,
    "profile_search": profile_search,
    "period_grid": period_grid,
    "rsi_14": registered("rsi_14"),
    "macd_hist": registered("macd_hist"),
    "recovery_quality": registered("recovery_quality"),
    "asof_valuation": registered("asof_valuation"),
    "pb_percentile": registered("pb_percentile"),
    "market_standardize": registered("market_standardize"),
    "book_equity": registered("book_equity"),
    "tp_sl_labels": registered("tp_sl_labels"),
    "stability_score": registered("stability_score"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name, build in BENCH.items():
        started = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
