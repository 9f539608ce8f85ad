"""Physical plans: what must not appear, and where shuffles may."""

import re

import pytest

from barloom.catalog import QUERIES, base
from barloom.catalog.evaluation import NEEDED, complete, one_score
from barloom.contracts import PROFILES, grid_rows
from barloom.operators.registry import feature_sets
from barloom.plans import search

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]
ALL = sorted({c for columns in feature_sets().values() for c in columns})


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql is not None))
def test_no_cross_join_and_no_python_in_any_plan(spark, small_sf, name):
    plan = plan_of(QUERIES[name].run(spark, small_sf))
    assert not [word for word in FORBIDDEN if word in plan]


def test_feature_stack_shuffles_bars_once_by_key(spark, small_sf):
    plan = plan_of(base.feature_frame(spark, small_sf, columns=ALL))
    by_key = re.findall(r"Exchange hashpartitioning\(ticker#\d+, \d+\)", plan)
    assert len(by_key) == 1
    # the others reduce line items to bars and to benchmark bars, after a partial aggregation
    assert plan.count("Exchange hashpartitioning") == 3
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scan_reads_only_needed_columns(spark, small_sf):
    plan = base.feature_frame(spark, small_sf, columns=["RSI_14"]).select("ticker", "date", "RSI_14")
    text = plan_of(plan)
    assert "l_tax" not in text and "l_returnflag" not in text and "l_discount" not in text


def test_grid_search_needs_no_shuffle_beyond_the_feature_stack(spark, small_sf):
    setups = grid_rows("SWING", PROFILES["SWING"])
    frame = base.feature_frame(spark, small_sf, columns=NEEDED)
    plan = plan_of(search.grid_metrics(frame, ["ticker"], setups, complete(), one_score()))
    # exploded label rows are aggregated where the ticker's bars already are
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    assert len(re.findall(r"Exchange hashpartitioning\(ticker#\d+, \d+\)", plan)) == 1


def test_date_votes_need_no_window(spark, small_sf):
    assert "Window" not in plan_of(QUERIES["date_order_detect"].run(spark, small_sf))


def test_features_over_a_bucketed_table_need_no_shuffle(spark, small_sf):
    plan = plan_of(QUERIES["bucketed_features"].run(spark, small_sf))
    bars = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning(ticker" not in plan and "Bucketed: true" in plan and "Window" in bars


def test_named_tickers_read_their_buckets(spark):
    from barloom.sources.bars import bucketed_bars
    from barloom.sources.results import save_bucketed

    rows = spark.range(100).selectExpr("concat('T', id % 10) ticker", "date_add(date'2026-01-01', cast(id as int)) date", "id close")
    save_bucketed(rows, "pruned_bars", ["ticker"], buckets=16)
    one = bucketed_bars(spark, "pruned_bars", ["T3"])
    assert one.count() == 10 and bucketed_bars(spark, "pruned_bars").count() == 100
    grouped = plan_of(one.groupBy("ticker").count())
    assert "SelectedBucketsCount: 1 out of 16" in grouped and "Exchange" not in grouped


def test_work_folder_is_never_local_to_one_machine_of_several():
    from types import SimpleNamespace

    from barloom.session import work_folder

    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
            sparkContext=SimpleNamespace(master=master))

    assert work_folder(session("spark://h:7077", spark_checkpoint_dir="hdfs:/w")) == "hdfs:/w"
    assert work_folder(session("local[4]", spark_sql_warehouse_dir="file:/w")) == "file:/w/_work"
    assert work_folder(session("yarn", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_work"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(session("yarn", spark_sql_warehouse_dir="file:/w"))
