"""Walk-forward with fitted models: SQL over the written probabilities, no row scored by a model that saw it,
runs that continue, one model per ticker. Trees are few to keep the tests short."""

import uuid

import pytest

from barloom import contracts as K
from barloom.catalog import QUERIES, models
from barloom.catalog.base import Query, feature_frame
from barloom.operators import model as M
from barloom.operators.labels import complete_rows
from barloom.plans import modelled
from check_oracle import compare, connect

SF = "/root/testdata/sf0.01"
SMALL = {"trees": 3, "depth": 2}


def run_name(name):
    """The work folder may outlive a session."""
    return f"{name}-{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def small_models():
    """Fits with few trees, whatever is asked for; what was asked for and which rows were seen is kept."""
    asked, fit = [], M.fit

    def small(train, columns, **options):
        asked.append((columns, options, train))
        return fit(train, columns, **{**options, **SMALL})

    M.fit = small
    yield asked
    M.fit = fit


def same_as_sql(spark, name, sql, rows):
    con = connect(SF)
    con.register("oof", rows.toPandas())
    q = QUERIES[name]
    expected = Query(name, q.build, sql, q.digits).oracle()
    got = q.run(spark, SF).toPandas()
    assert len(got) and compare(got, con.execute(expected).df()) == "ok"
    return got


def test_queries_equal_sql_over_written_probabilities(spark, small_models):
    rows = models.probabilities(spark, SF)
    expected = len(models.MODEL_SETS) * K.CV_SPLITS
    assert len(small_models) == expected
    # the published size is what the queries ask for
    assert all(not {"trees", "depth"} & set(options) for _, options, _ in small_models)
    matrix = same_as_sql(spark, "experiment_matrix_model", models.matrix_sql(), rows)
    assert (matrix.Trades > 0).any()
    folds = QUERIES["model_folds"]
    got = folds.run(spark, SF).toPandas()
    assert len(got) and compare(got, connect(SF).execute(folds.oracle()).df()) == "ok"
    assert len(small_models) == expected  # nothing was fitted again

    periods = models.period_probabilities(spark, SF)
    assert len(small_models) == expected * (1 + len(models.MODEL_PERIODS))
    same_as_sql(spark, "stability_model", models.stability_sql(), periods)


def frame(spark):
    features = feature_frame(spark, SF, columns=["RSI_14", "Volatility"])
    return features.where("ticker in ('Brand#11', 'Brand#12')")


def test_no_row_is_scored_by_a_model_that_saw_it(spark, small_models):
    del small_models[:]
    sets = {"a": ["RSI_14", "Volatility"]}
    rows = modelled.out_of_fold(
        frame(spark), ["ticker"], models.MODEL_SETUPS, complete_rows(sets["a"]), sets, run_name("seen"), per=["ticker"], at_once=1).toPandas()
    assert len(small_models) == 2 * K.CV_SPLITS  # one model per ticker and fold
    scored = rows[rows.score.notna()]
    assert scored.score.between(0, 1).all() and set(scored.segment) == {1, 2, 3}
    order = [(t, f) for t in ("Brand#11", "Brand#12") for f in (1, 2, 3)]
    for (ticker, fold), (_, _, train) in zip(order, small_models):
        test = scored[(scored.ticker == ticker) & (scored.segment == fold)]
        earlier = rows[(rows.ticker == ticker) & (rows.segment < fold)]
        assert train.count() == len(earlier) and earlier.date.max() < test.date.min()


def test_a_run_continues_where_it_broke_off(spark, monkeypatch):
    sets, fit, calls, name = {"a": ["RSI_14"], "b": ["Volatility"]}, M.fit, [], run_name("broken")

    def fails_later(train, columns, **options):
        calls.append(columns)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return fit(train, columns, **{**options, **SMALL})

    def run():
        return modelled.out_of_fold(
            frame(spark), ["ticker"], models.MODEL_SETUPS, complete_rows(["RSI_14", "Volatility"]), sets, name, at_once=1)

    monkeypatch.setattr(M, "fit", fails_later)
    with pytest.raises(RuntimeError):
        run()
    rows = run()
    assert len(calls) == 1 + len(sets) * K.CV_SPLITS  # only the broken one was repeated
    assert rows.where("score is not null").groupBy("Feature_Set").count().count() == 2


def test_rows_without_a_model_count_and_are_not_traded(spark, small_models):
    # labels of one class: tp is out of reach
    setup = {**models.MODEL_SETUPS[0], "TP": 1e9}
    rows = modelled.out_of_fold(frame(spark), ["ticker"], [setup], complete_rows(["RSI_14"]), {"a": ["RSI_14"]}, run_name("flat"))
    assert rows.count() and rows.where("score is not null").isEmpty()
    metrics = modelled.model_metrics(rows, ["ticker"], [setup]).collect()
    assert len(metrics) == 2 and all(m["Trades"] == 0 and m["Rows"] > 100 for m in metrics)
    empty = modelled.out_of_fold(frame(spark).limit(0), ["ticker"], [setup], complete_rows(["RSI_14"]), {"a": ["RSI_14"]}, run_name("none"), per=["ticker"])
    assert empty.count() == 0
