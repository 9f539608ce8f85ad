"""Walk-forward evaluation with fitted models: out-of-fold probabilities in place of a score column.

Every (group, feature set, label setup, fold) has a model of its own, fitted by Spark ML on the rows of all earlier
segments and applied to the rows of the fold. The labelled rows of all setups are written once, split by
setup; models read their part of that table, a bounded number of them at a time from threads of the driver, and write
what they scored. A table that was written to its end is not made again, so that a run that broke off continues
where it was when it is started again under the same name. The scored rows go through the same statistics as any score column.

``per`` names the keys that have models of their own: none for a panel model over all series, ``["ticker"]``
for one model per ticker, ``["Period_Label"]`` for a panel per period. A panel's folds are those of each
series: a series' rows are only scored by models that saw earlier rows of that series, while other series may
have gone further by then.

How it scales: one model's training is distributed, and its cost grows with rows; the driver keeps a list of the
models, whose number the caller chooses with groups, sets, setups and folds. Training rows are never collected.

Rows that no model scores (the first segment, series with too few rows, folds whose training rows show a single class)
come out with a null score, so that they count as rows and are never traded. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import contracts as K
from barloom.operators import evaluate as E
from barloom.operators import model as M
from barloom.operators.labels import label_frame, label_setups
from barloom.session import complete_table, work_folder, written_once

AT_ONCE = 8
LABEL_COLUMNS = ["LOOKAHEAD", "TP", "SL", "Target", "Holding_Days", "Exit_Return", "Timeout", "Rows", "segment"]


@dataclass(frozen=True)
class Fit:
    """One model: the values of the ``per`` keys, the feature set, the number of the label setup, the fold."""

    group: tuple
    feature_set: str
    setup: int
    fold: int

    def name(self) -> str:
        return hashlib.md5(repr((self.group, self.feature_set, self.setup, self.fold)).encode()).hexdigest()


def evaluable() -> Column:
    return F.col("Rows") >= K.MIN_LABELED_ROWS


def labeled_table(
    features: DataFrame, keys: list[str], grid: list[tuple[int, float, float]], complete: Column, columns: list[str], folder: str
) -> DataFrame:
    """The labelled rows of all setups with their features, as a table split by ``Setup``, the setup's number."""
    rows = label_frame(features, keys, grid, complete, columns, every_series=True)
    number = F.lit(None).cast("int")
    for n, (lookahead, tp, sl) in enumerate(grid):
        number = F.when((F.col("LOOKAHEAD") == lookahead) & (F.col("TP") == tp) & (F.col("SL") == sl), n).otherwise(number)
    rows = rows.select(*keys, "date", *columns, *LABEL_COLUMNS, number.alias("Setup"))
    return written_once(rows, f"{folder}/labeled", ["Setup"])


def fits(labeled: DataFrame, sets: dict[str, list[str]], grid: list, per: list[str], splits: int) -> list[Fit]:
    """All models of a run."""
    groups = [()]
    if per:  # as many as there are models, which the driver starts one by one
        groups = sorted((tuple(r) for r in labeled.select(*per).distinct().collect()), key=str)
    return [Fit(*parts) for parts in itertools.product(groups, sorted(sets), range(len(grid)), range(1, splits + 1))]


def scored_by(fit: Fit, labeled: DataFrame, columns: list[str], keys: list[str], per: list[str], options: dict) -> DataFrame:
    """The rows of the fit's fold with their probability, null where the training rows show a single class."""
    rows = labeled.where((F.col("Setup") == fit.setup) & evaluable())
    for key, value in zip(per, fit.group):
        rows = rows.where(F.col(key).eqNullSafe(F.lit(value)))
    tested = rows.where(F.col("segment") == fit.fold)
    try:
        model = M.fit(rows.where(F.col("segment") < fit.fold), columns, materialized=True, **options)
        tested = M.probability(model, tested)
    except M.SingleClass:
        tested = tested.withColumn("score", F.lit(None).cast("double"))
    return tested.select(*keys, "date", *LABEL_COLUMNS, F.lit(fit.feature_set).alias("Feature_Set"), "score")


def out_of_fold(
    features: DataFrame, keys: list[str], setups: list[dict], complete: Column, sets: dict[str, list[str]], run: str,
    per: list[str] | None = None, at_once: int = AT_ONCE, splits: int = K.CV_SPLITS, **options,
) -> DataFrame:
    """(keys, date, labels, Feature_Set, score) of every labelled row under every set and setup. ``run`` and the definition of
    the run name its folder, so that the same run continues there; other data need another name. ``options`` go to the models."""
    spark, per, grid = features.sparkSession, per or [], label_setups(setups)
    definition = (keys, grid, sorted(sets.items()), per, splits, sorted(options.items()))
    folder = f"{work_folder(spark).rstrip('/')}/{run}-{hashlib.md5(repr(definition).encode()).hexdigest()}"
    columns = sorted({c for names in sets.values() for c in names})
    labeled = labeled_table(features, keys, grid, complete, columns, folder)
    todo = fits(labeled, sets, grid, per, splits)
    never = labeled.where(~F.coalesce((F.col("segment") > 0) & evaluable(), F.lit(False))).select(
        *keys, "date", *LABEL_COLUMNS, F.explode(F.array(*[F.lit(n) for n in sorted(sets)])).alias("Feature_Set"),
        F.lit(None).cast("double").alias("score"),
    )

    def done(fit: Fit) -> str:
        path = f"{folder}/scores/{fit.name()}"
        if not complete_table(spark, path):
            written_once(scored_by(fit, labeled, sets[fit.feature_set], keys, per, options), path)
        return path

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(done), todo))
    if not paths:
        return never
    return never.unionByName(spark.read.schema(never.schema).parquet(*paths))


def model_metrics(rows: DataFrame, keys: list[str], setups: list[dict]) -> DataFrame:
    """Raw metrics per key, feature set, setup and threshold, as of any score column."""
    thresholds = sorted({s["THRESH"] for s in setups})
    return E.setup_metrics(E.fold_table(rows, [*keys, "Feature_Set"], thresholds), [*keys, "Feature_Set"])


def fold_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, set, setup and usable fold: rows and positives to train on and to test, rows with a probability, and
    rows whose score is none."""
    folds = E.fold_table(rows, [*keys, "Feature_Set"], [0.0]).where("usable")
    told = rows.where("score is not null").groupBy(*keys, "Feature_Set", *E.SETUP, F.col("segment").alias("Fold")).agg(
        F.count("*").alias("Scored"), F.count_if(~F.col("score").between(0, 1)).alias("Out_Of_Range"),
    )
    shared = [*keys, "Feature_Set", *E.SETUP, "Fold"]
    return folds.select(*shared, "Train_Count", "Train_Positive", "Test_Count", "Test_Positive").join(told, shared, "left").fillna(
        0, ["Scored", "Out_Of_Range"]
    )
