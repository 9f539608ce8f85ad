"""First-hit take-profit / stop-loss labels and walk-forward fold numbers.

The forward path of closes is gathered once, at the longest lookahead of the grid, and every setup
reads its answer from it: one search per distinct take-profit and per distinct stop-loss level, then
constant work per setup. Row ranks and fold borders are computed before setups are exploded, so a
grid of any size adds rows only inside a pipeline that ends in a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.contracts import CV_SPLITS, MIN_LABELED_ROWS, TRAIN_RATIO
from barloom.operators.windows import Series

LABELS = ["Target", "Holding_Days", "Exit_Return", "Exit_Reason", "Timeout"]


def label_setups(setups: list[dict]) -> list[tuple[int, float, float]]:
    """Distinct (lookahead, tp, sl), in order; thresholds do not change labels."""
    return list(dict.fromkeys((s["LOOKAHEAD"], s["TP"], s["SL"]) for s in setups))


def add_paths(df: DataFrame, series: Series, longest: int) -> DataFrame:
    """``future``: the relative moves to the next ``longest`` closes, fewer at the series' end."""
    path = F.collect_list("Close").over(series.ahead(longest))
    return df.withColumn("__path", path).withColumn(
        "future", F.transform("__path", lambda x: (x - F.col("Close")) / F.col("Close"))
    ).drop("__path")


def _first_hits(levels: list[float], hit) -> Column:
    """array: 1-based position in ``future`` of the first hit per level, 0 for none."""

    def first(level: float) -> Column:
        return F.array_position(F.transform("future", lambda x: hit(x, F.lit(level))), True).cast("int")

    return F.array(*[first(level) for level in levels])


def _moves_at(positions: Column) -> Column:
    return F.transform(positions, lambda p: F.get("future", p - 1))


def explode_labels(df: DataFrame, grid: list[tuple[int, float, float]], stands_in: Column | None = None) -> DataFrame:
    """One row per bar and setup with the five label columns, plus LOOKAHEAD, TP, SL.

    Rows with fewer than LOOKAHEAD bars ahead have no label and are dropped, even after a hit, but for those that
    ``stands_in``, over the columns of ``df`` and ``s.LOOKAHEAD``, keeps.
    Searches happen before the explode and the path stays behind: an exploded row carries only
    its setup and the few positions and moves at which something can happen.
    """
    tps, sls, las = (sorted({g[i] for g in grid}) for i in (1, 2, 0))
    setups = F.array(
        *[
            F.struct(
                F.lit(la).alias("LOOKAHEAD"), F.lit(tp).alias("TP"), F.lit(sl).alias("SL"),
                F.lit(tps.index(tp)).alias("tp_i"), F.lit(sls.index(sl)).alias("sl_i"),
                F.lit(las.index(la)).alias("la_i"),
            )
            for la, tp, sl in grid
        ]
    )
    kept = [c for c in df.columns if c != "future"]
    hits = df.withColumns(
        {
            "tp_hits": _first_hits(tps, lambda x, level: x >= level),
            "sl_hits": _first_hits(sls, lambda x, level: x <= level),
            "ahead": F.size("future"),
        }
    ).withColumns(
        {
            "tp_moves": _moves_at(F.col("tp_hits")),
            "sl_moves": _moves_at(F.col("sl_hits")),
            "la_moves": _moves_at(F.array(*[F.lit(la) for la in las])),
        }
    ).drop("future")
    lookahead = F.col("s.LOOKAHEAD")
    labeled = lookahead <= F.col("ahead")
    hits = hits.withColumn("s", F.explode(setups)).where(labeled if stands_in is None else labeled | stands_in)
    if stands_in is not None:
        kept.remove("first_bar")

    def within(position: Column) -> Column:
        return F.when((position > 0) & (position <= lookahead), position)

    hits = hits.withColumns(
        {
            "tp_at": within(F.get("tp_hits", F.col("s.tp_i"))),
            "sl_at": within(F.get("sl_hits", F.col("s.sl_i"))),
        }
    )
    # the stop-loss is tested first on each bar
    stopped = F.col("sl_at").isNotNull() & (F.col("tp_at").isNull() | (F.col("sl_at") <= F.col("tp_at")))
    won = ~stopped & F.col("tp_at").isNotNull()
    return hits.withColumns({"stopped": stopped, "won": won}).select(
        *kept, "s.LOOKAHEAD", "s.TP", "s.SL",
        F.col("won").cast("int").alias("Target"),
        F.when(F.col("stopped"), F.col("sl_at")).when(F.col("won"), F.col("tp_at")).otherwise(lookahead)
        .alias("Holding_Days"),
        F.when(F.col("stopped"), F.get("sl_moves", F.col("s.sl_i")))
        .when(F.col("won"), F.get("tp_moves", F.col("s.tp_i")))
        .otherwise(F.get("la_moves", F.col("s.la_i"))).alias("Exit_Return"),
        F.when(F.col("stopped"), "sl").when(F.col("won"), "tp").otherwise("timeout").alias("Exit_Reason"),
        (~F.col("stopped") & ~F.col("won")).cast("int").alias("Timeout"),
    )


def rank_rows(
    df: DataFrame, series: Series, lookaheads: list[int], complete: Column, keep_first: bool = False
) -> DataFrame:
    """Keep complete rows; ``rank`` is their 0-based order, ``labeled`` maps a lookahead to the
    number of complete rows that get a label. Neither depends on tp or sl, so both are known
    before setups are exploded. With ``keep_first`` the series' ``first_bar`` stays in any case, without
    a path if it is not complete."""
    df = df.withColumn("__ok", F.coalesce(complete, F.lit(False)))
    df = df.withColumn("rank", F.sum(F.col("__ok").cast("int")).over(series.so_far) - 1)
    counts = {
        f"__n{la}": F.count(F.when(F.col("__ok") & (F.size("future") >= la), 1)).over(series.whole)
        for la in lookaheads
    }
    if keep_first:
        df = df.withColumns({**counts, "first_bar": series.row_number() == 1}).where("__ok OR first_bar").withColumn(
            "future", F.when(F.col("__ok"), F.col("future")).otherwise(F.array().cast("array<double>"))
        )
    else:
        df = df.withColumns(counts).where("__ok")
    labeled = F.create_map(*[x for la in lookaheads for x in (F.lit(la), F.col(f"__n{la}"))])
    return df.withColumn("labeled", labeled).drop("__ok", *counts)


def fold_segment(rank: Column, rows: Column, splits: int = CV_SPLITS) -> Column:
    """0 for rows before the first test span, i for rows in test span i. Fold i trains on all
    segments below i: the expanding-window split with test size rows div (splits + 1)."""
    test_size = F.floor(rows / (splits + 1))
    first_test = rows - splits * test_size
    return F.when(rank < first_test, 0).otherwise(
        1 + F.floor((rank - first_test) / F.nullif(test_size, F.lit(0)))
    ).cast("int")


def label_frame(
    features: DataFrame,
    keys: list[str],
    grid: list[tuple[int, float, float]],
    complete: Column,
    carry: list[Column | str],
    every_series: bool = False,
) -> DataFrame:
    """Bars to labeled rows of every setup: keys, date, ``carry`` columns, setup, labels, rank,
    number of labeled rows (``Rows``) and fold ``segment``. With ``every_series`` a series without any labeled
    row for a setup is represented by its first bar, with 0 ``Rows``, so that no second pass has to find it."""
    series = Series(keys)
    lookaheads = sorted({la for la, _, _ in grid})
    df = add_paths(features, series, max(lookaheads))
    df = rank_rows(df, series, lookaheads, complete, every_series)
    first = ["first_bar"] if every_series else []
    df = df.select(*keys, "date", *carry, "rank", "labeled", "future", *first)
    unlabeled = F.col("first_bar") & (F.try_element_at("labeled", F.col("s.LOOKAHEAD")) == 0)
    df = explode_labels(df, grid, unlabeled if every_series else None)
    rows = F.try_element_at("labeled", F.col("LOOKAHEAD"))
    df = df.withColumn("Rows", rows).drop("labeled")
    return df.withColumn("segment", fold_segment(F.col("rank"), F.col("Rows")))


def enough_rows(minimum: int = MIN_LABELED_ROWS) -> Column:
    return F.col("Rows") >= minimum


def complete_rows(columns: list[str]) -> Column:
    """True where none of the columns is null."""
    check = F.lit(True)
    for name in columns:
        check = check & F.col(name).isNotNull()
    return check


def holdout_side(rank: Column, rows: Column, ratio: float = TRAIN_RATIO) -> Column:
    """Chronological hold-out: the first int(rows * ratio) rows train, the rest test."""
    return F.when(rank < F.floor(rows * ratio), "train").otherwise("test")


def training_rows(labeled: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Labeled rows strictly before the key's latest complete feature date."""
    # one row per key on the right: an ordinary equi-join, broadcast by the planner when small
    return labeled.join(latest.select(*keys, "Latest_Feature_Date"), keys).where(
        F.col("date") < F.col("Latest_Feature_Date")
    )


def latest_complete(features: DataFrame, keys: list[str], complete: Column, carry: list[str]) -> DataFrame:
    """Per key: latest complete row, latest data date and the lag between them."""
    usable = F.coalesce(complete & F.col("Close").isNotNull(), F.lit(False))
    row = F.struct("date", "Close", *carry)
    latest = features.groupBy(*keys).agg(
        F.max("date").alias("Latest_Data_Date"),
        F.max_by(F.when(usable, row), F.when(usable, F.col("date"))).alias("row"),
    ).where("row IS NOT NULL")
    return latest.select(
        *keys,
        F.col("row.date").alias("Latest_Feature_Date"),
        "Latest_Data_Date",
        F.datediff("Latest_Data_Date", "row.date").alias("Data_Lag_Days"),
        F.col("row.Close").alias("Latest_Close"),
        *[F.col(f"row.{c}").alias(c) for c in carry],
    )
