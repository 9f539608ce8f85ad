"""Point-in-time valuation ratios and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.contracts import EPS
from barloom.functions.numbers import finite
from barloom.operators.joins import asof_join
from barloom.operators.windows import Series

BOOK_COLUMNS = ["effective_date", "calendar_year", "calendar_quarter", "quarter_end_date", "book_equity_parent"]


def build_valuation(
    market_cap: DataFrame, book: DataFrame, window: int = 756, min_periods: int = 120
) -> DataFrame:
    """Daily market cap (ticker, date, close, market_cap) with the last published book equity."""
    columns = [c for c in book.columns if c != "ticker"]
    df = asof_join(market_cap, book, "date", "effective_date", ["ticker"], columns)
    df = df.withColumn("PB", finite(F.col("market_cap") / (F.col("book_equity_parent") + EPS)))
    return add_ratio_windows(df, window, min_periods).withColumns(
        {
            "Book_to_Market": F.when(F.col("PB") > 0, 1 / (F.col("PB") + EPS)),
            "Log_PB": F.when(F.col("PB") > 0, F.log("PB")),
            "MarketCap_TyDong": F.col("market_cap") / 1e9,
            "Book_Equity_Parent_TyDong": F.col("book_equity_parent") / 1e9,
        }
    )


def add_ratio_windows(df: DataFrame, window: int, min_periods: int) -> DataFrame:
    s = Series(["ticker"])
    df = df.withColumns(
        {
            "__mean": s.roll("PB", window, F.avg, min_periods),
            "__std": s.roll("PB", window, F.stddev_samp, min_periods),
            "__past": s.roll("PB", window, F.collect_list, min_periods),
        }
    )
    at_most = F.size(F.filter("__past", lambda x: x <= F.col("PB")))
    return df.withColumns(
        {
            f"PB_Z_{window}": (F.col("PB") - F.col("__mean")) / (F.col("__std") + EPS),
            f"PB_Percentile_{window}": F.when(
                F.col("PB").isNotNull() & F.col("__past").isNotNull(), at_most / F.size("__past")
            ),
        }
    ).drop("__mean", "__std", "__past")


def merge_valuation(features: DataFrame, valuation: DataFrame, columns: list[str]) -> DataFrame:
    """Left join on (ticker, date); valuation columns the table lacks become null."""
    have = [c for c in columns if c in valuation.columns]
    lacking = [F.lit(None).cast("double").alias(c) for c in columns if c not in have]
    joined = features.join(valuation.select("ticker", "date", *have), ["ticker", "date"], "left")
    return joined.select("*", *lacking)


def valuation_audit(valuation: DataFrame) -> DataFrame:
    """(ticker, check, value, status), all from one combining aggregation.

    The exact median needs the values in order; percentile aggregates buffer value counts, bounded
    by the days of one ticker."""
    pb, day = F.col("PB"), F.col("date")
    a = valuation.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(pb).alias("with_pb"),
        F.min(day).alias("start"),
        F.max(day).alias("end"),
        F.min(pb).alias("low"),
        F.median(pb).alias("mid"),
        F.max(pb).alias("high"),
        F.max_by(pb, F.when(pb.isNotNull(), day)).alias("latest"),
        F.sum(F.when(F.col("effective_date") > day, 1).otherwise(0)).alias("leaks"),
    )
    c = F.col

    def entry(name: str, value, status, present=None):
        row = F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"), status.alias("status"))
        return row if present is None else F.when(present, row)

    ok, has_pb = F.lit("ok"), c("with_pb") > 0

    def ratio(value):
        return F.round(value, 6)

    # fixed values: check names and statuses
    checks = F.array(
        entry("rows_total", c("rows"), ok),
        entry("rows_with_pb", c("with_pb"), F.when(has_pb, "ok").otherwise("empty")),
        entry("rows_missing_pb", c("rows") - c("with_pb"), F.when(c("rows") > c("with_pb"), "review").otherwise("ok")),
        entry("start_date", c("start"), ok),
        entry("end_date", c("end"), ok),
        entry("pb_min", ratio(c("low")), ok, has_pb),
        entry("pb_median", ratio(c("mid")), ok, has_pb),
        entry("pb_max", ratio(c("high")), F.when(c("high") > 20, "review").otherwise("ok"), has_pb),
        entry("latest_pb", ratio(c("latest")), ok, has_pb),
        entry("lookahead_leakage_rows", c("leaks"), F.when(c("leaks") == 0, "ok").otherwise("fail")),
        entry("ticker", c("ticker"), ok),
    )
    return a.select("ticker", F.inline(F.filter(checks, lambda e: e.isNotNull())))
