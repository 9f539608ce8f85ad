"""Point-in-time and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], right_columns: list[str]
) -> DataFrame:
    """Each left row with the last right row of its key at or before it (inclusive, backward).

    Both sides go into one stream ordered by time, right rows first on ties, and the last right row
    seen is carried forward: one shuffle, no range explosion. Both sides hold at most one row per
    key and day, so a group is bounded by the calendar.
    """
    carried = F.struct(right_on, *[c for c in right_columns if c != right_on])
    left_side = left.select(
        *by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*[c for c in left.columns if c not in by]).alias("__left"),
        F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__right"),
    )
    right_side = right.select(
        *by, F.col(right_on).alias("__t"), F.lit(0).alias("__side"),
        F.lit(None).cast(left_side.schema["__left"].dataType).alias("__left"),
        carried.alias("__right"),
    )
    seen = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matched = left_side.unionByName(right_side).withColumn(
        "__match", F.last("__right", ignorenulls=True).over(seen)
    )
    return matched.where("__side = 1").select(*by, "__left.*", "__match.*")


def spread_periods(bars: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """One copy of a bar for every period that contains its date, both ends included.

    The few periods are a literal array inside the row expression, so this is a map, not a join."""
    spans = F.array(
        *[
            F.struct(
                F.lit(label).alias("Period_Label"),
                F.lit(start).cast("date").alias("Period_Start"),
                F.lit(end).cast("date").alias("Period_End"),
            )
            for label, start, end in periods
        ]
    )
    inside = F.filter(
        spans, lambda p: (F.col("date") >= p["Period_Start"]) & (F.col("date") <= p["Period_End"])
    )
    return bars.select(F.explode(inside).alias("__p"), "*").select("__p.*", *bars.columns)


def keep_long_series(df: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Drop series with fewer than ``minimum`` rows.

    Counted by a combining aggregate and semi-joined back, so a short or long key never has to sit
    in one window group for this."""
    long_enough = df.groupBy(*keys).count().where(F.col("count") >= minimum).select(*keys)
    return df.join(long_enough, keys, "left_semi")
