"""Joins of many rows with one row per group (file, sheet, vendor), where one group may hold most rows.

A dimension of at most ``SMALL`` rows, counted first, is broadcast, and the rows stay where they are. Beyond that
the heavy groups, those with more than one row in ``HEAVY``, are dealt over ``COPIES`` copies of their dimension row. There are at
most ``HEAVY`` such groups whatever the size of the table, so that their names may stand in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SMALL = 10_000
HEAVY = 256
COPIES = 64


def with_group(
    rows: DataFrame, groups: DataFrame, key: str, spread: str, count: str = "n", small: int = SMALL, copies: int = COPIES
) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, ``count`` its number of rows) on ``key``. ``spread`` is a
    column that differs inside a group; ``count`` stays behind."""
    if groups.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(groups.drop(count)), key)
    total = groups.agg(F.sum(count)).first()[0] or 0
    heavy = [r[key] for r in groups.where(F.col(count) * HEAVY > F.lit(total)).select(key).collect()]  # at most HEAVY
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    dealt = groups.drop(count).withColumn(
        "__copy", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    salted = rows.withColumn("__copy", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(copies))).otherwise(0).cast("int"))
    return salted.join(dealt, [key, "__copy"]).drop("__copy")


def leading(rows: DataFrame, order: str = "ordinal") -> Column:
    """``order``, or its first part if it is a struct: a number is compared in a hash table, a struct only after sorting."""
    kind = rows.schema[order].dataType
    return F.col(order)[kind.fieldNames()[0]] if isinstance(kind, StructType) else F.col(order)


def least_rows(rows: DataFrame, groups: DataFrame, key: str = "file", order: str = "ordinal", small: int = SMALL) -> DataFrame:
    """The rows whose ``leading`` part is ``least`` in their group, with ``n``. The first row by ``order`` is among them, and all
    others are spared the sorting. ``groups``: (key, n, least)."""
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # rows without a name are a group too
    told = rows.withColumns({"leading": leading(rows, order), "named": named})
    least = groups.select(named.alias("named"), "least", "n", F.col("n").alias("rows"))
    told = with_group(told, least, "named", order, count="rows", small=small)
    # in a struct a null comes first
    return told.where("leading is null or leading = least").select(*rows.columns, "n")
