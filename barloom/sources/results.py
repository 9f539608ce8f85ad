"""Result tables: scans with schema checks, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numbers import safe_float
from barloom.sources.bars import read_market_csv

# fixed values: the columns that make a file a grid result
GRID_COLUMNS = [
    "Feature_Set", "LOOKAHEAD", "TP", "SL", "THRESH", "Pass_Periods", "Avg_Edge", "Min_Edge",
    "Avg_Return", "Total_Trades",
]
GRID_NUMBERS = GRID_COLUMNS[1:]


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table written as CSV, header names stripped."""
    df = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return df.toDF(*[c.replace("\ufeff", "").strip() for c in df.columns])


def is_grid_result(df: DataFrame) -> bool:
    return set(GRID_COLUMNS) <= set(df.columns)


def scan_grid_results(spark: SparkSession, path: str) -> DataFrame:
    """All grid-result CSVs below ``path``, tagged with file and modification time.

    Columns are matched by header name per file; a file lacking one of the required columns
    contributes nothing. Numbers may be percent texts."""
    raw = read_market_csv(spark, path)
    heads = raw.groupBy("file").agg(F.min("ordinal").alias("first"), F.min_by("cells", "ordinal").alias("header"))
    wanted = [*GRID_COLUMNS, "Frozen_Strict_Candidate"]
    at = [
        (F.array_position(F.transform("header", lambda h: F.ltrim(F.translate(h, "\ufeff", ""))), n) - 1).alias(f"at_{n}")
        for n in wanted
    ]
    heads = heads.select("file", "first", *at)
    for name in GRID_COLUMNS:
        heads = heads.where(F.col(f"at_{name}") >= 0)
    rows = raw.join(heads, "file").where(F.col("ordinal") > F.col("first"))

    def cell(name: str):
        return F.when(F.col(f"at_{name}") >= 0, F.get("cells", F.col(f"at_{name}").cast("int")))

    return rows.select(
        F.col("file").alias("Source_File"), F.col("modified").alias("Source_Modified"), cell("Feature_Set").alias("Feature_Set"),
        *[safe_float(cell(n)).alias(n) for n in GRID_NUMBERS],
        F.coalesce(F.lower(cell("Frozen_Strict_Candidate")).isin("true", "1", "yes", "y"), F.lit(False))
        .alias("Frozen_Strict_Candidate"),
    )


FORMATS = ("csv", "parquet", "json")


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result table; CSV carries a header."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_bucketed(df: DataFrame, table: str, keys: list[str], order: str = "date", buckets: int = 64) -> None:
    """Write a table that keeps the rows of a key together and in order, one file per bucket, so that windows and joins over
    the keys need no shuffle when it is read. Buckets are a property of the table: take about one per executor core."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, order).saveAsTable(table)


def save_signals(signals: DataFrame, path: str) -> None:
    """Nested signal rows as JSON lines, one folder per ticker."""
    signals.withColumn("folder", F.col("ticker")).write.mode("overwrite").partitionBy("folder").json(path)
