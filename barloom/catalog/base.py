"""Registry, and the bar tables derived from the order tables.

Derived tables are built from integer cents with one division, so they agree to the last bit
between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.features import add_features, join_benchmark


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)
    #: digits after the first one; for sums of any size, whose last bits depend on the order of summing
    significant: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        # + 0.0 turns -0.0 into 0.0
        rounded = {c: F.round(c, n) + F.lit(0.0) for c, n in self.digits.items()}
        rounded |= {
            c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}e", F.col(c))).cast("double") + F.lit(0.0)
            for c, n in self.significant.items()
        }
        return df.select(*[rounded[c].alias(c) if c in rounded else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        swaps = [f"round({c}, {n}) + 0.0 AS {c}" for c, n in self.digits.items()]
        swaps += [f"CAST(printf('%.{n}e', {c}) AS double) + 0.0 AS {c}" for c, n in self.significant.items()]
        if not swaps:
            return self.sql
        swaps = ", ".join(swaps)
        return f"SELECT * REPLACE ({swaps}) FROM ({self.sql}) answer"


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None, significant: dict[str, int] | None = None):
    def register(build):
        QUERIES[name] = Query(name, build, sql, digits or {}, significant or {})
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents():
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def units():
    return F.col("l_quantity").cast("bigint")


def trades(spark: SparkSession, sf_dir: str, ticker: str = "p_brand"):
    """Line items with their ticker. The join has no hint: the planner broadcasts ``part`` when its
    statistics allow and otherwise shuffles, splitting skewed partitions."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(ticker).alias("ticker"))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    flow = F.when(F.col("l_returnflag") == "N", units()).when(F.col("l_returnflag") == "R", -units()).otherwise(0)
    return (
        trades(spark, sf_dir, ticker)
        .groupBy("ticker", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.sum(cents()).cast("double") / F.sum(units()).cast("double") / 100.0).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum(units()).cast("double").alias("volume"),
            F.sum(flow).cast("double").alias("net_volume_foreign"),
        )
    )


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.sum(cents()).cast("double") / F.sum(units()).cast("double") / 100.0).alias("vn_close"),
            F.sum(units()).cast("double").alias("vn_volume"),
        )
    )


def joined(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    return join_benchmark(bars(spark, sf_dir, ticker), index_bars(spark, sf_dir))


def feature_frame(spark: SparkSession, sf_dir: str, ticker: str = "p_brand", **options) -> DataFrame:
    return add_features(joined(spark, sf_dir, ticker), **options)


# ---- the same tables as SQL ----------------------------------------------------------------------

BARS = """bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS date) AS date,
    CAST(sum(CAST(round(l_extendedprice*100) AS bigint)) AS double)
      / CAST(sum(CAST(l_quantity AS bigint)) AS double) / 100.0 AS close,
    max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
    CAST(sum(CAST(l_quantity AS bigint)) AS double) AS volume,
    CAST(sum(CASE WHEN l_returnflag='N' THEN CAST(l_quantity AS bigint)
                  WHEN l_returnflag='R' THEN -CAST(l_quantity AS bigint) ELSE 0 END) AS double) AS net_volume_foreign
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)"""

INDEX_BARS = """index_bars AS (
  SELECT CAST(l_shipdate AS date) AS date,
    CAST(sum(CAST(round(l_extendedprice*100) AS bigint)) AS double)
      / CAST(sum(CAST(l_quantity AS bigint)) AS double) / 100.0 AS vn_close,
    CAST(sum(CAST(l_quantity AS bigint)) AS double) AS vn_volume
  FROM lineitem GROUP BY 1)"""

JOINED = f"""{BARS}, {INDEX_BARS}, j AS MATERIALIZED (
  SELECT b.*, i.vn_close, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS rn
  FROM bars b JOIN index_bars i ON b.date = i.date)"""


def roll(aggregate: str, column: str, rows: int, minimum: int | None = None) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count({column}) {frame} >= {minimum or rows} THEN {aggregate}({column}) {frame} END"
    )


def lag(column: str, rows: int = 1) -> str:
    return f"lag({column}, {rows}) OVER (PARTITION BY ticker ORDER BY date)"


def returns_sql(joined: str = JOINED) -> str:
    return f"""{joined}, ret AS MATERIALIZED (
  SELECT *, ln(close / c1) AS r, ln(vn_close / vn1) AS vn_r, ln(close / c1) - ln(vn_close / vn1) AS rel,
    abs(close - c1) AS step, close * volume AS dv,
    CASE WHEN ln(close / c1) < 0 THEN ln(close / c1) ELSE 0 END AS fall,
    abs(ln(close / c1)) / (close * volume + 1e-9) AS impact,
    CASE WHEN close - c1 > 0 THEN close - c1 ELSE 0 END AS gain,
    CASE WHEN close - c1 < 0 THEN c1 - close ELSE 0 END AS loss
  FROM (SELECT *, {lag('close')} AS c1, {lag('vn_close')} AS vn1, {lag('close', 10)} AS c10,
          {lag('close', 14)} AS c14, {lag('close', 20)} AS c20, {lag('close', 30)} AS c30,
          {lag('volume')} AS v1 FROM j) lagged)"""


RETURNS = returns_sql()


def ewm_cte(name: str, specs: dict[str, tuple[str, float]], base: str = "ret", seed_row: int = 1) -> str:
    """A recursive CTE running the textbook recursion one bar at a time."""
    seeds = ", ".join(f"CAST({source} AS double) AS {out}" for out, (source, _) in specs.items())
    steps = ", ".join(
        f"(1 - {alpha!r}) * e.{out} + {alpha!r} * b.{source}" for out, (source, alpha) in specs.items()
    )
    return f"""{name} AS (
  SELECT ticker, rn, {seeds} FROM {base} WHERE rn = {seed_row}
  UNION ALL
  SELECT b.ticker, b.rn, {steps}
  FROM {name} e JOIN {base} b ON b.ticker = e.ticker AND b.rn = e.rn + 1)"""
