"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix ``rate`` = target / source size times. Documents of a
source stand in the order (size, doc_id); the expected copies are summed along that order, shifted by one
random offset per source, and a copy is emitted for each integer boundary that is crossed. Neighbours
have like sizes, so that the words taken stay within about one long document of the target.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
words; no target exceeds ``most`` times its source, and the excess goes to the others by weight until
none is above. That is one water level L with targets min(most * size, L * weight), found with running
sums over the sources.

How it scales: the order is a range partitioning over (source, size, doc_id), so that a source with most
rows is spread over many tasks; ranks are the position in a partition plus the rows of the source in
earlier partitions. Only narrow rows move. The per-source tables have one row per source.

Null texts and texts without words have size 0 and take part in the order without adding words. Repeated
rows are separate rows. The offset is a digest of the source name: reruns agree. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import apply_decisions, n_words, whole
from barloom.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: offsets are multiples of this, so that they add up exactly to large ranks
GRAIN = 65536


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate, start) from (source, source_size)."""
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.array(*[F.lit(w) for w in weights])[turn]
    weighed = sizes.withColumn("weight", weight).withColumn(
        "full_at", (most * F.col("source_size")).cast("double") / F.col("weight")
    )
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if exactly the sources before this one are full; the right one is the first that leaves this one unfilled
    level = (
        share * F.sum("source_size").over(everything).cast("double")
        - (most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).cast("double")
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).cast("double")
    levels = weighed.withColumn("level", level)
    found = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(everything)
    target = F.least((most * F.col("source_size")).cast("double"), found * F.col("weight"))
    start = F.when(
        F.col("source").isNull(), F.lit(0.5)
    ).otherwise(F.pmod(F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long"), F.lit(GRAIN)) / F.lit(float(GRAIN)))
    return levels.withColumn("found", found).select(
        "source", "source_size", F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"), start.alias("start")
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def ranked(rows: DataFrame) -> DataFrame:
    """The rows with ``rank``, 1, 2, ... within their source in the order (size, doc_id)."""
    dealt = written(
        rows.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"))
        .withColumn("block", F.spark_partition_id()),
        "mix-rows",
    )
    counts = dealt.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"),
        (F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("source", "block").orderBy("size", "doc_id"))
    return dealt.withColumn("local", local).join(
        before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))
    ).withColumn("rank", F.col("before") + F.col("local")).drop("b_source", "b_block", "before", "local", "block")


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, print, source, size, source_size, target, copies, taken."""
    rows = ranked(docs.select("doc_id", F.xxhash64(whole("text")).alias("print"), "source", n_words(whole("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "t_source")
    crossed = F.floor(F.col("start") + F.col("rate") * F.col("rank")) - F.floor(F.col("start") + F.col("rate") * (F.col("rank") - 1))
    return rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).withColumn(
        "copies", F.least(crossed, F.ceil("rate"))
    ).select(
        "doc_id", "print", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, print, size, source_size, target, copies, taken."""
    return planned(docs, **options).drop("source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with all its columns. Rows that share id and text
    but not the source are drawn for their own source."""
    drawn = planned(docs, **options).groupBy("doc_id", "print", "source").agg(F.sum("copies").alias("copies")).where("copies > 0")
    return apply_decisions(docs, drawn, ("source",)).select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    ).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, CAST(2 * source_size AS double) / weight AS full_at FROM s),
l AS (
  SELECT *, (1.5::double * CAST(sum(source_size) OVER () AS double) - CAST(2 * coalesce(sum(source_size) OVER w, 0) AS double))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS double) AS level
  FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
    coalesce(least(CAST(2 * source_size AS double), (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * weight),
      CAST(2 * source_size AS double)) AS target,
    CASE WHEN source IS NULL THEN 0.5::double
      ELSE (CAST('0x' || substr(md5(source), 1, 8) AS bigint) % 65536) / 65536.0::double END AS start
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(start + rate * rank) - floor(start + rate * (rank - 1)), ceil(rate)) * size AS bigint) AS taken,
  CAST(least(floor(start + rate * rank) - floor(start + rate * (rank - 1)), ceil(rate)) AS bigint) AS copies
FROM r
"""
