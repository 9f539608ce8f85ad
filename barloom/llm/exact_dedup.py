"""Exact deduplication by deterministic block naming.

The normalised text (A-Z lower-cased) is cut into blocks of fixed size. Distinct blocks are sorted and
get integer names; adjacent names are paired and the distinct pairs named in turn, until every document
has one name. Two documents of the same block count have the same name exactly if their texts are
equal: names come from comparing contents, never from hashing them, so there are no collisions.

How it scales: contents move twice (once to find the distinct blocks, after a map-side combine, once to
look names up), every later level moves three integers per pair, and there are log2(blocks of the longest
text) levels. A name is the position in a sorted partition, so no task sees all names. A block with a
third of all rows is combined before it is shuffled, and the rows of frequent contents, found by counting hashes, look
their names up in a broadcast table of fewer than ``HEAVY`` rows instead of meeting in one task.

Null texts count as empty. Rows repeated with id and text are kept apart by a count and all come out.
Among equal texts the largest doc_id stays; null ids never stay beside others. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import apply_decisions, ascii_lower, whole
from barloom.operators.perfile import with_group
from barloom.session import written

BLOCK_BYTES = 4096
HEAVY = 256


def block_rows(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, print, sha, width, pos, block): ``width`` blocks, one for an empty text."""
    body = docs.select(
        F.col("doc_id"), F.xxhash64(whole("text")).alias("print"), ascii_lower(whole("text")).cast("binary").alias("body")
    ).select(
        "doc_id", "print", "body", F.unhex(F.sha2("body", 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("long").alias("width"),
    )
    return body.select(
        "doc_id", "print", "sha", "width", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("pos")
    ).select(
        "doc_id", "print", "sha", "width", "pos",
        F.substring("body", (F.col("pos") * block_bytes + 1).cast("int"), block_bytes).alias("block"),
    )


def frequent(rows: DataFrame, contents: list[str]) -> list[int]:
    """Hashes of the contents that more than one row in ``HEAVY`` has; fewer than ``HEAVY``, whatever the table."""
    counts = written(rows.groupBy(F.xxhash64(*contents).alias("hash")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r["hash"] for r in counts.where(F.col("n") * HEAVY > F.lit(total)).collect()]


def with_names(rows: DataFrame, contents: list[str]) -> DataFrame:
    """The rows with an integer name in place of their contents, the same for the same contents. Frequent contents get theirs
    without moving their rows to one place; their names are odd, those of others even."""
    names = (
        rows.select(*contents).distinct().sortWithinPartitions(*contents)
        .withColumn("name", F.monotonically_increasing_id() * 2)
    )
    often = frequent(rows, contents)
    if not often:
        return rows.join(names, contents).drop(*contents)
    hot = F.xxhash64(*contents).isin(often)
    few = names.where(hot).withColumn("name", F.col("name") + 1)  # fewer than HEAVY rows but for hash collisions
    return rows.where(~hot).join(names, contents).unionByName(rows.where(hot).join(F.broadcast(few), contents)).drop(*contents)


def document_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, print, sha, n_blocks, name."""
    level = block_rows(docs, block_bytes).withColumn("n_blocks", F.col("width")).withColumn("copies", F.lit(1).cast("long"))
    level = written(with_names(level, ["block"]), "names-0")
    done = [level.where("width = 1")]
    left = level.agg(F.max("width")).first()[0] or 1
    depth = 0
    while left > 1:
        left, depth = (left + 1) // 2, depth + 1
        even = F.col("pos") % 2 == 0
        pairs = level.where("width > 1").groupBy(
            "doc_id", "print", "sha", "n_blocks", F.ceil(F.col("width") / 2).alias("width"), F.floor(F.col("pos") / 2).alias("pos")
        ).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
            F.sum(F.when(even, F.col("copies")).otherwise(0)).alias("copies"),
        )
        level = written(with_names(pairs, ["left", "right"]), f"names-{depth}")
        done.append(level.where("width = 1"))
    columns = ["doc_id", "print", "sha", "n_blocks", "name", "copies"]
    named = done[0].select(*columns)
    for part in done[1:]:
        named = named.unionByName(part.select(*columns))
    # a row that was repeated comes out as often as it went in
    return named.select(*columns[:-1], F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, print."""
    named = document_names(docs, block_bytes)
    named = named.withColumn("group", F.concat_ws(":", "n_blocks", "name"))
    groups = written(
        named.groupBy("group").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("n")), "groups")
    return with_group(named, groups, "group", "doc_id").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "print",
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay, with all their columns; of a repeated row one."""
    kept = exact_duplicates(docs, block_bytes).where("kept").select("doc_id", "print").distinct()
    return apply_decisions(docs, kept).select("row.*")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
      FROM documents) d
WINDOW g AS (PARTITION BY body)
"""
