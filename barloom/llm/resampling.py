"""Importance resampling of documents towards a target distribution.

A document's features are its runs of consecutive words, hashed into buckets. A bucket's gain is the log
ratio, in thousandths and smoothed by one per bucket, of its share in the target texts to its share in the
documents; a document weighs the sum of its features' gains. Gumbel noise from a digest of the id turns
the largest scores into a sample without replacement in which a document's odds grow with its weight.

Arrow kernels do the text work: lower-casing, splitting at a pattern and flattening give one array of
words per slice of rows, dictionary encoding turns it into indices. A run of n words is the pair of
the index of its first n - 1 words and the index of its last one, from the same array shifted by one;
distinct pairs are numbered again and get their CRC from that of their first part. Gains are
taken by index and summed per document as segments.

How it scales: two maps over the texts, one for bucket counts and one for weights. A task holds one slice of at most
``SLICE`` bytes (or one longer text) and one count per bucket; counts leave a task once. The driver
holds one count and one gain per bucket, whose number is a parameter. Ranks come from a range partitioning
over the order of the draw (score falling, doc_id rising, digest of the text), not from one sorted task; the driver
learns only the number of rows per partition.

Null and empty texts have no features and weigh 0. A null doc_id draws its noise as an empty id and comes
last among ties. Repeated rows are rows of their own, in one order by all columns of the draw. Very long texts are read whole.
Empty documents give an empty result; an empty target is smoothed like any other. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.ship import by_value
from barloom.llm.text import whole
from barloom.session import written

by_value(__name__)

LONGEST_RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: what stands between words, in a lower-cased text
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 8 << 20


def slices(rows: pa.RecordBatch, size: int = SLICE):
    """The rows in parts of at most ``size`` bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(rows.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < rows.num_rows:
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield rows.slice(at, upto - at)
        at = upto


def crcs(words: pa.Array, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of every word, or of what ``before`` are the CRCs of, a space and the word."""
    if before is None:
        return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words))
    return np.fromiter((zlib.crc32(b" " + w, int(c)) for w, c in zip(words.to_pylist(), before)), np.int64, len(words))


def features(texts: pa.Array, longest: int, buckets: int):
    """Of a slice of texts, per run length: (row of each feature, rising; its bucket)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts).cast(pa.binary()), pattern=GAPS)
    words, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)  # a gap at either end leaves an empty word
    coded = pc.dictionary_encode(words.filter(real))
    row = rows.filter(real).to_numpy()
    index = coded.indices.to_numpy().astype(np.int64)
    crc = crcs(coded.dictionary)
    yield row, (crc % buckets)[index]
    run = index
    for n in range(2, longest + 1):
        together = row[n - 1 :] == row[: len(row) - n + 1]
        last = index[n - 1 :]
        # the runs one shorter, each with the word after it; places where a text ends stay in the arrays
        pairs, run = np.unique(run[: len(last)] * max(1, len(coded.dictionary)) + last, return_inverse=True)
        first, word = np.divmod(pairs, max(1, len(coded.dictionary)))
        crc = crcs(coded.dictionary.take(pa.array(word)), crc[first])
        yield row[: len(last)][together], (crc % buckets)[run][together]


def counter(longest: int, buckets: int):
    def counted(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch):
                for _, bucket in features(part.column("text"), longest, buckets):
                    counts += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["bucket", "n"])

    return counted


def weigher(gains: np.ndarray, longest: int):
    """Batches (doc_id, print, text) to (doc_id, print, n_words, n_features, weight)."""

    def weighed(batches):
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                words, total, weight = None, np.zeros(n, np.int64), np.zeros(n, np.int64)
                for row, bucket in features(part.column("text"), longest, len(gains)):
                    here = np.bincount(row, minlength=n)
                    words = here if words is None else words
                    total += here
                    some = np.flatnonzero(here)
                    if len(some):
                        starts = (np.cumsum(here) - here)[some]
                        weight[some] += np.add.reduceat(gains.take(bucket), starts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("print"), *(pa.array(x, pa.int64()) for x in (words, total, weight))],
                    ["doc_id", "print", "n_words", "n_features", "weight"],
                )

    return weighed


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts, per bucket."""
    rows = texts.select(whole("text").alias("text")).mapInArrow(counter(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    all_s, all_t, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (all_s + buckets) / ((float(s) + 1) * (all_t + buckets))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, print, n_words, n_features, weight) per document."""
    gains = gains_of(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole("text")).alias("print"), whole("text").alias("text"))
    return rows.mapInArrow(weigher(gains, longest), "doc_id long, print long, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise in thousandths from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank. ``rank`` counts the drawn ones, ``percent`` of the
    documents with at least ``least_words`` words, by score; others have none."""
    # written, because a range partitioning reads its rows twice
    scored = written(weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise(seed)), "weights")
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("print")]
    dealt = written(
        scored.withColumn("eligible", F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("block", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("block").cast("long"), 33) + 1),
        "scores",
    )
    before, seen, eligible = [], 0, 0
    for r in dealt.groupBy("block").agg(F.count("*").alias("n"), F.count_if("eligible").alias("able")).orderBy("block").collect():
        before.append((r["block"], seen))  # one row per partition
        seen, eligible = seen + r["n"], eligible + r["able"]
    starts = docs.sparkSession.createDataFrame(before, "block int, before long")
    rank = F.col("before") + F.col("place")
    drawn = rank <= F.lit(percent * eligible // 100)
    return dealt.join(F.broadcast(starts), "block").select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"))
