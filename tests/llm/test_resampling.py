"""Importance resampling against a plain loop, and odd inputs."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import resampling
from barloom.llm.catalog import LLM_QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, longest, buckets):
    words = WORD.findall((text or "").encode().lower().decode())
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    held = [(d, *buckets_of(t, longest, buckets)) for d, t in docs]
    s = collections.Counter(b for _, _, f in held for b in f)
    t = collections.Counter(b for text in target for b in buckets_of(text, longest, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, words, f in held:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], start=1)}
    return sorted(((r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_plain_loop(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{small_sf}/benchmark.parquet").collect()]
    found = rows_of(LLM_QUERIES["op13_resampling"][0](spark, small_sf))
    assert found == plain(docs, target)
    drawn = sum(r[4] is not None for r in found)
    assert drawn == sum(r[1] >= 20 for r in found) // 10 > 0


@pytest.mark.parametrize("longest", [2, 3])
def test_longer_runs(spark, longest):
    rows = [(1, "a b a b a b"), (2, "b a"), (3, ""), (4, "one"), (5, "a b c d e f g h " * 40), (6, "É é 12a, 12A")]
    docs, target = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, [(1, "a b c")]))
    found = rows_of(resampling.resample(docs, target, longest=longest, buckets=64, least_words=1, percent=50))
    assert found == plain(rows, ["a b c"], longest, 64, 1, 50)


def test_slices_give_the_same_features(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x y"] * 7 + ["z" * 50] + [""] * 3)], ["text"])
    parts = list(resampling.slices(batch, 10))
    assert sum(p.num_rows for p in parts) == 11 and max(p.num_rows for p in parts) <= 4


def test_odd_rows(spark):
    text = "word " * 30
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, ""), (4, "w " * 40_000), (5, "\x00 - !")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in ("weight", "rank", "print", "block", "place", "eligible")})
    empty = spark.createDataFrame([], "text string")
    assert rows_of(resampling.resample(docs, empty, percent=60)) == plain(rows, [], percent=60)
    assert resampling.resample(docs.limit(0), docs).count() == 0
    # equal scores: repeated rows are ranked apart, once each
    ranks = sorted(r["rank"] for r in resampling.resample(docs, empty, percent=100).collect() if r["rank"])
    assert ranks == [1, 2, 3, 4, 5]
