"""Spelling variants against brute force, and odd inputs."""

import collections
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from barloom.llm import spelling
from barloom.llm.catalog import LLM_QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows, damage):
    n = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts, near_of, ratio=5):
    form = {}
    for w, n in counts.items():
        if near_of[w]:
            best = min(near_of[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near_of[w]), counts.get(form.get(w))) for w, n in counts.items()}


def rows_of(df):
    return {tuple(r) for r in df.select(*COLUMNS).collect()}


def all_near(counts):
    near = {w: set() for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    return near


def test_query_equals_brute_force(spark, small_sf):
    docs = spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id", "text").collect()
    counts = counted(docs, spelling.DAMAGE)
    assert len(counts) > 500
    found = LLM_QUERIES["op11_spelling_variants"][0](spark, small_sf)
    assert rows_of(found) == brute(counts, all_near(counts)) and found.count() == len(counts)


def test_variants_of_random_words(spark):
    # short words over a small alphabet: runs of equal letters, many neighbours, ties, chains
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(400)}
    counts = {w: rng.choice([1, 5, 5, 25, 125, 625]) for w in sorted(words)}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    expected = brute(counts, all_near(counts))
    assert rows_of(found) == expected
    assert any(root != form for _, form, root, *_ in expected if form)  # a chain


def test_long_words_chains_and_ties(spark):
    long = "xy" * 3000
    counts = {long: 500, long[:-1]: 20, long + "z": 2, "aaaaaa": 7, "aaaaaaa": 7, "aaaaab": 7}
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found[long[:-1]]["form"] == long and found[long + "z"]["form"] == long and found[long]["n_near"] == 2
    # a letter of a run may be dropped anywhere, the neighbour counts once; ratio 1 is not enough
    assert found["aaaaaaa"]["n_near"] == 1 and found["aaaaaa"]["n_near"] == 2 and found["aaaaaa"]["form"] is None
    even = {r["word"]: r["form"] for r in spelling.variants(
        spark.createDataFrame([("worde", 10), ("worda", 10), ("word", 2)], "word string, n long")).collect()}
    assert even["word"] == "worda"


def test_odd_rows(spark):
    rows = [(1, "Straße STRASSE " * 5), (1, "Straße STRASSE " * 5), (None, None), (None, "kürzer " * 5), (4, ""), (5, "short " * 9), (6, "ab" * 30_000 + " ") ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("word", "id", "n", "key", "root")})
    found = {r["word"]: r["n"] for r in spelling.spelling_variants(docs).collect()}
    assert found == {"straße": 10, "strasse": 10, "kürzer": 5}
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    counts = counted(rows, 2)
    assert rows_of(spelling.spelling_variants(docs, damage=2)) == brute(counts, all_near(counts))
