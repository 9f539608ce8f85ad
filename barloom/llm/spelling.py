"""Spelling variants of one word, found through sorted permuterm rotations.

A word of L characters, marked with a terminator, has L + 1 rotations. Two words that differ by a replaced
character have rotations that agree in all but their last character, the edited one. A word that lacks a
character of another has a whole rotation that equals such a rotation of the longer word without its last
character. So each rotation is posted twice, whole and with its last character skipped; sorted, the words
of a prefix range stand together, and one scan over a range tells every word how many neighbours it
has there and which is the most frequent. A character may be dropped from any place of a run of equal
ones with the same result, so that only the first place of a run counts for deletions: every neighbour is
met exactly once.

Words carry their place in the order (n falling, word rising), so that the best neighbour is the least place.

How it scales: runs are counted inside each Arrow batch before the shuffle. A word posts 2 L + 1 short rows. A
range holds at most one word per character of the alphabet and one whole rotation, and no pairs are made:
neighbours are counted and the best one is passed on. Keys of more than ``LONGEST`` bytes are posted as
digests, so that a very long word costs no more room per posting than others. Chains of forms are
followed by doubling; every step up multiplies n by ``ratio`` at least, so there are few rounds.

Null and empty texts have no words. Rows are counted one by one, repeated ones too; a null doc_id counts as an
empty one where the id decides about damage. Ties of n go to the smaller word in code-point order. Very long
texts are read whole, very long words are words like others. Empty tables give empty results. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.ship import by_value
from barloom.llm.text import whole
from barloom.session import written

by_value(__name__)

#: letters of words after A-Z were lower-cased
LETTERS = "a-zÀ-ÿ"
SHORTEST, FEWEST, RATIO, DAMAGE = 6, 5, 5, 199
END = "\u0000"
LONGEST = 64
#: distinct words held by a task before it passes their counts on
HELD = 200_000


def counter(shortest: int, damage: int | None):
    """Batches (id, body) to partial counts (word, n)."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def counted(batches):
        held: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
            )

        for rows in batches:
            for doc, body in zip(rows.column("id").to_pylist(), rows.column("body").to_pylist()):
                found = Counter(runs.findall(body.lower().decode("utf-8", "replace")))  # bytes: A-Z only
                if damage:
                    start = zlib.crc32(f"{doc}:".encode())
                    for run in found:
                        h = zlib.crc32(run.encode(), start)
                        if h % damage == 0:
                            at = h % len(run)
                            if len(run) > shortest:
                                held[run[:at] + run[at + 1 :]] += found[run]
                            found[run] = 0
                held.update(found)
                if len(held) > HELD:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return counted


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, damage: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of at least ``shortest`` characters and ``fewest``
    occurrences. With ``damage`` a run loses one character wherever the number divides the CRC of
    ``<doc_id>:<run>``, which plants misspellings."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), whole("text").cast("binary").alias("body"))
    parts = rows.mapInArrow(counter(shortest, damage), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def rotations(words: DataFrame) -> DataFrame:
    """(key, id, whole, first): every rotation of ``word`` and its terminator, whole and without its last
    character; ``first`` where that character does not repeat the one before it in the word."""
    each = words.select("id", "word", F.explode(F.sequence(F.lit(0), 2 * F.length("word"))).alias("k"))
    at, whole_one = F.ceil(F.col("k") / 2).cast("int"), F.col("k") % 2 == 0
    key = F.concat(
        F.expr("substr(word, at + 1)"), F.lit(END), F.expr("substr(word, 1, if(whole, at, at - 1))")
    )
    first = ~F.col("whole") & ((F.col("at") == 1) | F.expr("substr(word, at, 1) <> substr(word, at - 1, 1)"))
    return each.select("id", "word", at.alias("at"), whole_one.alias("whole")).select(
        F.when(F.octet_length(key) > LONGEST, F.md5(key.cast("binary"))).otherwise(key).alias("key"), "id", "whole", first.alias("first")
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with a neighbour their number and the one of least id."""
    order = Window.partitionBy("key").orderBy("whole", "id")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = rotations(words).select(
        "id", "whole", "first",
        F.sum((~F.col("whole")).cast("long")).over(group).alias("skipped"),
        F.sum(F.col("first").cast("long")).over(group).alias("firsts"),
        F.first("id").over(group).alias("least"),
        F.min(F.when(F.col("first"), F.col("id"))).over(group).alias("least_first"),
        F.when(F.last("whole").over(group), F.last("id").over(group)).alias("shorter"),
        F.when(~F.lead("whole").over(order), F.lead("id").over(order)).alias("next"),
    )
    replaced = F.when(F.col("id") != F.col("least"), F.col("least")).otherwise(F.col("next"))
    deleted = F.when(F.col("first"), F.col("shorter"))
    found = scanned.select(
        "id",
        F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("skipped") - 1 + deleted.isNotNull().cast("long")).alias("met"),
        F.when(F.col("whole"), F.col("least_first")).otherwise(F.least(replaced, deleted)).alias("best"),
    ).where("met > 0")
    return found.groupBy("id").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the end of every chain of forms."""
    chains = written(links.select("id", F.col("form").alias("root")), "forms")
    while True:
        ahead = chains.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = written(chains.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), "further"), "forms")
        if moved.where("further is not null").isEmpty():
            return chains
        chains = moved.drop("further")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of (word, n), one row per word: word, form (its near word of largest n, if that is at least ``ratio`` times the
    word's, else null), root (the last of the forms that follow, the word itself if none), n, n_near, form_n."""
    words = written(
        counts.select("word", "n").orderBy(F.col("n").desc(), "word").withColumn("id", F.monotonically_increasing_id()), "words"
    )
    met = written(neighbours(words), "neighbours")
    form = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    formed = words.join(met, "id").join(form, "best").where(F.col("form_n") >= ratio * F.col("n")).select("id", "best", "form", "form_n")
    formed = written(formed, "formed")
    root = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    roots = last_forms(formed.select("id", F.col("best").alias("form"))).withColumnRenamed("root", "root_id").join(root, "root_id").drop("root_id")
    return words.join(met.select("id", "n_near"), "id", "left").join(formed.drop("best").join(roots, "id"), "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame, damage: int | None = None, **options) -> DataFrame:
    """``variants`` of the words of all documents."""
    return variants(word_counts(docs, damage=damage, **options))
