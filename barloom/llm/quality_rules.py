"""Quality rules: a threshold table compiled into one projection.

A rule compares a ratio of two counts with a bound. Counts are integers and a rule is checked as
``scale * numerator > bound * denominator``, so that results are exact. The table is data: pass another
one to ``judge``. Everything is a map over documents with built-in functions; nothing is shuffled, and a
document's working memory is a small multiple of its text.

Null texts count as empty; empty texts fail the base rule (fewer than 20 words). Repeated rows give
repeated results, empty tables empty ones. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import SPACE, ascii_lower, let, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: the commonest function words of English, French, German and Spanish
STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the this to was were will with "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour qui que sur un une "
    "als am auf das dem den der die ein eine im ist mit nicht sich sie und von zu "
    "al con del el ella es esta las lo los no para por se su y"
).split()
LONGEST_STOP_WORD = max(map(len, STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """Broken if ``scale * top`` is over (or under) ``bound * bottom``."""

    name: str
    top: str
    bottom: str
    scale: int
    bound: int
    over: bool = True

    def text(self) -> str:
        return f"{self.scale} * {self.top} {'>' if self.over else '<'} {self.bound} * {self.bottom}"


RULES = (
    Rule("short_words", "word_chars", "n_words", 1, 2, over=False),
    Rule("long_words", "word_chars", "n_words", 1, 15),
    Rule("symbols", "n_symbols", "n_words", 100, 20),
    Rule("few_stop_words", "n_stop_words", "n_words", 100, 4, over=False),
    Rule("shouting", "n_upper_words", "n_words", 100, 50),
    Rule("exclamations", "n_exclamations", "n_words", 100, 30),
    Rule("no_letters", "n_letter_words", "n_words", 100, 70, over=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, 50),
    Rule("long_lines", "n_words", "n_lines", 1, 20000),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_stop_words", "n_upper_words", "n_letter_words", "n_exclamations", "n_lines")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words, a power of two, that are found twice or more in the text."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts) - 1), F.slice(starts, F.lit(1), F.size(starts) - 1), lambda a, b: a - b)
        return F.aggregate(gaps, F.lit(window), lambda n, gap: n + F.least(gap, F.lit(window)))

    def starts(seen: Column) -> Column:
        # by (window, place): a window is repeated if a neighbour is the same
        def repeated(x, i):
            before = F.when(i > 0, F.element_at(seen, i)["h"] == x["h"])
            after = F.when(i < F.size(seen) - 1, F.element_at(seen, i + 2)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.array_sort(F.transform(F.filter(seen, repeated), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        seen = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat no window and skip the sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(seen, starts), covered))

    def wider(step: int):
        # a window's hash from those of its two halves, so that a word is hashed once; beyond the end, of one alone
        return lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    for power in range(window.bit_length() - 1):
        hashes = let(hashes, wider(2**power))
    hashes = F.slice(hashes, F.lit(1), F.size(tokens) - window + 1)
    return F.when(F.size(tokens) >= window, let(hashes, count)).otherwise(F.lit(0)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and all counts. Words and lines are split once, in a projection below the counts."""
    split = docs.select(F.col("doc_id"), whole("text").alias("body")).select(
        "doc_id", "body", words(F.col("body")).alias("tokens"),
        F.filter(F.split("body", "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "").alias("lines"),
    )
    tokens, lines, body = F.col("tokens"), F.col("lines"), F.col("body")
    count = lambda condition: F.size(F.filter(tokens, condition)).cast("long")
    return split.select(
        "doc_id",
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(tokens).alias("n_repeat_words"),
        count(lambda w: (F.length(w) <= LONGEST_STOP_WORD) & ascii_lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
        count(lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))).alias("n_upper_words"),
        count(lambda w: F.upper(w) != F.lower(w)).alias("n_letter_words"),
        (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long").alias("n_exclamations"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, broken (names of broken rules), kept."""
    base_failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    broken = F.array_compact(F.array(*[F.when(F.expr(r.text()), F.lit(r.name)) for r in rules]))
    return counted(docs).withColumn("base_failed", base_failed).withColumn("broken", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0)
    )


STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) y WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) r(k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::bigint AS n_words,
    len(regexp_replace(body, '{SPACE}', '', 'g'))::bigint AS word_chars,
    (len(body) - len(translate(body, '{SYMBOLS}', '')))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
    coalesce(rep.n, 0)::bigint AS n_repeat_words,
    len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({STOP_LIST})))::bigint AS n_stop_words,
    len(list_filter(w, lambda x: len(x) > 1 AND x = upper(x) AND x <> lower(x)))::bigint AS n_upper_words,
    len(list_filter(w, lambda x: upper(x) <> lower(x)))::bigint AS n_letter_words,
    (len(body) - len(translate(body, '!', '')))::bigint AS n_exclamations,
    len(lines)::bigint AS n_lines
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  concat_ws(',', {', '.join(f"CASE WHEN {r.text()} THEN '{r.name}' END" for r in RULES)}) AS broken FROM c)
SELECT *, NOT base_failed AND broken = '' AS kept FROM j
"""
