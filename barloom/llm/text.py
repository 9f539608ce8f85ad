"""Column expressions and row identity shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def whole(text: Column | str) -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of anything but the six ASCII space characters."""
    return F.array_remove(F.split(text, SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; it may then be used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running_total(values: Column, chunk: int = 64) -> Column:
    """Inclusive prefix sums of a bigint array. Two levels, so that long arrays cost a small multiple
    of their length."""

    def of(parts):
        sums = F.transform(parts, _total)
        return F.flatten(F.transform(parts, lambda part, k: let(
            _total(F.slice(sums, F.lit(1), k)),
            lambda base: F.transform(part, lambda _, i: base + _total(F.slice(part, F.lit(1), i + 1))),
        )))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int")),
        lambda k: F.slice(values, k * chunk + 1, F.lit(chunk)),
    )
    return F.when(F.size(values) > 0, let(parts, of)).otherwise(F.array().cast("array<bigint>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


# ---- row identity --------------------------------------------------------------------------------


def keys(text: str = "text") -> list[Column]:
    """doc_id and a fingerprint of the text. Rows with the same pair are repeats of one row: document
    ids are unique but for repeats, so that the fingerprint only tells apart rows that share an id."""
    return [F.col("doc_id"), F.xxhash64(whole(text)).alias("print")]


def apply_decisions(docs: DataFrame, decisions: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` with what was decided on their key, as columns (row, *decisions). Repeats of a
    row meet in one row first, so that no repeat multiplies another; ``decisions`` must have one row
    per (doc_id, print) and the text columns ``also``. Whatever columns ``docs`` has stay inside ``row``.

    The keys are plain, without nulls, so that the repeats and the join share one shuffle of the rows."""
    parts = {"k_print": "print", "k_id": F.coalesce("doc_id", F.lit(0)), "k_no_id": F.col("doc_id").isNull()}
    for n, c in enumerate(also):
        parts |= {f"k_{n}": F.coalesce(c, F.lit("")), f"k_no_{n}": F.col(c).isNull()}
    held = docs.select(
        *[(F.xxhash64(whole("text")) if name == "k_print" else part).alias(name) for name, part in parts.items()],
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).dropDuplicates(list(parts))
    named = decisions.withColumns({name: F.col(part) if name == "k_print" else part for name, part in parts.items()}).drop("doc_id", "print", *also)
    return held.join(named, list(parts)).drop(*parts)
