"""Text to number, as column expressions (no UDF), in the three dialects vendors need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_SIGNS = r"[\u2212\u2013\u2014]"
BRACKETED = r"^\((.*)\)$"
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def to_double(text: Column) -> Column:
    """Plain decimal text to double; anything else, including words such as nan, - and null, is null."""
    return F.regexp_extract(text, PLAIN_NUMBER, 0).try_cast("double")


def finite(value: Column) -> Column:
    """NaN and infinities to null. Spark orders NaN above every number, so none may enter a frame."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def suffix_scale(text: Column) -> Column:
    last = F.upper(F.substring(text, -1, 1))
    return F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9)


def decimal_point(text: Column) -> Column:
    """Settle thousands and decimal marks in a text of digits, commas and dots."""
    comma_last = F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1))
    european = F.translate(F.translate(text, ".", ""), ",", ".")
    american = F.translate(text, ",", "")
    grouped_commas = text.rlike(r"^[0-9]*(,[0-9]{3})+$")
    grouped_dots = text.rlike(r"^[0-9]*(\.[0-9]{3}){2,}$")
    has_comma, has_dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    return (
        F.when(has_comma & has_dot, F.when(comma_last, european).otherwise(american))
        .when(has_comma, F.when(grouped_commas, american).otherwise(F.translate(text, ",", ".")))
        .when(grouped_dots, F.translate(text, ".", ""))
        .otherwise(text)
    )


def _market(raw: Column) -> Column:
    """Texts that need no settling are read at once; the others go through every rule."""
    number = lambda t: t.try_cast("double")
    return (
        F.when(raw.isNull(), F.lit(None).cast("double"))
        .when(raw.rlike(r"^-?[0-9]++(?:\.[0-9]+|,(?:[0-9]{1,2}|[0-9]{4,}))?$"), number(F.replace(raw, F.lit(","), F.lit("."))))
        .when(raw.rlike(r"^-?[0-9]++(?:\.[0-9]++)?[KMB]$"), number(F.left(raw, F.length(raw) - 1)) * suffix_scale(raw))
        .when(~raw.rlike("[0-9]"), F.lit(None).cast("double"))
        .otherwise(_market_rules(raw))
    )


def _market_rules(raw: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(raw, r"[\s\u00a0]", ""), MINUS_SIGNS, "-")

    def signed(t: Column) -> Column:
        core = F.translate(F.regexp_replace(F.regexp_replace(t, BRACKETED, "$1"), "^-", ""), "%", "")
        value = bind(core, unsigned) / F.when(F.contains(t, F.lit("%")), 100.0).otherwise(1.0)
        return F.when(t.rlike(r"^-|^\(.*\)$"), -value).otherwise(value)

    def unsigned(t: Column) -> Column:
        digits = F.regexp_replace(t, r"[^0-9,.]", "")
        return to_double(bind(digits, decimal_point)) * F.coalesce(suffix_scale(t), F.lit(1.0))

    return bind(text, signed)


def _loader(raw: Column) -> Column:
    def scaled(t: Column) -> Column:
        scale = F.coalesce(suffix_scale(t), F.lit(1.0))
        # the suffix comes off first, so a percent sign may only stand before it or without it
        number = F.translate(F.regexp_replace(t, "[KMBkmb]$", ""), "%", "")
        return to_double(number) * F.when(F.contains(t, F.lit("%")), scale / 100).otherwise(scale)

    return bind(F.translate(_strip(raw), " ,", ""), scaled)


def _statement(raw: Column) -> Column:
    def signed(t: Column) -> Column:
        value = to_double(F.translate(F.regexp_replace(t, BRACKETED, "$1"), ", ", ""))
        return F.when(t.rlike(BRACKETED), -value).otherwise(value)

    return bind(_strip(raw), signed)


DIALECTS = {"market": _market, "loader": _loader, "statement": _statement}


def parse_number(text: Column | str, dialect: str = "market") -> Column:
    """``market``: locale marks, percent, K/M/B, signs. ``loader``: comma is always thousands.
    ``statement``: comma thousands and bracketed negatives only."""
    return DIALECTS[dialect](F.col(text) if isinstance(text, str) else text)


def safe_float(text: Column | str) -> Column:
    """Report cells: percent text becomes a fraction, anything but a number is null."""

    def read(t: Column) -> Column:
        number = to_double(F.translate(t, "%,", ""))
        return F.when(F.endswith(t, F.lit("%")), number / 100).otherwise(number)

    return bind(_strip(F.col(text) if isinstance(text, str) else text), read)


def strict_bool(text: Column | str) -> Column:
    cell = F.col(text) if isinstance(text, str) else text
    word = F.lower(_strip(cell.cast("string")))
    return F.coalesce(word.isin("true", "1", "yes", "y"), F.lit(False))


def is_close(value: Column, expected, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|value - expected| <= atol + rtol * |expected|; null never matches."""
    other = expected if isinstance(expected, Column) else F.lit(float(expected))
    return F.coalesce(F.abs(value - other) <= atol + rtol * F.abs(other), F.lit(False))


def value_matches(value: Column, expected: float | None, tolerance: float = 1e-9) -> Column:
    """Absolute-tolerance match; ``None`` is a wildcard."""
    if expected is None:
        return F.lit(True)
    return F.coalesce(F.abs(value - F.lit(float(expected))) <= tolerance, F.lit(False))
