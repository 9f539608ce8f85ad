"""Date-order detection, date parsing and fiscal-quarter helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.contracts import Q4_LAG_DAYS, QUARTER_LAG_DAYS
from barloom.functions.numbers import bind

ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
PAIRS = r"^\d\d[/-]\d\d[/-]\d\d"
SHORT = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(text, pattern, index).try_cast("int")


def order_votes(text: Column) -> Column:
    """What one date text says about its file: a struct of three 0/1 votes. Pairs of digits are compared as texts."""
    text = F.trim(text)
    iso, pairs = text.rlike(ISO), text.rlike(PAIRS)

    def beyond(place: int) -> Column:
        return F.when(pairs, F.substring(text, 3 * place - 2, 2) > "12").otherwise(~iso & (_group(text, SHORT, place) > 12))

    return F.struct(
        F.coalesce(iso, F.lit(False)).cast("int").alias("iso"),
        F.coalesce(beyond(1), F.lit(False)).cast("int").alias("first"),
        F.coalesce(beyond(2), F.lit(False)).cast("int").alias("second"),
    )


def order_from_votes(iso: Column, first: Column, second: Column) -> Column:
    return (
        F.when((iso > first) & (iso > second), "iso")
        .when(second > first, "monthfirst")
        .otherwise("dayfirst")
    )


def _civil(year: Column, month: Column, day: Column) -> Column:
    full_year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", full_year, month, day), "yyyy-MM-dd")


def parse_date(text: Column, order: Column) -> Column:
    """Date under the file's detected order; ISO texts are read as such under any order. The two usual
    shapes are read at once."""
    t = F.trim(text)
    one, two, year = F.substring(t, 1, 2), F.substring(t, 4, 2), F.substring(t, 7, 4)
    turned = F.when(order == "dayfirst", F.concat_ws("-", year, two, one)).otherwise(F.concat_ws("-", year, one, two))
    return (
        F.when(t.rlike(r"^[1-9]\d{3}-\d{2}-\d{2}$"), t.try_cast("date"))
        .when(t.rlike(r"^\d{2}[/-]\d{2}[/-][1-9]\d{3}$"), turned.try_cast("date"))
        .otherwise(_parse_any_date(text, order))
    )


def _parse_any_date(text: Column, order: Column) -> Column:

    def read(t: Column) -> Column:
        one, two, year = (_group(t, SHORT, i) for i in (1, 2, 3))
        day_first = order == "dayfirst"
        month, day = F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two)
        iso = _civil(*(_group(t, ISO, i) for i in (1, 2, 3)))
        return F.when(t.rlike(ISO), iso).when(t.rlike(SHORT), _civil(year, month, day))

    return bind(F.trim(text), read)


# ---- dates of vendors, in whatever shape ---------------------------------------------------------

# fixed values
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CLOCK = r"(?:T| +)\d{1,2}:\d{2}.*$"
ANY_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
NAMED_FIRST = r"^([a-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})$"
NAMED_SECOND = r"^(\d{1,2})[- ]([a-z]{3})[a-z]*\.?[- ](\d{4})$"
EPOCH = r"^\d{9,10}(?:\d{3})?$"


def _day_text(text: Column) -> Column:
    """Without the time of day, in small letters."""
    return F.lower(F.regexp_replace(F.trim(text), CLOCK, ""))


def numeric_votes(text: Column) -> tuple[Column, Column]:
    """Whether the first, or the second, number of a text such as 16/06/2026 can only be a day."""
    t = _day_text(text)
    return tuple(F.coalesce(_group(t, NUMERIC, i) > 12, F.lit(False)) for i in (1, 2))


def vendor_date(text: Column, day_first: Column) -> Column:
    """Date of a text in any of the shapes above; ``day_first`` decides about two numbers and a year. Seconds and milliseconds
    since 1970 are read in UTC. Null if no shape fits or there is no such day."""

    def parts(t: Column) -> Column:
        def group(pattern, year, month, day):
            return F.struct(*[_group(t, pattern, i).alias(n) for n, i in (("year", year), ("month", month), ("day", day))])

        def named(pattern, year, month, day):
            number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(t, pattern, month)).cast("int")
            return F.struct(_group(t, pattern, year).alias("year"), number.alias("month"), _group(t, pattern, day).alias("day"))

        return (
            F.when(t.rlike(ANY_ISO), group(ANY_ISO, 1, 2, 3))
            .when(t.rlike(COMPACT), group(COMPACT, 1, 2, 3))
            .when(t.rlike(NUMERIC) & day_first, group(NUMERIC, 3, 2, 1))
            .when(t.rlike(NUMERIC), group(NUMERIC, 3, 1, 2))
            .when(t.rlike(NAMED_FIRST), named(NAMED_FIRST, 3, 1, 2))
            .when(t.rlike(NAMED_SECOND), named(NAMED_SECOND, 3, 2, 1))
        )

    def read(t: Column) -> Column:
        unit = F.when(F.length(t) > 10, 86_400_000).otherwise(86_400)
        since = F.date_from_unix_date(F.floor(t.try_cast("bigint") / unit).cast("int"))
        civil = bind(parts(t), lambda p: _civil(p["year"], p["month"], p["day"]))
        return F.when(t.rlike(EPOCH), since).otherwise(civil)

    return bind(_day_text(text), read)


PERIOD_Q_FIRST = r"Q([1-4])\s*[/\-_ ]?\s*(\d{4})"
PERIOD_YEAR_FIRST = r"(\d{4})\s*[/\-_ ]?\s*Q([1-4])"


def parse_period(text: Column) -> Column:
    """'Q1 2024', '2024-Q1', ... as struct(year, quarter); null when the text is no period."""

    def read(label: Column) -> Column:
        q_first = label.rlike(PERIOD_Q_FIRST)
        year = F.when(q_first, _group(label, PERIOD_Q_FIRST, 2)).otherwise(_group(label, PERIOD_YEAR_FIRST, 1))
        quarter = F.when(q_first, _group(label, PERIOD_Q_FIRST, 1)).otherwise(_group(label, PERIOD_YEAR_FIRST, 2))
        return F.when(
            q_first | label.rlike(PERIOD_YEAR_FIRST), F.struct(year.alias("year"), quarter.alias("quarter"))
        )

    return bind(F.upper(F.regexp_replace(F.trim(text), r"\s+", " ")), read)


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def effective_date(
    end: Column, quarter: Column, lag_days: int = QUARTER_LAG_DAYS, q4_lag_days: int = Q4_LAG_DAYS
) -> Column:
    """First day a quarter's statement counts as published."""
    return F.date_add(end, F.when(quarter == 4, q4_lag_days).otherwise(lag_days))
