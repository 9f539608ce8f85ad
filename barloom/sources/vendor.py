"""Landed vendor payloads, market-cap, book-equity and valuation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.dates import numeric_votes, vendor_date
from barloom.functions.numbers import finite, to_double
from barloom.operators.perfile import with_group
from barloom.session import written
from barloom.sources.bars import keep_last

# fixed values: where a payload keeps its rows, and the field names vendors use
LIST_PATHS = ["$", "$.data", "$.items", "$.result", "$.prices", "$.data.items", "$.data.result", "$.data.prices"]
FIELDS = {
    "Open": ["open", "Open"],
    "High": ["high", "High"],
    "Low": ["low", "Low"],
    "Close": ["close", "Close"],
    "Volume": ["volume", "Volume"],
    "MarketCap": ["marketCap", "market_cap", "marketCapitalization", "MarketCap"],
}
DATE_FIELDS = ["date", "Date"]


def extract_records(payloads: DataFrame) -> DataFrame:
    """(symbol, body) to one row per record of the payload's list, as a text map with its position.

    Payloads without a list in a known place give no rows; ``unreadable_payloads`` finds them."""
    found = F.coalesce(*[_list_text(p) for p in LIST_PATHS])
    records = F.from_json(found, "array<map<string,string>>")
    return payloads.select("*", F.posexplode(records).alias("pos", "record")).drop("body")


def _list_text(path: str) -> Column:
    text = F.trim(F.col("body")) if path == "$" else F.get_json_object("body", path)
    return F.when(F.startswith(text, F.lit("[")), text)


def unreadable_payloads(payloads: DataFrame) -> DataFrame:
    return payloads.where(F.coalesce(*[_list_text(p) for p in LIST_PATHS]).isNull())


def _field(names: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at("record", F.lit(n)) for n in names])


def dated_records(payloads: DataFrame) -> DataFrame:
    """(Symbol, date_text, fields, ordinal, Date) of all records. A symbol's dates say by vote whether 3/4/2026 begins with the day; a
    symbol without a telling date begins with the month. ``Date`` is null where no shape reads the text."""
    records = written(extract_records(payloads).select(
        F.col("symbol").alias("Symbol"), _field(DATE_FIELDS).alias("date_text"),
        *[to_double(_field(names)).alias(out) for out, names in FIELDS.items()],
        F.struct("fetched_at", "pos").alias("ordinal"),
    ), "records")
    first, second = numeric_votes(F.col("date_text"))
    symbols = records.groupBy("Symbol").agg(F.count_if(first).alias("first"), F.count_if(second).alias("second"), F.count("*").alias("n"))
    symbols = written(symbols.select("Symbol", "n", (F.col("first") > F.col("second")).alias("day_first")), "symbols")
    told = with_group(records, symbols, "Symbol", "ordinal")
    return told.withColumn("Date", vendor_date(F.col("date_text"), F.col("day_first"))).drop("day_first")


def standardize_prices(payloads: DataFrame, vendor: str) -> DataFrame:
    """Payloads (symbol, fetched_at, body) to price history, one row per symbol and date; the last
    record of the latest payload wins. ``unreadable_dates`` has the records without a date."""
    rows = dated_records(payloads).where("Date IS NOT NULL").drop("date_text")
    return keep_last(rows, ["Date", "Symbol"], "ordinal").select(
        "Date", "Symbol", *FIELDS, (F.col("MarketCap") / 1e9).alias("MarketCap_TyDong"),
        F.lit(vendor).alias("Vendor"),
    )


def unreadable_dates(payloads: DataFrame) -> DataFrame:
    """(Symbol, fetched_at, pos, date_text) of the records whose date no shape reads, or that have none."""
    bad = dated_records(payloads).where("Date IS NULL")
    return bad.select("Symbol", "ordinal.fetched_at", "ordinal.pos", "date_text")


def scan_market_cap(df: DataFrame, ordinal: str, default_symbol: str | None = None) -> DataFrame:
    """(date, ticker, close, market_cap) from a table under any of the vendor field names; of several rows of a day the
    one with the highest ``ordinal``."""
    by_name = {c.strip(): c for c in df.columns}

    def pick(names: list[str], required: bool) -> Column | None:
        found = [F.col(by_name[n]) for n in names if n in by_name]
        if not found and required:
            raise ValueError(f"none of the columns {names} is present")
        return F.coalesce(*found) if found else None

    close = pick(FIELDS["Close"], False)
    symbol = pick(["symbol", "Symbol", "ticker"], default_symbol is None)
    rows = df.select(
        pick(DATE_FIELDS, True).cast("date").alias("date"),
        F.upper(symbol if symbol is not None else F.lit(default_symbol)).alias("ticker"),
        (close if close is not None else F.lit(None)).cast("double").alias("close"),
        finite(pick(FIELDS["MarketCap"], True).cast("double")).alias("market_cap"),
        F.col(ordinal).alias("__o"),
    ).where("date IS NOT NULL")
    return keep_last(rows, ["date", "ticker"], "__o").drop("__o")


def market_cap_check(market_cap: DataFrame, smallest: float = 1e9) -> DataFrame:
    """Per ticker: median market cap, flagged when it looks as if it were already in billions."""
    return market_cap.groupBy("ticker").agg(F.median("market_cap").alias("median_market_cap")).withColumn(
        "status", F.when(F.col("median_market_cap") < smallest, "review").otherwise("ok")
    )


BOOK_REQUIRED = [
    "ticker", "calendar_year", "calendar_quarter", "quarter_end_date", "effective_date", "book_equity_parent",
]


def scan_book_equity(df: DataFrame, ordinal: str = "quarter_end_date") -> DataFrame:
    """Book equity with all required columns, one row per ticker and effective date."""
    have = {c.strip().lower(): c for c in df.columns}
    missing = [c for c in BOOK_REQUIRED if c not in have]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    optional = [c for c in ("period_label", "book_equity_total", "non_controlling_interest") if c in have]
    rows = df.select(
        F.upper(have["ticker"]).alias("ticker"),
        *[F.col(have[c]).alias(c) for c in BOOK_REQUIRED[1:] + optional],
    ).where("effective_date IS NOT NULL AND book_equity_parent IS NOT NULL")
    return keep_last(rows, ["ticker", "effective_date"], ordinal)


def scan_valuation(df: DataFrame, columns: list[str], ordinal: str) -> DataFrame:
    """Valuation features found in the table, numeric, one row per ticker and date, the one with the highest ``ordinal``."""
    names = {c.strip().lower(): c for c in df.columns}
    present = [c for c in columns if c.lower() in names]
    rows = df.select(
        F.col(names["ticker"]).alias("ticker"),
        F.col(names["date"]).cast("date").alias("date"),
        *[finite(F.col(names[c.lower()]).cast("double")).alias(c) for c in present],
        F.col(ordinal).alias("__o"),
    ).where("date IS NOT NULL")
    return keep_last(rows, ["ticker", "date"], "__o").drop("__o")
