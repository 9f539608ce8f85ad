"""Registered queries: statement sheets, book equity, as-of valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, RETURNS, bars, cents, feature_frame, query, trades, units
from barloom.operators import statements as st
from barloom.operators.joins import asof_join
from barloom.operators.registry import VALUATION
from barloom.operators.valuation import build_valuation, merge_valuation, valuation_audit
from barloom.sources.vendor import scan_book_equity, scan_market_cap, scan_valuation

# ---- sheets: a title row, a header row, five accounts over the quarters of the data ---------------

def sheet_rows(spark, sf_dir):
    y, q = F.year("l_shipdate"), F.quarter("l_shipdate")
    quarters = trades(spark, sf_dir).groupBy(F.col("ticker").alias("sheet"), y.alias("y"), q.alias("q")).agg(
        F.sum(units()).alias("u")
    )
    # a calendar's worth of quarters per sheet
    sheets = quarters.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("y", "q", "u"))).alias("qs"))

    def line(first: str, cell):
        return F.concat(F.array(F.lit(first)), F.transform("qs", cell))

    def value(v):
        return v.cast("string")

    rows = [
        F.array(F.lit("BALANCE SHEET")),
        line("ITEMS", lambda s: F.concat(F.lit("Q"), value(s["q"]), F.lit(" "), value(s["y"]))),
        line("TOTAL ASSETS", lambda s: value(s["u"] * 3)),
        line("OWNER'S EQUITY", lambda s: value(s["u"])),
        line("Minority interests", lambda s: F.lit("0")),
        line("Minority Interest", lambda s: F.concat(F.lit("("), value(s["u"] % 97), F.lit(")"))),
        line("TOTAL RESOURCES", lambda s: value(s["u"] * 3)),
    ]
    return sheets.select("sheet", F.posexplode(F.array(*rows)).alias("row_idx", "cells"))


QUARTERS = """quarters AS (
  SELECT p_brand AS ticker, CAST(year(l_shipdate) AS int) AS y, CAST(quarter(l_shipdate) AS int) AS q,
    CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS u, sum(CAST(round(l_extendedprice*100) AS bigint)) AS cents
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
dated AS (SELECT *, 'Q' || q || ' ' || y AS label, last_day(make_date(y, q*3, 1)) AS ends,
    CAST(last_day(make_date(y, q*3, 1)) + CASE WHEN q = 4 THEN 90 ELSE 45 END AS date) AS effective FROM quarters)"""

EQUITY = f"""{QUARTERS}, equity AS (
  SELECT upper(ticker) AS Ticker, label AS Period_Label, y AS Calendar_Year, q AS Calendar_Quarter,
    ends AS Quarter_End_Date, effective AS Effective_Date, CAST(u AS double) AS Book_Equity_Total,
    -CAST(u % 97 AS double) + 0.0 AS Non_Controlling_Interest,
    CAST(u AS double) + CAST(u % 97 AS double) AS Book_Equity_Parent,
    CAST(u * 3 AS double) AS Total_Assets, CAST(u * 3 AS double) AS Total_Sources,
    0.0::double AS Balance_Difference, 0.0::double AS Balance_Difference_Pct FROM dated)"""


@query(
    "header_row",
    "SELECT DISTINCT p_brand AS sheet, 1 AS header_row FROM part JOIN lineitem ON l_partkey = p_partkey "
    "GROUP BY p_brand HAVING count(DISTINCT year(l_shipdate) * 4 + quarter(l_shipdate)) >= 4",
)
def header_row(spark, sf_dir):
    return st.find_header_rows(sheet_rows(spark, sf_dir))


@query(
    "sheet_audit",
    """WITH q AS (SELECT p_brand AS sheet, count(DISTINCT year(l_shipdate) * 4 + quarter(l_shipdate)) AS n
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT sheet, CASE WHEN n >= 4 THEN 'ok' ELSE 'refused' END AS status, 7 AS n_rows, CAST(n AS int) AS most_period_labels,
  CASE WHEN n >= 4 THEN 1 END AS header_row FROM q
UNION ALL SELECT 'thin ' || sheet, 'refused', 7, CAST(least(n, 3) AS int), NULL FROM q""",
)
def sheet_audit(spark, sf_dir):
    """Every sheet and, of each, a copy of its first three quarters, which is refused."""
    rows = sheet_rows(spark, sf_dir)
    thin = rows.select(F.concat(F.lit("thin "), "sheet").alias("sheet"), "row_idx", F.slice("cells", 1, 4).alias("cells"))
    return st.sheet_audit(rows.unionByName(thin))


@query(
    "statement_unpivot",
    f"""WITH {QUARTERS} SELECT upper(ticker) AS Ticker, 'Balance Sheet' AS Statement, id AS Account_ID, r + 1 AS Original_Excel_Row,
  name AS Account_Name, norm AS Account_Name_Normalized, label AS Period_Label, y AS Calendar_Year,
  q AS Calendar_Quarter, ends AS Quarter_End_Date, effective AS Effective_Date,
  CAST(CASE r WHEN 3 THEN u WHEN 4 THEN 0 WHEN 5 THEN -(u % 97) ELSE u * 3 END AS double) AS Value
FROM dated, (VALUES (2, 'TOTAL ASSETS', 'total assets', 'BS_001'), (3, 'OWNER''S EQUITY', 'owner s equity', 'BS_002'),
  (4, 'Minority interests', 'minority interests', 'BS_003'), (5, 'Minority Interest', 'minority interest', 'BS_004'),
  (6, 'TOTAL RESOURCES', 'total resources', 'BS_005')) a(r, name, norm, id)""",
    {"Value": 2},
)
def statement_unpivot(spark, sf_dir):
    return st.statement_long(sheet_rows(spark, sf_dir))


@query("book_equity", f"WITH {EQUITY} SELECT * FROM equity", {"Non_Controlling_Interest": 2})
def book_equity(spark, sf_dir):
    return st.book_equity(st.statement_long(sheet_rows(spark, sf_dir)))


@query(
    "book_equity_audit",
    f"""WITH {EQUITY}, t AS (SELECT Ticker, count(*) AS n, min_by(Period_Label, Quarter_End_Date) AS first,
  max_by(Period_Label, Quarter_End_Date) AS last FROM equity GROUP BY 1)
SELECT Ticker, unnest(['book_equity_total_account', 'nci_accounts_found', 'total_assets_account',
    'total_sources_account', 'max_abs_balance_difference', 'rows', 'start_period', 'end_period']) AS check,
  unnest(['OWNER''S EQUITY', 'Minority interests; Minority Interest', 'TOTAL ASSETS', 'TOTAL RESOURCES', '0.0',
    CAST(n AS varchar), first, last]) AS value, 'ok' AS status FROM t""",
)
def book_equity_audit(spark, sf_dir):
    long = st.statement_long(sheet_rows(spark, sf_dir))
    return st.book_equity_audit(st.book_equity(long), st.account_names(long))


# ---- valuation: daily market cap against quarterly book equity ------------------------------------


def book(spark, sf_dir):
    y, q = F.year("l_shipdate"), F.quarter("l_shipdate")
    quarters = trades(spark, sf_dir).groupBy("ticker", y.alias("y"), q.alias("q")).agg(F.sum(cents()).alias("c"))
    end = F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1)))
    raw = quarters.select(
        "ticker", F.col("y").alias("calendar_year"), F.col("q").alias("calendar_quarter"),
        end.alias("quarter_end_date"),
        F.date_add(end, F.when(F.col("q") == 4, 90).otherwise(45)).alias("effective_date"),
        (F.col("c").cast("double") / 100.0).alias("book_equity_parent"),
    )
    return scan_book_equity(raw)


def market_caps(spark, sf_dir):
    raw = bars(spark, sf_dir).select(
        "ticker", "date", "close", (F.col("close") * 1000000).alias("marketCap")
    )
    return scan_market_cap(raw, "close")


def valuation(spark, sf_dir):
    return build_valuation(market_caps(spark, sf_dir), book(spark, sf_dir))


BOOK = f"""{QUARTERS}, book AS (
  SELECT upper(ticker) AS ticker, y AS calendar_year, q AS calendar_quarter, ends AS quarter_end_date,
    effective AS effective_date, CAST(cents AS double) / 100.0 AS book_equity_parent FROM dated)"""

CAPS = f"""{BARS}, caps AS (
  SELECT upper(ticker) AS ticker, date, close, close * 1000000 AS market_cap FROM bars)"""

_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)"
PB = f"""{CAPS}, {BOOK}, pb AS MATERIALIZED (
  SELECT c.ticker, c.date, c.close, c.market_cap, b.effective_date, b.calendar_year, b.calendar_quarter,
    b.quarter_end_date, b.book_equity_parent, c.market_cap / (b.book_equity_parent + 1e-9) AS pb,
    row_number() OVER (PARTITION BY c.ticker ORDER BY c.date) AS rn
  FROM caps c ASOF LEFT JOIN book b ON c.ticker = b.ticker AND c.date >= b.effective_date)"""
PB_WINDOWS = f"""{PB}, z AS MATERIALIZED (
  SELECT *, CASE WHEN count(pb) {_W} >= 120 THEN (pb - avg(pb) {_W}) / (stddev_samp(pb) {_W} + 1e-9) END AS z,
    count(pb) {_W} AS n FROM pb)"""
# share of the window at or below the current value, by comparing with every row of the window
PB_SHARE = f"""{PB_WINDOWS}, share AS MATERIALIZED (
  SELECT a.ticker, a.date, sum(CASE WHEN b.pb <= a.pb THEN 1 ELSE 0 END) / CAST(count(b.pb) AS double) AS share
  FROM z a JOIN pb b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 755 AND a.rn
  WHERE a.n >= 120 AND a.pb IS NOT NULL GROUP BY 1, 2)"""


@query("book_scan", f"WITH {BOOK} SELECT * FROM book")
def book_scan(spark, sf_dir):
    return book(spark, sf_dir)


@query(
    "asof_valuation",
    f"""WITH {PB} SELECT ticker, date, close, market_cap, effective_date, calendar_year, calendar_quarter,
  quarter_end_date, book_equity_parent FROM pb""",
)
def asof_valuation(spark, sf_dir):
    right = book(spark, sf_dir)
    columns = [c for c in right.columns if c != "ticker"]
    return asof_join(market_caps(spark, sf_dir), right, "date", "effective_date", ["ticker"], columns)


@query(
    "valuation_ratios",
    f"""WITH {PB_WINDOWS} SELECT ticker, date, pb AS PB, CASE WHEN pb > 0 THEN 1 / (pb + 1e-9) END AS Book_to_Market,
  CASE WHEN pb > 0 THEN ln(pb) END AS Log_PB, z AS PB_Z_756, market_cap / 1e9 AS MarketCap_TyDong,
  book_equity_parent / 1e9 AS Book_Equity_Parent_TyDong FROM z""",
    {"Log_PB": 6, "PB_Z_756": 4},
)
def valuation_ratios(spark, sf_dir):
    return valuation(spark, sf_dir).select(
        "ticker", "date", "PB", "Book_to_Market", "Log_PB", "PB_Z_756", "MarketCap_TyDong",
        "Book_Equity_Parent_TyDong",
    )


@query(
    "pb_percentile",
    f"WITH {PB_SHARE} SELECT z.ticker, z.date, share AS PB_Percentile_756 FROM z LEFT JOIN share USING (ticker, date)",
)
def pb_percentile(spark, sf_dir):
    return valuation(spark, sf_dir).select("ticker", "date", "PB_Percentile_756")


@query(
    "valuation_audit",
    f"""WITH {PB}, a AS (SELECT ticker, count(*) AS n, count(pb) AS k, min(date) AS d0, max(date) AS d1, min(pb) AS lo,
  median(pb) AS mid, max(pb) AS hi, max_by(pb, date) FILTER (pb IS NOT NULL) AS last,
  sum(CASE WHEN effective_date > date THEN 1 ELSE 0 END) AS leaks FROM pb GROUP BY 1)
SELECT ticker, c AS check, v AS value, s AS status FROM (SELECT ticker,
  unnest(['rows_total', 'rows_with_pb', 'rows_missing_pb', 'start_date', 'end_date', 'pb_max_above_20',
    'lookahead_leakage_rows', 'ticker']) AS c,
  unnest([CAST(n AS varchar), CAST(k AS varchar), CAST(n - k AS varchar), CAST(d0 AS varchar), CAST(d1 AS varchar),
    CAST(hi > 20 AS varchar), CAST(leaks AS varchar), ticker]) AS v,
  unnest(['ok', CASE WHEN k > 0 THEN 'ok' ELSE 'empty' END, CASE WHEN n > k THEN 'review' ELSE 'ok' END, 'ok', 'ok',
    CASE WHEN hi > 20 THEN 'review' ELSE 'ok' END, CASE WHEN leaks = 0 THEN 'ok' ELSE 'fail' END, 'ok']) AS s
  FROM a) rows""",
)
def valuation_audit_query(spark, sf_dir):
    """Checks as text; the four PB figures are compared as numbers in ``valuation_audit_ratios``."""
    audit = valuation_audit(valuation(spark, sf_dir))
    high = F.col("check") == "pb_max"
    return audit.where(~F.col("check").isin("pb_min", "pb_median", "latest_pb")).select(
        "ticker",
        F.when(high, "pb_max_above_20").otherwise(F.col("check")).alias("check"),
        F.when(high, (F.col("value").cast("double") > 20).cast("string")).otherwise(F.col("value")).alias("value"),
        "status",
    )


@query(
    "valuation_audit_ratios",
    f"""WITH {PB}, a AS (SELECT ticker, min(pb) AS pb_min, median(pb) AS pb_median, max(pb) AS pb_max,
  max_by(pb, date) FILTER (pb IS NOT NULL) AS latest_pb FROM pb GROUP BY 1)
SELECT ticker, name AS check, v AS value FROM a UNPIVOT (v FOR name IN (pb_min, pb_median, pb_max, latest_pb)) u""",
    {"value": 4},
)
def valuation_audit_ratios(spark, sf_dir):
    audit = valuation_audit(valuation(spark, sf_dir))
    wanted = F.col("check").isin("pb_min", "pb_median", "pb_max", "latest_pb")
    return audit.where(wanted).select("ticker", "check", F.col("value").cast("double").alias("value"))


@query(
    "valuation_merge",
    f"""WITH {RETURNS}, {PB_SHARE.removeprefix(BARS + ', ')}
SELECT ret.ticker, ret.date, r AS Log_Return, z.pb AS PB, CASE WHEN z.pb > 0 THEN 1 / (z.pb + 1e-9) END AS Book_to_Market,
  CASE WHEN z.pb > 0 THEN ln(z.pb) END AS Log_PB, z.z AS PB_Z_756, share AS PB_Percentile_756
FROM ret LEFT JOIN z ON z.ticker = upper(ret.ticker) AND z.date = ret.date
  LEFT JOIN share ON share.ticker = z.ticker AND share.date = z.date""",
    {"Log_Return": 6, "Log_PB": 6, "PB_Z_756": 4},
)
def valuation_merge(spark, sf_dir):
    """Feature rows with the valuation of the same day; the scan keeps the columns it finds."""
    left = feature_frame(spark, sf_dir, columns=["Log_Return"]).withColumn("shown", F.col("ticker")).withColumn(
        "ticker", F.upper("ticker")
    )
    right = scan_valuation(valuation(spark, sf_dir), VALUATION, "effective_date")
    merged = merge_valuation(left, right, VALUATION)
    return merged.select(F.col("shown").alias("ticker"), "date", "Log_Return", *VALUATION)
