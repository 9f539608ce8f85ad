"""Wide statement sheets to long statements to quarterly book equity.

Sheets arrive as rows (sheet, row_idx, cells array). Whatever concerns one row is an array
expression; the header is picked by one combining aggregation per sheet and joined back. The number
of a row within its sheet needs a window: a sheet is bounded by its format (1,048,576 rows by
16,384 columns at most, a few hundred rows in practice), and many sheets are processed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.dates import effective_date, parse_period, quarter_end
from barloom.functions.numbers import parse_number
from barloom.functions.text import clean_account_name, normalize_text

# fixed values: labels of the account column, and account names per book-equity component
ACCOUNT_LABELS = ["items", "item", "account", "accounts", "chi tieu", "chi tieu bao cao"]
ACCOUNT_ALIASES = {
    "total_assets": ["TOTAL ASSETS", "Tổng tài sản"],
    "total_sources": [
        "TOTAL RESOURCES",
        "TOTAL LIABILITIES AND OWNER'S EQUITY",
        "TOTAL LIABILITIES AND OWNERS EQUITY",
        "TOTAL LIABILITIES AND SHAREHOLDERS' EQUITY",
        "Tổng cộng nguồn vốn",
    ],
    "book_equity_total": [
        "OWNER'S EQUITY",
        "OWNERS EQUITY",
        "SHAREHOLDERS' EQUITY",
        "SHAREHOLDERS EQUITY",
        "STOCKHOLDERS' EQUITY",
        "STOCKHOLDERS EQUITY",
        "TOTAL EQUITY",
        "Vốn chủ sở hữu",
    ],
    "non_controlling_interest": [
        "Minority interests",
        "Minority interest",
        "Non-controlling interests",
        "Non-controlling interest",
        "Lợi ích cổ đông không kiểm soát",
        "Lợi ích của cổ đông thiểu số",
    ],
}
MIN_PERIOD_LABELS = 4


def _is_account_label(text: Column) -> Column:
    label = normalize_text(text)
    return label.isin(ACCOUNT_LABELS) | F.contains(label, F.lit("chi tieu"))


def _blank_to_null(rows: DataFrame) -> DataFrame:
    cells = F.transform("cells", lambda t: F.nullif(F.trim(t), F.lit("")))
    return rows.select("sheet", "row_idx", cells.alias("cells"))


def sheet_headers(rows: DataFrame) -> DataFrame:
    """Per sheet: header row, account column and its period columns.

    The header is the first row with an account label and enough period labels,
    else the row with most period labels if there are enough."""
    leading = _blank_to_null(rows).withColumns(
        {
            "labels": F.transform("cells", lambda t: F.coalesce(_is_account_label(t), F.lit(False))),
            "parsed": F.transform("cells", parse_period),
        }
    )
    periods = F.size(F.filter("parsed", lambda p: p.isNotNull()))
    leading = leading.withColumn("periods", periods).where(F.col("periods") >= MIN_PERIOD_LABELS)
    row = F.struct("row_idx", "cells", "labels", "parsed")
    labeled = F.array_contains("labels", True)
    heads = leading.groupBy("sheet").agg(
        F.coalesce(
            F.min_by(row, F.when(labeled, F.col("row_idx"))),
            F.max_by(row, F.struct("periods", -F.col("row_idx"))),
        ).alias("h")
    )
    no_period = F.transform("h.parsed", lambda p: p.isNull())
    by_label = F.array_position("h.labels", True)
    columns = F.filter(
        F.transform(
            "h.parsed",
            lambda p, i: F.when(
                p.isNotNull(),
                F.struct(
                    i.alias("col_idx"), F.get("h.cells", i).alias("label"),
                    p["year"].alias("year"), p["quarter"].alias("quarter"),
                ),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    return heads.select(
        "sheet", F.col("h.row_idx").alias("header_row"),
        (F.when(by_label > 0, by_label).otherwise(F.array_position(no_period, True)) - 1)
        .cast("int").alias("account_col"),
        columns.alias("columns"),
    )


def sheet_audit(rows: DataFrame) -> DataFrame:
    """One row per sheet: sheet, status (``ok``, or ``refused`` where no row has enough period labels, so that the sheet gives no
    statement), n_rows, most_period_labels of a row, header_row."""
    labels = F.size(F.filter(F.transform("cells", parse_period), lambda p: p.isNotNull()))
    sheets = _blank_to_null(rows).groupBy("sheet").agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"), F.max(labels).alias("most_period_labels"))
    found = sheets.join(find_header_rows(rows), "sheet", "left")
    status = F.when(F.col("header_row").isNull(), "refused").otherwise("ok")
    return found.select("sheet", status.alias("status"), "n_rows", "most_period_labels", "header_row")


def find_header_rows(rows: DataFrame) -> DataFrame:
    return sheet_headers(rows).select("sheet", "header_row")


def statement_long(rows: DataFrame, keep_missing: bool = True) -> DataFrame:
    """One row per account and quarter with its parsed value. Blank rows and quarters without any
    value are left out; accounts are numbered in sheet order."""
    body = _blank_to_null(rows).join(sheet_headers(rows), "sheet").where(
        (F.col("row_idx") > F.col("header_row")) & F.exists("cells", lambda t: t.isNotNull())
    )
    order = Window.partitionBy("sheet").orderBy("row_idx")
    name = clean_account_name(F.get("cells", F.col("account_col")))
    named = (
        body.withColumns({"Account_Name": name, "position": F.row_number().over(order)})
        .where("Account_Name <> ''")
        .withColumn("account_no", F.row_number().over(order))
    )
    cell = F.get("cells", F.col("c.col_idx"))
    used = Window.partitionBy("sheet", "c.col_idx")
    grid = named.withColumn("c", F.explode("columns")).withColumn("text", cell)
    grid = grid.withColumn("column_used", F.max(F.col("text").isNotNull()).over(used)).where("column_used")
    year, quarter = F.col("c.year"), F.col("c.quarter")
    end = quarter_end(year, quarter)
    long = grid.select(
        F.upper("sheet").alias("Ticker"), F.lit("Balance Sheet").alias("Statement"),
        F.format_string("BS_%03d", "account_no").alias("Account_ID"),
        (F.col("header_row") + 1 + F.col("position")).alias("Original_Excel_Row"),
        "Account_Name", normalize_text("Account_Name").alias("Account_Name_Normalized"),
        F.col("c.label").alias("Period_Label"), year.alias("Calendar_Year"),
        quarter.alias("Calendar_Quarter"), end.alias("Quarter_End_Date"),
        effective_date(end, quarter).alias("Effective_Date"),
        parse_number("text", "statement").alias("Value"),
    )
    return long if keep_missing else long.where("Value IS NOT NULL")


PERIOD_KEYS = ["Ticker", "Period_Label", "Calendar_Year", "Calendar_Quarter", "Quarter_End_Date", "Effective_Date"]


def alias_frame(long: DataFrame) -> DataFrame:
    """(component, Account_Name_Normalized): the alias list as a dimension table."""
    pairs = [(part, alias) for part, aliases in ACCOUNT_ALIASES.items() for alias in aliases]
    raw = long.sparkSession.createDataFrame(pairs, "component string, alias string")
    return raw.select("component", normalize_text("alias").alias("Account_Name_Normalized")).distinct()


def match_accounts(long: DataFrame) -> DataFrame:
    """Accounts that stand for a component, numbered in sheet order per component."""
    accounts = long.select(
        "Ticker", "Account_ID", "Account_Name", "Account_Name_Normalized", "Original_Excel_Row"
    ).distinct()
    # the alias list is a fixed dimension of a few dozen rows
    matched = accounts.join(F.broadcast(alias_frame(long)), "Account_Name_Normalized")
    order = Window.partitionBy("Ticker", "component").orderBy("Original_Excel_Row")
    return matched.withColumn("match_no", F.row_number().over(order))


def used_accounts(matched: DataFrame) -> DataFrame:
    """First match counts, except that every non-controlling-interest account is a candidate."""
    return matched.where((F.col("match_no") == 1) | (F.col("component") == "non_controlling_interest"))


def book_equity(long: DataFrame) -> DataFrame:
    """Quarterly book equity: one conditional aggregation instead of a join per account."""
    used = used_accounts(match_accounts(long)).select("Ticker", "Account_ID", "component", "match_no")
    values = long.join(used, ["Ticker", "Account_ID"])
    value, part = F.col("Value"), F.col("component")

    def of(name: str) -> Column:
        return F.max(F.when(part == name, value))

    nci = F.when((part == "non_controlling_interest") & (value != 0), value)
    book = values.groupBy(*PERIOD_KEYS).agg(
        F.max((part == "book_equity_total").cast("int")).alias("has_equity"),
        of("book_equity_total").alias("Book_Equity_Total"),
        # first candidate, in sheet order, that is neither missing nor zero
        F.coalesce(
            F.min_by(nci, F.when(nci.isNotNull(), F.col("match_no"))), F.lit(0.0)
        ).alias("Non_Controlling_Interest"),
        of("total_assets").alias("Total_Assets"),
        of("total_sources").alias("Total_Sources"),
    ).where("has_equity = 1")
    c = F.col
    difference = c("Total_Assets") - c("Total_Sources")
    return book.select(
        *PERIOD_KEYS, "Book_Equity_Total", "Non_Controlling_Interest",
        (c("Book_Equity_Total") - c("Non_Controlling_Interest")).alias("Book_Equity_Parent"),
        "Total_Assets", "Total_Sources", difference.alias("Balance_Difference"),
        F.when(F.abs("Total_Assets") > 0, difference / F.abs("Total_Assets")).alias("Balance_Difference_Pct"),
    )


def account_names(long: DataFrame) -> DataFrame:
    """Per ticker: the account behind each component, and all candidate NCI accounts."""
    used = used_accounts(match_accounts(long))
    name, part = F.col("Account_Name"), F.col("component")

    def of(component: str) -> Column:
        return F.max(F.when(part == component, name))

    candidates = F.array_sort(
        F.collect_list(F.when(part == "non_controlling_interest", F.struct("match_no", "Account_Name")))
    )
    return used.groupBy("Ticker").agg(
        of("book_equity_total").alias("Book_Equity_Total_Account"),
        F.array_join(F.transform(candidates, lambda x: x["Account_Name"]), "; ").alias("NCI_Accounts_Found"),
        of("total_assets").alias("Total_Assets_Account"),
        of("total_sources").alias("Total_Sources_Account"),
    )


def book_equity_audit(book: DataFrame, names: DataFrame) -> DataFrame:
    """(Ticker, check, value, status) of one ticker's book-equity table."""
    stats = book.groupBy("Ticker").agg(
        F.max(F.abs("Balance_Difference")).alias("worst"),
        F.count(F.lit(1)).alias("rows"),
        F.min_by("Period_Label", F.struct("Calendar_Year", "Calendar_Quarter")).alias("first"),
        F.max_by("Period_Label", F.struct("Calendar_Year", "Calendar_Quarter")).alias("last"),
    )
    c = F.col

    def entry(check: str, value: Column, status: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), value.cast("string").alias("value"), status.alias("status"))

    def found(column: str, otherwise: str) -> Column:
        return F.when(F.coalesce(c(column), F.lit("")) != "", "ok").otherwise(otherwise)

    # fixed values: check names and statuses
    checks = F.array(
        entry("book_equity_total_account", c("Book_Equity_Total_Account"), found("Book_Equity_Total_Account", "missing")),
        entry("nci_accounts_found", c("NCI_Accounts_Found"), found("NCI_Accounts_Found", "missing_optional")),
        entry("total_assets_account", c("Total_Assets_Account"), found("Total_Assets_Account", "missing_optional")),
        entry("total_sources_account", c("Total_Sources_Account"), found("Total_Sources_Account", "missing_optional")),
        entry("max_abs_balance_difference", c("worst"), F.when(c("worst") <= 1, "ok").otherwise("review")),
        entry("rows", c("rows"), F.lit("ok")),
        entry("start_period", c("first"), F.lit("ok")),
        entry("end_period", c("last"), F.lit("ok")),
    )
    return stats.join(names, "Ticker").select("Ticker", F.inline(checks))
