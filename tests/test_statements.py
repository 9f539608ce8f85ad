import pytest

from barloom.operators import statements as st
from barloom.operators.valuation import build_valuation, merge_valuation, valuation_audit

SHEET = [
    ["Some company", None],
    ["note", "Q1 2020", "Q2 2020"],                                     # too few labels
    ["Chỉ tiêu", "Q1 2020", "Q2 2020", "Q3/2020", "2020-Q4", "Note", "Q1 2021"],
    ["TOTAL ASSETS", "3,000", "3,100", "3,200", "3,300", "x", None],
    [None, None, None, None, None, None, None],                         # blank row
    ["Vốn chủ sở hữu", "1,000", "1,100", "--", "1,300", None, None],
    ["Minority interests", "0", "(5)", "0", None, None, None],
    ["Minority Interest", "7", "8", "0", "9", None, None],
    [None, "99", None, None, None, None, None],                         # values without a name
    ["TOTAL RESOURCES", "3,000", "3,099", "3,200", "3,300", None, None],
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [("aaa", i, cells) for i, cells in enumerate(SHEET)]
    data += [("bbb", 0, ["x", "Q1 2020", "Q2 2020", "Q3 2020", "Q4 2020"]), ("bbb", 1, ["TOTAL EQUITY", "1", "2", "3", "4"])]
    data += [("ccc", 0, ["ITEMS", "Q1 2020"]), ("ccc", 1, ["TOTAL EQUITY", "1"])]
    return spark.createDataFrame(data, "sheet string, row_idx int, cells array<string>")


def test_header_rows(rows):
    # bbb has no account label and falls back to its period count; ccc has too few periods
    assert {r.sheet: r.header_row for r in st.find_header_rows(rows).collect()} == {"aaa": 2, "bbb": 0}


def test_long_statement(rows):
    long = st.statement_long(rows).where("Ticker = 'AAA'")
    accounts = {r.Account_Name: (r.Account_ID, r.Original_Excel_Row) for r in long.collect()}
    # the blank row does not count, the nameless one does
    assert accounts == {
        "TOTAL ASSETS": ("BS_001", 4), "Vốn chủ sở hữu": ("BS_002", 5), "Minority interests": ("BS_003", 6),
        "Minority Interest": ("BS_004", 7), "TOTAL RESOURCES": ("BS_005", 9),
    }
    assert {r.Period_Label for r in long.collect()} == {"Q1 2020", "Q2 2020", "Q3/2020", "2020-Q4"}
    assert long.count() == 20
    assert st.statement_long(rows, keep_missing=False).where("Ticker = 'AAA'").count() == 18


def test_book_equity_and_audit(rows):
    long = st.statement_long(rows)
    book = {(r.Ticker, r.Calendar_Quarter): r for r in st.book_equity(long).collect()}
    got = {q: book["AAA", q] for q in (1, 2, 3, 4)}
    assert [got[q].Non_Controlling_Interest for q in got] == [7.0, -5.0, 0.0, 9.0]
    assert [got[q].Book_Equity_Parent for q in got] == [993.0, 1105.0, None, 1291.0]
    assert got[2].Balance_Difference == 1.0 and got[2].Balance_Difference_Pct == pytest.approx(1 / 3100)
    assert str(got[4].Effective_Date) == "2021-03-31"
    audit = st.book_equity_audit(st.book_equity(long), st.account_names(long))
    a = {r.check: (r.value, r.status) for r in audit.where("Ticker = 'AAA'").collect()}
    assert a["nci_accounts_found"] == ("Minority interests; Minority Interest", "ok")
    assert a["max_abs_balance_difference"] == ("1.0", "ok")
    assert (a["start_period"][0], a["end_period"][0], a["rows"][0]) == ("Q1 2020", "2020-Q4", "4")
    b = {r.check: (r.value, r.status) for r in audit.where("Ticker = 'BBB'").collect()}
    assert b["total_assets_account"] == (None, "missing_optional")
    assert b["max_abs_balance_difference"][1] == "review"


def test_asof_is_inclusive_and_percentile_counts_ties(spark):
    import datetime as dt

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    caps = [100.0, 200.0, 200.0, 100.0, None, 300.0]
    left = spark.createDataFrame([("A", d, 1.0, m) for d, m in zip(days, caps)],
                                 "ticker string, date date, close double, market_cap double")
    right = spark.createDataFrame([("A", days[1], 2020, 1, days[0], 100.0), ("A", days[3], 2020, 2, days[2], -50.0)],
        "ticker string, effective_date date, calendar_year int, calendar_quarter int, quarter_end_date date, book_equity_parent double")
    out = build_valuation(left, right, window=3, min_periods=2).orderBy("date").collect()
    assert [r.calendar_quarter for r in out] == [None, 1, 1, 2, 2, 2]
    assert [None if r.PB is None else round(r.PB, 6) for r in out] == [None, 2.0, 2.0, -2.0, None, -6.0]
    assert [r.PB_Percentile_3 for r in out] == [None, None, 1.0, pytest.approx(1 / 3), None, 0.5]
    assert out[3].Log_PB is None and out[3].Book_to_Market is None
    audit = {r.check: (r.value, r.status) for r in valuation_audit(spark.createDataFrame(out)).collect()}
    assert audit["rows_missing_pb"] == ("2", "review") and audit["lookahead_leakage_rows"] == ("0", "ok")
    assert audit["latest_pb"][0] == "-6.0" and audit["pb_median"][0] == "0.0"
    merged = merge_valuation(left.select("ticker", "date"), spark.createDataFrame(out).select("ticker", "date", "PB"), ["PB", "Log_PB"])
    assert merged.columns == ["ticker", "date", "PB", "Log_PB"] and merged.count() == 6


def test_header_in_row_60(spark):
    from barloom.operators.statements import sheet_headers

    rows = [("S", i, ["note", None, None, None, None]) for i in range(60)] + [("S", 60, ["Chỉ tiêu", "Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024"])]
    found = sheet_headers(spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")).collect()
    assert len(found) == 1 and 60 in found[0].asDict().values()
