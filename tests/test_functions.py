import pytest
from pyspark.sql import functions as F

from barloom.functions import rules as R
from barloom.functions.dates import effective_date, order_from_votes, order_votes, parse_date, parse_period, quarter_end
from barloom.functions.numbers import is_close, parse_number, safe_float, strict_bool, value_matches
from barloom.functions.text import clean_account_name, normalize_header, normalize_text


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


NUMBERS = {  # text: (market, loader, statement)
    "72,700.00": (72700.0, 72700.0, 72700.0),
    "72,70": (72.7, 7270.0, 7270.0),
    "1.341,86": (1341.86, 1.34186, 1.34186),
    "1.234.567": (1234567.0, None, None),
    "1,234,567": (1234567.0, 1234567.0, 1234567.0),
    "569.40K": (569400.0, 569400.0, None),
    "1.2b": (1.2e9, 1.2e9, None),
    "0.55%": (0.0055, 0.0055, None),
    "45,21%": (0.4521, 45.21, None),
    "(1,000)": (-1000.0, None, -1000.0),
    "(5%)": (-0.05, None, None),
    "-3.5": (-3.5, -3.5, -3.5),
    "−3.5": (-3.5, None, None),
    "5K%": (50.0, None, None),
    " 1 000 ": (1000.0, 1000.0, 1000.0),
    "1 000": (1000.0, None, None),
    "--": (None, None, None),
    "nan": (None, None, None),
    "null": (None, None, None),
    "": (None, None, None),
    "1e3": (13.0, 1000.0, 1000.0),
    "abc": (None, None, None),
}


@pytest.mark.parametrize("index,dialect", [(0, "market"), (1, "loader"), (2, "statement")])
def test_number_dialects(spark, index, dialect):
    got = values(spark, list(NUMBERS), parse_number("t", dialect))
    for text, value, want in zip(NUMBERS, got, NUMBERS.values()):
        assert value == (pytest.approx(want[index], rel=1e-12) if want[index] is not None else None), (text, value)


def test_report_cells(spark):
    assert values(spark, ["5%", "1,200", "None", " 0.5 ", "x"], safe_float("t")) == [0.05, 1200.0, None, 0.5, None]
    assert values(spark, ["True", " yes", "1", "no", None], strict_bool("t")) == [True, True, True, False, False]
    n = F.col("t").cast("double")
    assert values(spark, ["0.1000000001", "0.11", None], value_matches(n, 0.1)) == [True, False, False]
    assert values(spark, ["0.1", "7"], value_matches(n, None)) == [True, True]
    assert values(spark, ["0.1000001", "0.11"], is_close(n, 0.1)) == [True, False]


def test_dates(spark):
    assert values(spark, ["16/06/2026", "2026-6-1", "1-2-99", "31/02/2020", "x"], parse_date(F.col("t"), F.lit("dayfirst"))) \
        == values(spark, ["2026-06-16", "2026-06-01", "1999-02-01", None, None], F.col("t").cast("date"))
    assert values(spark, ["06/16/2026"], parse_date(F.col("t"), F.lit("monthfirst")))[0].isoformat() == "2026-06-16"

    def order(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select(order_votes(F.col("t")).alias("v"))
        return df.agg(order_from_votes(F.sum("v.iso"), F.sum("v.first"), F.sum("v.second"))).first()[0]

    assert order("16/06/2026", "01/02/2026") == "dayfirst"
    assert order("06/16/2026", "01/02/2026") == "monthfirst"
    assert order("2026-06-16") == "iso"
    assert order("01/02/2026", None) == "dayfirst"


def test_periods(spark):
    got = values(spark, ["Q1 2024", "2024-Q3", "q4/2023", "Items", None], parse_period(F.col("t")))
    assert [None if g is None else (g.year, g.quarter) for g in got] == [(2024, 1), (2024, 3), (2023, 4), None, None]
    df = spark.createDataFrame([(2010, 1), (2010, 4)], "y int, q int")
    end = quarter_end(F.col("y"), F.col("q"))
    rows = df.select(end.alias("e"), effective_date(end, F.col("q")).alias("d")).collect()
    assert [(str(r.e), str(r.d)) for r in rows] == [("2010-03-31", "2010-05-15"), ("2010-12-31", "2011-03-31")]


def test_text(spark):
    assert values(spark, ["VỐN CHỦ SỞ HỮU", "Lợi ích của cổ đông", "Đầu-tư", None], normalize_text("t")) \
        == ["von chu so huu", "loi ich cua co dong", "dau tu", ""]
    assert values(spark, ["  a  b\t c "], clean_account_name("t")) == ["a b c"]
    assert values(spark, ["﻿Trading Date", "Vol.", "VN_Close"], normalize_header("t")) == ["tradingdate", "vol", "vnclose"]


def test_breakeven_and_action(spark):
    row = spark.range(1).select(
        R.checked_breakeven(F.lit(0.10), F.lit(-0.05), F.lit(0.005)).alias("be"),
        R.checked_breakeven(F.lit(0.10), F.lit(0.05), F.lit(0.005)).alias("bad"),
        R.breakeven_precision(F.lit(0.10), F.lit(-0.07), F.lit(0.0)).alias("plain"),
        R.breakeven_precision(F.lit(0.01), F.lit(-0.07), F.lit(0.02)).alias("hopeless"),
    ).first()
    assert row.be == pytest.approx(0.055 / 0.15) and row.bad is None
    assert row.plain == pytest.approx(0.07 / 0.17) and row.hopeless == 1.0
    cases = {0.1957: "HOLD", 0.56: "WATCHLIST", 0.61: "BUY"}
    for p, action in cases.items():
        got = spark.range(1).select(
            R.decide_action(F.lit(p), F.lit(0.60), F.lit(0.38667), F.lit(0.05)).alias("d")
        ).first().d
        assert got.action == action
    below = spark.range(1).select(R.decide_action(F.lit(0.61), F.lit(0.60), F.lit(0.7), F.lit(0.05)).alias("d")).first().d
    assert below.action == "WATCHLIST" and "below the cost-adjusted" in below.reason


def test_tiers_and_sizing(spark):
    df = spark.createDataFrame([(0.8,), (0.65,), (0.56,), (0.3,)], "p double")
    assert [r[0] for r in df.select(R.classify_signal(F.col("p"), F.lit(0.6))).collect()] \
        == ["STRONG WATCH", "VALID ENTRY", "WEAK SIGNAL", "NO TRADE"]
    size = R.half_kelly_pct(F.lit("VALID ENTRY"), F.col("p"), F.lit(0.1), F.lit(-0.1))
    assert [round(r[0], 6) for r in df.select(size).collect()] == [10.0, 10.0, 6.0, 0.0]
    none = R.half_kelly_pct(F.lit("WEAK SIGNAL"), F.col("p"), F.lit(0.1), F.lit(-0.1))
    assert {r[0] for r in df.select(none).collect()} == {0.0}


def test_fixed_point_texts_round_like_python(spark):
    numbers = [0.125, 1.075, 1.005, 2.675, 0.285, -0.0049, 1e6 + 0.005, 12.5, 1.115, 0.5, 1.5, -2.345]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i")
    x = F.col("x")
    rows = df.select(R.number_text(x, 2), R.percent_text(x, 0), R.percent_text(x), R.number_text(x, 4)).collect()
    for value, row in zip(numbers, rows):
        assert tuple(row) == (f"{value:.2f}", f"{value * 100:.0f}%", f"{value * 100:.2f}%", f"{value:.4f}")


def test_labels_and_ids(spark):
    df = spark.createDataFrame([("set", 20, 0.1, -0.07, 0.5)], "s string, l int, tp double, sl double, th double")
    c = F.col
    row = df.select(
        R.setup_label(c("l"), c("tp"), c("sl"), c("th")), R.setup_id(c("s"), c("l"), c("tp"), c("sl"), c("th")),
        R.grouped_count_text(F.lit(1234.5)), R.short_name(F.lit("reoptimized"), R.SHORT_MODES),
    ).first()
    assert tuple(row) == ("20D | TP 10% | SL -7% | TH 0.50", "set|L20|TP0.1|SL-0.07|TH0.5", "1,234", "reopt")
