import json
import pathlib

import pytest
from pyspark.sql import functions as F

from barloom.sources import bars as market
from barloom.sources import results, vendor


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "AAA.csv").write_text(
        "﻿Ngày,Mở,Cao,Thấp,Lần cuối,Đóng cửa,KL,NN mua\n"
        '16/06/2026,"1,000.5",1010,990,,"1,005",12.5K,300\n'
        "17/06/2026,1001,1011,991,1006,9999,13K,\n"
        "17/06/2026,1002,1012,992,1007,9999,14K,\n"      # same day again: the last row counts
        "18/06/2026,1003,900,993,1008,9999,15K,\n"       # high below close
        "19/06/2026,--,1014,994,1009,9999,16K,\n",       # incomplete
        encoding="utf-8")
    (root / "BBB.csv").write_text(
        "Date;Open;High;Low;Price;Vol.;Change %\n06/16/2026;1;3;0,5;2,5;1.2M;0,55%\n06/17/2026;2;3;1;2;5;--\n",
        encoding="utf-8")
    (root / "vn-index_daily.csv").write_text(
        "Date,Price,Open,High,Low\n2026-06-16,1300,1290,1310,1280\n2026-06-17,,1290,1310,1280\n", encoding="utf-8")
    (root / "market.csv").write_text("VN_Date,VN_Open,VN_High,VN_Low,VN_Close\n2026-06-16,1,2,1,2\n", encoding="utf-8")
    (root / "BAD.csv").write_text("Date,Open,High\n2026-06-16,1,2\n", encoding="utf-8")
    (root / "LEGACY.csv").write_bytes(
        "Date,Open,High,Low,Last,KLGD,Giá\n2026-06-16,1,2,1,2,7,é\n".encode("cp1258"))
    return str(root)


def test_directory_scan_standardizes_every_file(spark, folder):
    raw = market.read_market_csv(spark, folder)
    clean = market.standardize(raw).cache()
    stock = {(r.ticker, str(r.Date)): r for r in market.stock_table(clean).collect()}
    assert sorted(k[0] for k in stock) == ["AAA", "AAA", "AAA", "BBB", "BBB", "LEGACY"]
    first = stock["AAA", "2026-06-16"]
    assert (first.Open, first.Close, first.Volume, first.Buy_Volume_Foreign) == (1000.5, 1005.0, 12500.0, 300.0)
    assert stock["AAA", "2026-06-17"].Close == 1007.0
    other = stock["BBB", "2026-06-16"]
    assert (other.Low, other.Close, other.Volume, other.Change_Pct) == (0.5, 2.5, 1.2e6, pytest.approx(0.0055))
    index = {(r.index_id, str(r.Date)): r.VN_Close for r in market.index_table(clean).collect()}
    assert index == {("vn-index_daily.csv", "2026-06-16"): 1300.0, ("market.csv", "2026-06-16"): 2.0}


def test_file_audit(spark, folder):
    audit = {r.file: r for r in market.file_audit(market.read_market_csv(spark, folder)).collect()}
    a = audit["AAA.csv"]
    assert (a.status, a.file_type, a.raw_rows, a.clean_rows, a.dropped_rows) == ("SUCCESS", "stock", 5, 3, 2)
    assert (a.dropped_missing_core_rows, a.duplicate_dates_removed, a.ohlc_invalid_rows) == (1, 1, 1)
    assert (a.date_order_detected, audit["BBB.csv"].date_order_detected) == ("dayfirst", "monthfirst")
    bad = audit["BAD.csv"]
    assert (bad.status, bad.clean_rows, bad.missing_required_columns) == ("FAILED", 0, "Low, Close, Volume")
    assert audit["vn-index_daily.csv"].dropped_missing_core_rows == 1


def test_headers_sort_only_rows_that_may_lead(spark, monkeypatch):
    body = [(f, (k, i), ["2026-06-16", "1", str(k)]) for f in ("a.csv", "b.csv") for k in range(1, 50) for i in range(4)]
    rows = body + [("a.csv", (0, 3), ["Date", "Open", "High"]), ("a.csv", (0, 4), ["x", "y", "z"]), ("b.csv", (0, 0), ["Date", "Open", "Low"]), (None, (None, 5), ["Date"])]
    raw = spark.createDataFrame(rows, "file string, ordinal struct<block:bigint,line:int>, cells array<string>")
    sorted_rows, least = [], market.least_rows
    monkeypatch.setattr(market, "least_rows", lambda *a, **k: [sorted_rows.append(least(*a, **k)), sorted_rows[-1]][1])
    heads = {r["file"]: r for r in market.file_headers(raw).collect()}
    assert (heads["a.csv"].n, tuple(heads["a.csv"]["first"]), heads["b.csv"].n) == (198, (0, 3), 197)
    assert (heads["a.csv"].one[:4], heads["b.csv"].one[:4]) == ([0, 1, 2, None], [0, 1, None, 2])
    assert heads[None].n == 1 and sorted_rows[0].count() == 4


def test_a_target_of_three_columns_takes_the_first_text(spark, tmp_path):
    (tmp_path / "T.csv").write_text("Date,Open,High,Low,Last,Close,Price,KL\n2026-06-16,1,3,1,,,2,5\n2026-06-17,1,3,1,,2.5,2,5\n", encoding="utf-8")
    clean = market.standardize(market.read_market_csv(spark, str(tmp_path)))
    assert sorted(r.Close for r in clean.collect()) == [2.0, 2.5]


def test_loader(spark):
    df = spark.createDataFrame([("2026-06-16", "1,000", "5K", "x"), ("bad", "1", "1", "1")],
                               "Date string, Close string, Volume string, Net_Volume_Foreign string")
    assert [tuple(r)[1:] for r in market.load_bars(df).collect()] == [(1000.0, 5000.0, None)]
    index = spark.createDataFrame([("2026-06-16", 1300.0)], "VN_Date string, VN_Close double")
    assert market.load_bars(index, benchmark=True).columns == ["date", "vn_close"]
    with pytest.raises(ValueError, match="Volume"):
        market.load_bars(df.drop("Volume"))


def test_partitioned_bars_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("AAA", 1.0), ("BBB", 2.0)], "ticker string, close double")
    results.save(df, str(tmp_path / "bars"), "parquet", ["ticker"])
    one = market.ticker_bars(spark, str(tmp_path / "bars"), ["aaa"])
    assert [r.close for r in one.collect()] == [1.0]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan or "PartitionFilters: [" in plan and "ticker" in plan


def test_vendor_payload_shapes(spark):
    record = {"date": "2026-06-16T00:00:00", "close": 10, "market_cap": 2e9}
    later = {**record, "close": 11}
    bodies = [[record, later], {"data": [record]}, {"result": [record]}, {"data": {"prices": [record]}}, {"msg": "no"}]
    rows = [(f"S{i}", i, json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "symbol string, fetched_at int, body string")
    got = {r.Symbol: r for r in vendor.standardize_prices(df, "landing").collect()}
    assert set(got) == {"S0", "S1", "S2", "S3"}
    assert (got["S0"].Close, got["S0"].MarketCap_TyDong, got["S0"].Open) == (11.0, 2.0, None)
    assert [r.symbol for r in vendor.unreadable_payloads(df).collect()] == ["S4"]


def test_book_scan_needs_its_columns(spark):
    with pytest.raises(ValueError, match="effective_date"):
        vendor.scan_book_equity(spark.createDataFrame([("a", 1)], "ticker string, calendar_year int"))


def test_grid_results_come_only_from_files_with_all_columns(spark, tmp_path):
    head = ",".join(results.GRID_COLUMNS)
    (tmp_path / "a.csv").write_text(head + ",Frozen_Strict_Candidate\nset,20,0.1,-0.07,0.5,3,5%,2%,0.03,120,True\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.csv").write_text(head + "\nother,20,0.1,-0.07,0.5,2,nan,0.01,0.03,90\n")
    got = {r.Source_File: r for r in results.scan_grid_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.csv", "c.csv"}
    assert (got["a.csv"].Avg_Edge, got["a.csv"].Frozen_Strict_Candidate) == (0.05, True)
    assert (got["c.csv"].Avg_Edge, got["c.csv"].Frozen_Strict_Candidate) == (None, False)
    assert got["a.csv"].Source_Modified is not None


@pytest.mark.parametrize("fmt", results.FORMATS)
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    results.save(df, str(tmp_path / "out"), fmt)
    back = spark.read.format(fmt).option("header", "true").load(str(tmp_path / "out"))
    assert [(r.k, float(r.v)) for r in back.collect()] == [("a", 1.5)]


def test_csv_results_round_trip_and_bad_format(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    results.save(df, str(tmp_path / "r"), "csv")
    assert results.scan_results(spark, str(tmp_path / "r")).columns == ["k", "v"]
    assert not results.is_grid_result(df)
    with pytest.raises(ValueError):
        results.save(df, str(tmp_path / "r"), "xlsx")


def test_signal_json(spark, tmp_path):
    df = spark.createDataFrame([("AAA", 1)], "ticker string, x int").select("ticker", F.struct("x").alias("signal"))
    results.save_signals(df, str(tmp_path / "s"))
    text = next(pathlib.Path(tmp_path / "s" / "folder=AAA").glob("*.json")).read_text()
    assert json.loads(text) == {"ticker": "AAA", "signal": {"x": 1}}


def test_one_hot_key_keeps_its_last_row_and_combines_before_the_shuffle(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), (F.col("id") % 500).cast("string"))).alias("ticker"),
        F.lit("2026-06-16").cast("date").alias("date"),
        F.col("id").alias("ordinal"),
    )
    out = market.daily_unique(df, ["ticker"], "ordinal")
    rows = {r.ticker: r.ordinal for r in out.collect()}
    assert rows["HOT"] == 8997 and len(rows) == df.select("ticker").distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def standardized(spark, folder):
    raw = market.read_market_csv(spark, str(folder))
    texts = market.text_columns(raw, market.file_headers(raw))
    return market.typed_rows(texts, market.detect_date_orders(texts))


def test_columns_after_many_others(spark, tmp_path):
    others = ",".join(f"x{i}" for i in range(66))
    row = ",".join(["1"] * 66)
    (tmp_path / "WIDE.csv").write_text(f"{others},Date,Open,High,Low,Close,Volume\n{row},2026-01-05,1,2,1,2,9\n", encoding="utf-8")
    got = standardized(spark, tmp_path).collect()
    assert [(str(r["Date"]), r["Close"], r["Volume"]) for r in got] == [("2026-01-05", 2.0, 9.0)]


def test_same_file_name_in_two_folders(spark, tmp_path):
    for folder, text in (("a", "Date,Open,High,Low,Close,Volume\n2026-01-05,1,2,1,2,9\n"), ("b", "Close,Date,Open,High,Low,Volume\n7,2026-01-06,6,8,5,3\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "CTD.csv").write_text(text, encoding="utf-8")
    rows = standardized(spark, tmp_path)
    assert {(r["file"], str(r["Date"]), r["Close"]) for r in rows.collect()} == {("a/CTD.csv", "2026-01-05", 2.0), ("b/CTD.csv", "2026-01-06", 7.0)}
    assert {r["ticker"] for r in market.stock_table(rows).collect()} == {"CTD"}
    assert market.file_audit(market.read_market_csv(spark, str(tmp_path))).where("status = 'SUCCESS'").count() == 2


def test_dates_ambiguous_for_300_rows(spark, tmp_path):
    lines = [f"{1 + i % 12:02d}/{1 + i // 12 % 12:02d}/{2000 + i // 144},1,2,1,2,9" for i in range(320)] + ["02/25/2019,1,2,1,2,9"]
    (tmp_path / "LATE.csv").write_text("\n".join(["Date,Open,High,Low,Close,Volume", *lines]), encoding="utf-8")
    got = standardized(spark, tmp_path)
    assert {r["date_order"] for r in got.collect()} == {"monthfirst"} and got.where("Date IS NULL").count() == 0


def test_quoted_cells(spark):
    line = spark.range(1).select(market.split_cells(F.lit(',"a, b","say ""x""", c ,,"open'), ",").alias("cells")).first()
    assert line["cells"] == [None, "a, b", 'say "x"', "c", None, '"open']


def test_benchmark_is_one_row_per_day(spark):
    from barloom.operators.features import join_benchmark

    stock = spark.createDataFrame([("A", "2026-01-05", 1.0)], "ticker string, date string, close double")
    index = spark.createDataFrame([("x", "2026-01-05", 5.0), ("x", "2026-01-05", 6.0), ("y", "2026-01-05", 9.0)], "index_id string, date string, vn_close double")
    assert [r["vn_close"] for r in join_benchmark(stock, index, "x").collect()] == [6.0]
    assert join_benchmark(stock, index).count() == 1


# ---- lines to records ----------------------------------------------------------------------------


def blocks_of(text, size):
    """Physical lines with the part of the file they are read in, as a text scan gives them."""
    at, out = 0, []
    for n, line in enumerate(text.split("\n")):
        out.append((at // size, n, line))
        at += len(line) + 1
    return out


def cut(spark, files, size=40, small=10_000, **kinds):
    from barloom.sources.lines import parse_lines

    rows = [(name, (b, n), line) for name, text in files.items() for b, n, line in blocks_of(text, size)]
    lines = spark.createDataFrame(rows, "file string, ordinal struct<block:bigint,line:bigint>, text string").withColumn(
        "modified", F.lit(None).cast("timestamp"))
    got = parse_lines(lines.repartition(7), small).orderBy("file", "ordinal").collect()
    return {name: [r["cells"] for r in got if r["file"] == name] for name in files}


def local(text, separator=","):
    import csv
    import io

    return [[c.strip(" ") or None for c in row] for row in csv.reader(io.StringIO(text), delimiter=separator) if ",".join(row).strip()]


def test_records_over_many_lines_and_blocks_equal_a_local_parser(spark):
    import csv
    import io
    import random

    rng = random.Random(4)
    pieces = ["a", 'say "x"', "two\nlines", "\n\nthree", ",", "", 'ends"\n"', " b ", "1,5", "long " * 30]
    files = {}
    for k in range(12):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", delimiter=[",", ";", "\t", "|"][k % 4])
        writer.writerow(["h1", "h2", "h3"])
        for _ in range(rng.randint(0, 60)):
            writer.writerow([rng.choice(pieces) for _ in range(3)])
        files[f"f{k}"] = out.getvalue()
    for size in (7, 64, 100_000):
        got = cut(spark, files, size)
        for k in range(12):
            assert got[f"f{k}"] == local(files[f"f{k}"], [",", ";", "\t", "|"][k % 4])


def test_only_lines_at_block_borders_are_grouped_over_blocks(spark, monkeypatch):
    from barloom.sources import lines as module

    grouped, records, packed = [], module.records, module.packed
    monkeypatch.setattr(module, "packed", lambda *a: packed(*a, at_once=100))
    monkeypatch.setattr(module, "records", lambda told, *a: [grouped.append(told.cache()), records(grouped[-1], *a)][1])
    text = "a,b\n" + "".join(f'{k},"x{k}\n\ny, ""z"""\n' for k in range(300))
    got = cut(spark, {"f": text}, size=1000)["f"]
    assert got == local(text) and len(got) == 301
    n_blocks = len(text) // 1000 + 1
    # a block's first lines, up to one that tells the state from either start, and its last record
    assert 0 < grouped[0].count() <= 4 * n_blocks
    long = "a,b\n" + "plain,line\n" * 50 + '1,"open ' + "\n".join(f"l{k},m" for k in range(200)) + '"\n2,3\n'
    for size in (100, 100_000):  # a record over many blocks without a quote, or of more lines than are joined at once
        assert cut(spark, {"f": long}, size)["f"] == local(long)
    assert module.AT_ONCE < 200 and grouped[-1].count() > 1


def test_lines_without_a_block(spark):
    from barloom.sources.lines import parse_lines

    def parsed(*texts):
        lines = spark.createDataFrame(
            [("f", (None if t == "x,y" else 1, n), t, None) for n, t in enumerate(texts)],
            "file string, ordinal struct<block:bigint,line:bigint>, text string, modified timestamp")
        return [r["cells"] for r in parse_lines(lines).orderBy("ordinal").collect()]

    assert parsed("a,b", "x,y") == [["x", "y"], ["a", "b"]]
    assert parsed("a,b", "x,y", '1,"p', 'q"') == [["a", "b"], ["1", "p\nq"]]
    assert parsed("a,b", "x,y", '1,"p') == [["a", "b"], ["1", '"p']]


def test_packed_tables_leave_no_shuffle_files(spark):
    import time

    from barloom.session import packed, shuffles_dropped

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {p.name for d in manager.localDirs() for p in pathlib.Path(d.getPath()).glob("*/shuffle_*.data")}
    before = files()
    rounds = []
    count = lambda part: [rounds.append(part), part.groupBy("k").count()][1]
    rows = spark.range(1000).select(F.nullif(F.col("id") % 7, F.lit(3)).alias("k"))
    table = packed(rows, "counts", ["k"], 1000, count, at_once=400)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert len(rounds) == 3 and sum(part.count() for part in rounds) == 1000
    assert sum(r["count"] for r in table.collect()) == 1000 and table.count() == 7  # no group is in two rounds
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        1 / 0
    assert spark.conf.get(key) == was


def test_quotes_that_open_nothing(spark):
    files = {
        "inch": 'a,b\n5" pipe,"open, not closed\nx,y\n',  # the file ends inside a cell: lines are records
        "mid": 'a,b\n5" pipe,7"\nx,"q\nr"\n', "plain": "a,b\n\n1,2\n", "empty": "\n \n",
    }
    got = cut(spark, files, 9)
    assert got["inch"] == [["a", "b"], ['5" pipe', '"open', "not closed"], ["x", "y"]]
    assert got["mid"] == [["a", "b"], ['5" pipe', '7"'], ["x", "q\nr"]]
    assert got["plain"] == [["a", "b"], ["1", "2"]] and got["empty"] == []


def test_files_beyond_the_broadcast_are_salted(spark):
    files = {f"f{k}": f"a{k},b\n" + "1,\"x\ny\"\n" * (300 if k == 0 else 2) for k in range(6)}
    for small in (3, 100):
        assert cut(spark, files, 50, small) == {name: local(text) for name, text in files.items()}


def test_no_task_of_the_salted_join_holds_a_hot_file(spark):
    from barloom.operators.perfile import with_group

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 997).cast("string"))).alias("file"),
        F.struct(F.lit(0).alias("block"), F.col("id").alias("line")).alias("ordinal"))
    groups = rows.groupBy("file").agg(F.count("*").alias("n"), F.max("ordinal.line").alias("top"))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(before, ("8", "-1", "false")):
            spark.conf.set(key, value)
        joined = with_group(rows, groups, "file", "ordinal", small=5)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert joined.count() == 20_000 and joined.columns == ["file", "ordinal", "top"]
        assert max(sizes) <= 2 * 20_000 / 8
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_code_pages_without_a_session_setting(spark, tmp_path):
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    head = "Date,Open,High,Low,Last,KLGD,ghi chú\n2026-06-16,1,2,1,2,7,"
    (tmp_path / "A.csv").write_text("﻿" + head + "đổi €\n", encoding="utf-8")
    (tmp_path / "B.csv").write_bytes((head + "đô ăn Ưu\n").encode("cp1258"))
    (tmp_path / "C.csv").write_bytes((head + "Škoda žába\n").encode("cp1252"))
    (tmp_path / "D.csv").write_bytes((head + "ã ý \x81þ\n").encode("latin-1"))
    got = {r["file"]: r["cells"][6] for r in market.read_market_csv(spark, str(tmp_path)).orderBy("ordinal").collect()}
    assert got == {"A.csv": "đổi €", "B.csv": "đô ăn Ưu", "C.csv": "Škoda žába", "D.csv": "ã ý \x81þ"}
    assert standardized(spark, tmp_path).count() == 4


def test_quick_and_general_number_and_date_rules_agree(spark):
    from barloom.functions import dates, numbers

    texts = ["1", "-1", "1.5", "1,5", "1,50", "1,500", "1,5000", "1.500", "1.500.000", "-0", "2K", "2.5M", "-3.25B", "1,5K", "--", "", "5%",
             "007", "1.", ".5", "1e5", " 1", "−4", "(2)", "-(2)", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", numbers.parse_number("t").alias("a"), numbers._market_rules(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r
    days = ["2024-02-30", "2024-02-29", "0050-01-01", "31/12/2024", "12/31/2024", "1/2/24", "01-02-2024", "2024/1/5", "2024-01-05T00:00", "x", " 05/06/2020 ", None]
    for order in ("dayfirst", "monthfirst", "iso"):
        got = spark.createDataFrame([(d,) for d in days], "d string").select(
            "d", dates.parse_date(F.col("d"), F.lit(order)).alias("a"), dates._parse_any_date(F.col("d"), F.lit(order)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), got


def test_benchmarks_are_not_mixed(spark):
    from barloom.operators.features import join_benchmark

    days = [f"2026-01-0{d}" for d in range(1, 6)]
    stock = spark.createDataFrame([("A", d, 1.0) for d in days], "ticker string, date string, close double")
    rows = [("x", d, 5.0 + k, k) for k, d in enumerate(days)] + [("x", days[0], 4.0, 9)] + [("y", d, 50.0, 0) for d in days[:3]]
    index = spark.createDataFrame(rows, "index_id string, date string, vn_close double, seen int")
    joined = join_benchmark(stock, index, ordinal="seen").orderBy("date").collect()
    assert [r["vn_close"] for r in joined] == [4.0, 6.0, 7.0, 8.0, 9.0]  # x alone, the later of its two first days
    assert join_benchmark(stock, index, "y").count() == 3


def test_vendor_dates_of_many_shapes(spark):
    texts = {
        "iso": ["2026-06-16T00:00:00", "2026/6/16", "2026.06.16 15:30"], "day": ["16/06/2026", "05/06/2026"], "month": ["06/16/2026", "05/06/2026"],
        "open": ["05/06/2026"], "other": ["20260616", "Jun 16, 2026", "June 16 2026", "16-Jun-2026", "16 june 2026", "1781568000", "1781568000000"],
        "bad": ["soon", "2026-02-30", "31/31/2026", "", None],
    }
    rows = [(s, 1, json.dumps([{"date": t, "close": k} for k, t in enumerate(ts)])) for s, ts in texts.items()]
    df = spark.createDataFrame(rows, "symbol string, fetched_at int, body string")
    got = {(r["Symbol"], r["ordinal"]["pos"]): str(r["Date"]) for r in vendor.dated_records(df).collect()}
    day = "2026-06-16"
    assert [got["iso", k] for k in range(3)] == [day] * 3 and [got["other", k] for k in range(7)] == [day] * 7
    assert (got["day", 0], got["day", 1], got["month", 0], got["month", 1], got["open", 0]) == (day, "2026-06-05", day, "2026-05-06", "2026-05-06")
    bad = vendor.unreadable_dates(df).collect()
    assert {(r["Symbol"], r["pos"], r["date_text"]) for r in bad} == {("bad", k, t) for k, t in enumerate(texts["bad"])}
    # the other records of a symbol stay
    assert vendor.standardize_prices(df, "v").where("Symbol = 'day'").count() == 2


def test_refused_sheets_have_a_row(spark):
    from barloom.operators.statements import sheet_audit

    rows = [("good", 0, ["Chỉ tiêu", "Q1 2024", "Q2 2024", "Q3 2024", "Q4 2024"]), ("thin", 0, ["ITEMS", "Q1 2024", None]), ("thin", 1, ["a", "1", "2"]), ("none", 0, [])]
    found = {r["sheet"]: tuple(r)[1:] for r in sheet_audit(spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")).collect()}
    assert found == {"good": ("ok", 1, 4, 0), "thin": ("refused", 2, 1, None), "none": ("refused", 1, 0, None)}
