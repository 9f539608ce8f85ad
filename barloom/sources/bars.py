"""Market CSVs of any vendor to standardized bars, for a whole directory in one job.

Raw input is (file, ordinal, cells): one row per record, ordinal growing within a file, the
lowest ordinal being the header. Files differ in headers, language, number and date formats; each of
those is settled per file by small aggregates that combine before they shuffle, and joined back by
``perfile.with_group``, which does not gather a file in one task. The cells are written once and read
by each of these steps.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.dates import order_from_votes, order_votes, parse_date
from barloom.functions.numbers import parse_number
from barloom.functions.text import normalize_header
from barloom.operators.perfile import leading, least_rows, with_group
from barloom.session import written
from barloom.sources.lines import parse_lines, split_cells  # noqa: F401

# --- fixed values: target columns and the header names vendors use for them -----------------------

STOCK_COLUMNS = [
    "Date", "Open", "High", "Low", "Close", "Volume", "Change_Pct", "Net_Volume_Foreign",
    "Net_Value_Foreign", "Buy_Volume_Foreign", "Buy_Value_Foreign", "Sell_Volume_Foreign",
    "Sell_Value_Foreign", "Foreign_room_Remain", "Foreign_Ownership_Pct",
]
INDEX_COLUMNS = ["Date", "VN_Open", "VN_High", "VN_Low", "VN_Close", "VN_Volume", "VN_Change_Pct"]
HEADER_ALIASES = {
    "Date": ["Date", "TradingDate", "Ngày", "Ngay", "VN_Date", "time", "datetime", "Ngày giao dịch", "Ngay giao dich"],
    "Open": ["Open", "Open Price", "Mở", "Mo", "Gia mo cua", "Giá mở cửa", "VN_Open"],
    "High": ["High", "High Price", "Cao", "Gia cao nhat", "Giá cao nhất", "VN_High"],
    "Low": ["Low", "Low Price", "Thấp", "Thap", "Gia thap nhat", "Giá thấp nhất", "VN_Low"],
    "Close": [
        "Close", "Last", "Price", "Lần cuối", "Lan cuoi", "Đóng cửa", "Dong cua", "Giá đóng cửa",
        "Gia dong cua", "VN_Close",
    ],
    "Volume": [
        "Volume", "Vol.", "KL", "KLGD", "Khối lượng", "Khoi luong", "Khối lượng giao dịch",
        "Khoi luong giao dich", "VN_Volume",
    ],
    "Change_Pct": [
        "Change %", "% Change", "Change_Pct", "% Thay đổi", "% Thay doi", "Change", "Thay đổi %",
        "Thay doi %", "VN_Change_Pct",
    ],
    "Net_Volume_Foreign": [
        "Net_Volume_Foreign", "KLGD ròng", "KLGD rong", "NN mua/bán ròng", "NN mua ban rong",
        "Net Foreign Volume", "Foreign Net Volume",
    ],
    "Net_Value_Foreign": [
        "Net_Value_Foreign", "GTGD ròng", "GTGD rong", "GTGD NN ròng", "GTGD NN rong",
        "Net Foreign Value", "Foreign Net Value",
    ],
    "Buy_Volume_Foreign": ["Buy_Volume_Foreign", "NN mua", "Foreign Buy Volume"],
    "Buy_Value_Foreign": ["Buy_Value_Foreign", "GT NN mua", "GTGD NN mua", "Foreign Buy Value"],
    "Sell_Volume_Foreign": ["Sell_Volume_Foreign", "NN bán", "NN ban", "Foreign Sell Volume"],
    "Sell_Value_Foreign": [
        "Sell_Value_Foreign", "GT NN bán", "GT NN ban", "GTGD NN bán", "GTGD NN ban", "Foreign Sell Value",
    ],
    "Foreign_room_Remain": [
        "Foreign_room_Remain", "Room còn lại", "Room con lai", "Foreign Room Remaining",
        "Room NN còn lại", "Room NN con lai",
    ],
    "Foreign_Ownership_Pct": [
        "Foreign_Ownership_Pct", "Tỷ lệ sở hữu NN", "Ty le so huu NN", "Foreign Ownership %",
        "Foreign Ownership", "Sở hữu NN", "So huu NN",
    ],
}
INDEX_FILE_MARKS = ["VNINDEX", "VN30", "HNXINDEX"]
INDEX_HEADER_MARKS = ["vnopen", "vnhigh", "vnlow", "vnclose", "vnvolume", "vnchangepct", "vndate"]
STOCK_REQUIRED = ["Date", "Open", "High", "Low", "Close", "Volume"]
INDEX_REQUIRED = ["Date", "Open", "High", "Low", "Close"]

# --------------------------------------------------------------------------------------------------


def _strip_marks(text: str) -> str:
    """Python twin of ``normalize_header`` for the alias list."""
    key = text.strip().lower().replace("\ufeff", "").replace(".", "")
    return "".join(ch for ch in key if not ch.isspace() and ch not in "_-/")


def alias_map() -> Column:
    pairs = {_strip_marks(alias): name for name, aliases in HEADER_ALIASES.items() for alias in aliases}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def relative_to(path: str) -> Column:
    """The scanned file's path below ``path``: unique, and the plain name in a flat folder."""
    root = re.escape(path.split("://", 1)[-1].rstrip("/"))
    return F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{root}/(?=.)", "")


def file_name(file: Column | str = "file") -> Column:
    return F.regexp_extract(file, "[^/]*$", 0)


def read_market_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, modified, cells) of all CSVs below ``path``, cut by ``parse_lines``."""
    return parse_lines(spark.read.option("recursiveFileLookup", "true").text(path).select(
        relative_to(path).alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
        ).alias("ordinal"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ))


def file_headers(raw: DataFrame) -> DataFrame:
    """Per file: header ordinal, kind, cell positions of every target column and what is missing."""
    files = raw.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(leading(raw)).alias("least"))
    heads = least_rows(raw, files).groupBy("file").agg(
        F.max("n").alias("n"), F.min("ordinal").alias("first"), F.min_by("cells", "ordinal").alias("header")
    )
    lookup = alias_map()
    heads = heads.withColumn("keys", F.transform("header", lambda h: normalize_header(h))).withColumn(
        "names", F.transform("keys", lambda k: F.try_element_at(lookup, k))
    )
    targets = F.array(*[F.lit(n) for n in STOCK_COLUMNS])
    positions = F.transform(
        targets,
        lambda target: F.filter(
            F.transform("names", lambda n, i: F.when(n == target, i)), lambda i: i.isNotNull()
        ),
    )
    compact = F.regexp_replace(F.upper(F.regexp_replace(file_name(), r"\.[^.]*$", "")), r"[ _-]", "")
    named = F.lit(False)
    for mark in INDEX_FILE_MARKS:
        named = named | F.contains(compact, F.lit(mark))
    marks = F.array(*[F.lit(m) for m in INDEX_HEADER_MARKS])
    marked = F.arrays_overlap(F.filter("keys", lambda k: k.isNotNull()), marks)
    heads = heads.select(
        "file", "n", "first", "names", positions.alias("at"),
        F.when(named | marked, "vnindex").otherwise("stock").alias("kind"),
    )

    def lacking(required: list[str]) -> Column:
        return F.array_except(F.array(*[F.lit(n) for n in required]), "names")

    missing = F.when(F.col("kind") == "stock", lacking(STOCK_REQUIRED)).otherwise(lacking(INDEX_REQUIRED))
    # every data row meets these: the first two positions of a target, and all of them only where a target has more
    return heads.withColumns({
        "missing_required_columns": F.array_join(missing, ", "),
        "one": F.transform("at", lambda at: F.get(at, F.lit(0))),
        "two": F.transform("at", lambda at: F.get(at, F.lit(1))),
        "more": F.when(F.exists("at", lambda at: F.size(at) > 2), F.col("at")),
    }).drop("names", "at")


def text_columns(raw: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows with ``texts``, one entry per target column: the first non-null of the cells that
    map to it, left to right."""
    rows = with_group(raw, headers, "file", "ordinal").where(F.col("ordinal") > F.col("first"))

    def several(at: Column) -> Column:
        return F.get(F.filter(F.transform(at, lambda i: F.get("cells", i)), lambda t: t.isNotNull()), F.lit(0))

    def text(i: int) -> Column:
        one, two = (F.get("cells", F.get(at, F.lit(i))) for at in ("one", "two"))
        return F.when(F.col("more").isNull(), F.coalesce(one, two)).otherwise(several(F.get("more", F.lit(i))))

    texts = F.array(*[text(i) for i in range(len(STOCK_COLUMNS))])
    return rows.select("file", "ordinal", "kind", "missing_required_columns", texts.alias("texts"))


def date_text() -> Column:
    return F.get("texts", F.lit(0))


def detect_date_orders(texts: DataFrame) -> DataFrame:
    """Per file: iso, monthfirst or dayfirst, by the votes of all its dates. Votes are sums, which
    combine before the shuffle, so a file of any size sends one row per task."""
    votes = order_votes(F.col("text"))
    told = texts.select("file", date_text().alias("text")).select("file", "text", votes.alias("v"))
    return told.groupBy("file").agg(
        F.when(F.count("text") > 0, order_from_votes(F.sum("v.iso"), F.sum("v.first"), F.sum("v.second"))).alias("date_order"),
        F.count(F.lit(1)).alias("n"),
    )


def typed_rows(texts: DataFrame, orders: DataFrame) -> DataFrame:
    """Texts to dates and doubles. ``orders`` has a row for every file of ``texts``."""
    rows = with_group(texts, orders, "file", "ordinal")
    day = parse_date(date_text(), F.coalesce("date_order", F.lit("dayfirst")))
    return rows.select(
        "file", "ordinal", "kind", "missing_required_columns", "date_order", day.alias("Date"),
        *[parse_number(F.get("texts", F.lit(i)), "market").alias(n) for i, n in enumerate(STOCK_COLUMNS) if i],
    )


def has_core() -> Column:
    """Rows with date and prices; volume is required of stocks only."""
    core = F.lit(True)
    for name in INDEX_REQUIRED:
        core = core & F.col(name).isNotNull()
    return core & ((F.col("kind") != "stock") | F.col("Volume").isNotNull())


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the highest ordinal per key, as a combining aggregate: any number of duplicates
    of one key shrinks to one row per task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("row")).select(*keys, "row.*")


def daily_unique(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """At most one row per key and calendar day, which is what bounds every window group."""
    return keep_last(df.where("date IS NOT NULL"), [*keys, "date"], ordinal)


def clean_bars(typed: DataFrame) -> DataFrame:
    """Complete rows, one per file and date, the last one winning. Completeness is asked inside the aggregate: a filter
    would be pushed below the parsing and repeat it. Dates lead the keys because names may begin alike, which makes them slow to sort."""
    rest = [c for c in typed.columns if c not in ("file", "Date")]
    last = typed.groupBy("Date", "file").agg(F.max_by(F.struct(*rest), F.when(has_core(), F.col("ordinal"))).alias("row"))
    return last.where("row IS NOT NULL").select("file", "Date", "row.*")


def ohlc_invalid() -> Column:
    """High below, or low above, another price of the bar."""
    c = F.col
    return (c("High") < F.greatest("Open", "Close", "Low")) | (c("Low") > F.least("Open", "Close", "High"))


def standardize(raw: DataFrame) -> DataFrame:
    """Raw cells to typed, complete, de-duplicated bars of every file."""
    return clean_bars(typed_table(raw)[1])


def typed_table(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, typed rows) of raw cells, which are written first because each step reads them."""
    raw = written(raw.select("file", "ordinal", "cells"), "cells")
    headers = written(file_headers(raw), "headers")
    texts = text_columns(raw, headers)
    return headers, typed_rows(texts, written(detect_date_orders(texts), "orders"))


def stock_table(clean: DataFrame) -> DataFrame:
    """Stock bars under their target schema; the ticker is the file name's first part."""
    ticker = F.upper(F.regexp_extract(file_name(), r"^([^._]+)", 1))
    return clean.where("kind = 'stock'").select(ticker.alias("ticker"), *STOCK_COLUMNS)


def index_table(clean: DataFrame) -> DataFrame:
    """Benchmark bars under their ``VN_`` names."""
    names = [n if n == "Date" else n.removeprefix("VN_") for n in INDEX_COLUMNS]
    return clean.where("kind = 'vnindex'").select(
        F.col("file").alias("index_id"), *[F.col(n).alias(out) for n, out in zip(names, INDEX_COLUMNS)]
    )


def file_audit(raw: DataFrame) -> DataFrame:
    """One audit row per file, failed files included.

    One pass counts rows per (file, date) and picks the surviving bar; a second, small aggregation
    adds those up per file."""
    headers, typed = typed_table(raw)
    typed = typed.withColumn("core", has_core())
    bar = F.struct("High", "Low", "Open", "Close")
    days = typed.groupBy("Date", "file").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("core").cast("int")).alias("n_core"),
        F.max("date_order").alias("date_order"),
        F.max_by(bar, F.when(F.col("core"), F.col("ordinal"))).alias("bar"),
    ).select("file", "Date", "n", "n_core", "date_order", "bar.*")
    kept = F.col("n_core") > 0
    files = days.groupBy("file").agg(
        F.sum("n").alias("raw_rows"),
        F.sum("n_core").alias("core_rows"),
        F.count(F.when(kept, 1)).alias("clean_rows"),
        F.min(F.when(kept, F.col("Date"))).alias("date_min"),
        F.max(F.when(kept, F.col("Date"))).alias("date_max"),
        F.max("date_order").alias("date_order"),
        F.sum(F.when(kept & ohlc_invalid(), 1).otherwise(0)).alias("invalid"),
    )
    rows = headers.select("file", "kind", "missing_required_columns").join(files, "file", "left")
    c = F.col
    readable, clean = c("missing_required_columns") == "", F.coalesce("clean_rows", F.lit(0))
    return rows.select(
        "file",
        F.when(clean > 0, "SUCCESS").otherwise("FAILED").alias("status"),
        c("kind").alias("file_type"),
        F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"),
        clean.alias("clean_rows"),
        F.when(clean > 0, c("raw_rows") - clean).otherwise(0).alias("dropped_rows"),
        "date_min", "date_max",
        F.when(readable, c("date_order")).alias("date_order_detected"),
        "missing_required_columns",
        F.when(readable, c("raw_rows") - c("core_rows")).alias("dropped_missing_core_rows"),
        F.when(readable & (clean > 0), c("core_rows") - clean).alias("duplicate_dates_removed"),
        F.when(readable & (clean > 0), c("invalid")).alias("ohlc_invalid_rows"),
    )


def load_bars(df: DataFrame, benchmark: bool = False) -> DataFrame:
    """Already standardized table to what the feature stack reads: date, close, volume and, if
    present, net foreign volume; or the benchmark close. Text numbers use the loader dialect."""
    if benchmark and "VN_Date" in df.columns and "Date" not in df.columns:
        df = df.withColumnRenamed("VN_Date", "Date")
    required = ["Date", "VN_Close"] if benchmark else ["Date", "Close", "Volume"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    optional = [] if benchmark else [c for c in ("Net_Volume_Foreign",) if c in df.columns]
    keys = [c for c in df.columns if c.lower() == "ticker"]
    types = dict(df.dtypes)

    def number(name: str) -> Column:
        column = parse_number(name, "loader") if types[name] == "string" else F.col(name).cast("double")
        return column.alias(name.lower())

    day = parse_date(F.col("Date"), F.lit("iso")) if types["Date"] == "string" else F.col("Date").cast("date")
    return df.select(*keys, day.alias("date"), *[number(c) for c in required[1:] + optional]).where(
        "date IS NOT NULL"
    )


def bucketed_bars(spark: SparkSession, table: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars of a table written by ``results.save_bucketed``; naming tickers prunes the buckets read."""
    df = spark.table(table)
    return df if tickers is None else df.where(F.col("ticker").isin(tickers))


def ticker_bars(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Bars written with ``partitionBy('ticker')``; naming tickers prunes the folders read."""
    df = spark.read.parquet(path)
    return df if tickers is None else df.where(F.col("ticker").isin([t.upper() for t in tickers]))
