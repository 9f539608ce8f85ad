"""Registered queries: number dialects, dates, raw market tables, vendor payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.catalog.base import BARS, bars, cents, query, table, trades
from barloom.functions.dates import parse_date
from barloom.functions.numbers import is_close, parse_number, safe_float, strict_bool, value_matches
from barloom.functions.text import clean_account_name, normalize_header, normalize_text
from barloom.session import packed, written
from barloom.sources import bars as market
from barloom.sources import vendor

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


# ---- number texts in nine vendor styles ----------------------------------------------------------


def number_texts(spark, sf_dir):
    c = cents()
    th = (F.floor(c / 100000)).cast("bigint").cast("string")
    hu = F.lpad((F.floor(c / 100) % 1000).cast("bigint").cast("string"), 3, "0")
    fr = F.lpad((c % 100).cast("string"), 2, "0")
    style = ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).cast("int")
    text = (
        F.when(style == 0, F.concat(th, F.lit(","), hu, F.lit("."), fr))
        .when(style == 1, F.concat(th, F.lit("."), hu, F.lit(","), fr))
        .when(style == 2, F.concat(F.lit("("), th, F.lit(","), hu, F.lit("."), fr, F.lit(")")))
        .when(style == 3, F.concat(th, F.lit("."), fr, F.lit("K")))
        .when(style == 4, F.concat(th, F.lit(","), fr, F.lit("%")))
        .when(style == 5, F.concat(F.lit("-"), th, F.lit("."), fr, F.lit("M")))
        .when(style == 7, F.concat(th, F.lit(","), fr))
        .when(style == 8, F.concat(th, F.lit("K%")))
        .otherwise("--")
    )
    return table(spark, sf_dir, "lineitem").select(*KEY, text.alias("num_text"))


_NUMBER_SQL = f"""SELECT {", ".join(KEY)}, num_text, CASE s {{cases}} END AS value FROM (
  SELECT *, CASE s WHEN 0 THEN concat(th, ',', hu, '.', fr) WHEN 1 THEN concat(th, '.', hu, ',', fr)
    WHEN 2 THEN concat('(', th, ',', hu, '.', fr, ')') WHEN 3 THEN concat(th, '.', fr, 'K')
    WHEN 4 THEN concat(th, ',', fr, '%') WHEN 5 THEN concat('-', th, '.', fr, 'M')
    WHEN 7 THEN concat(th, ',', fr) WHEN 8 THEN concat(th, 'K%') ELSE '--' END AS num_text,
    CAST(concat(th, hu, '.', fr) AS double) AS plain, CAST(concat(th, '.', fr) AS double) AS short
  FROM (SELECT {", ".join(KEY)}, (l_orderkey + l_linenumber) % 9 AS s, CAST(c // 100000 AS varchar) AS th,
      lpad(CAST(c // 100 % 1000 AS varchar), 3, '0') AS hu, lpad(CAST(c % 100 AS varchar), 2, '0') AS fr
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS bigint) AS c FROM lineitem) a) b) d"""

_NUMBER_CASES = {
    "market": """WHEN 0 THEN plain WHEN 1 THEN plain WHEN 2 THEN -plain WHEN 3 THEN short * 1000
      WHEN 4 THEN short / 100 WHEN 5 THEN -short * 1000000
      WHEN 7 THEN short WHEN 8 THEN CAST(th AS double) * 1000 / 100""",
    "loader": """WHEN 0 THEN plain WHEN 1 THEN CAST(concat(th, '.', hu, fr) AS double) WHEN 3 THEN short * 1000
      WHEN 4 THEN CAST(concat(th, fr) AS double) * CAST(0.01 AS double) WHEN 5 THEN -short * 1000000
      WHEN 7 THEN CAST(concat(th, fr) AS double)""",
    "statement": """WHEN 0 THEN plain WHEN 1 THEN CAST(concat(th, '.', hu, fr) AS double) WHEN 2 THEN -plain
      WHEN 7 THEN CAST(concat(th, fr) AS double)""",
}


def _register_number(dialect: str) -> None:
    @query(f"parse_number_{dialect}", _NUMBER_SQL.format(cases=_NUMBER_CASES[dialect]))
    def build(spark, sf_dir):
        return number_texts(spark, sf_dir).withColumn("value", parse_number("num_text", dialect))


for _dialect in _NUMBER_CASES:
    _register_number(_dialect)


@query(
    "report_cells",
    f"""SELECT {", ".join(KEY)}, CASE WHEN l_linenumber % 3 = 0 THEN l_discount
    WHEN l_linenumber % 3 = 1 THEN l_tax END AS number,
  l_returnflag = 'N' AS flag, abs(l_tax - 0.04) <= 1e-9 AS same_tax,
  abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 AS close_discount
FROM lineitem""",
    {"number": 6},
)
def report_cells(spark, sf_dir):
    """Percent and null-word texts to numbers, truth texts to booleans, tolerant matches."""
    line = F.col("l_linenumber") % 3
    text = (
        F.when(line == 0, F.concat((F.round(F.col("l_discount") * 100)).cast("int").cast("string"), F.lit("%")))
        .when(line == 1, F.concat(F.lit(" "), F.col("l_tax").cast("string")))
        .otherwise("None")
    )
    word = F.when(F.col("l_returnflag") == "N", F.when(line == 0, " Yes ").when(line == 1, "TRUE").otherwise("1"))
    return table(spark, sf_dir, "lineitem").select(
        *KEY,
        safe_float(text).alias("number"),
        strict_bool(F.coalesce(word, F.lit("no"))).alias("flag"),
        value_matches(F.col("l_tax"), 0.04).alias("same_tax"),
        is_close(F.col("l_discount"), 0.05).alias("close_discount"),
    )


@query(
    "normalize_text",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(lower(text), 'đ', 'd')), '\p{Mn}+', '', 'g'),
    '[^a-z0-9]+', ' ', 'g')) AS normalized, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) AS cleaned FROM documents""",
)
def normalize_text_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", normalize_text("text").alias("normalized"), clean_account_name("text").alias("cleaned")
    )


@query(
    "normalize_header",
    r"SELECT page_id, regexp_replace(replace(lower(trim(url)), '.', ''), '[\s_\-/]+', '', 'g') AS header FROM pages",
)
def normalize_header_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_header("url").alias("header"))


# ---- raw market tables: one "file" per ticker, three date orders, two header languages -----------


def _date_style():
    return F.substring("ticker", 7, 9).cast("int") % 3


def raw_rows(spark, sf_dir):
    """(file, ordinal, cells) with a header row per file and duplicate, incomplete and invalid rows."""
    t = trades(spark, sf_dir)
    types = dict(t.dtypes)
    t = t.withColumns({"c": cents(), "day": F.col("l_shipdate").cast("date").cast("string")})
    c, day = F.col("c"), F.col("day")
    yy, mm, dd = F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2)
    style = _date_style()
    date_text = (
        F.when(style == 0, F.concat_ws("/", dd, mm, yy))
        .when(style == 1, F.concat_ws("/", mm, dd, yy))
        .otherwise(F.concat_ws("-", yy, mm, dd))
    )
    line = F.col("l_orderkey") + F.col("l_linenumber")

    def price(offset: int):
        value = c + offset
        whole, rest = F.floor(value / 100).cast("bigint").cast("string"), F.lpad((value % 100).cast("string"), 2, "0")
        return F.when(line % 2 == 0, F.concat(whole, F.lit("."), rest)).otherwise(
            F.concat(whole, F.lit(","), rest)
        )

    opened = F.when(line % 13 == 0, "--").otherwise(price(0))
    low = F.when(line % 11 == 0, price(50)).otherwise(price(-300))
    last = F.when(line % 5 == 0, F.lit(None)).otherwise(price(-100))
    volume = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".00K"))
    ordinal = F.struct(*[F.col(k) for k in KEY])
    body = t.select(
        F.col("ticker").alias("file"), ordinal.alias("ordinal"),
        F.array(date_text, opened, price(400), low, last, price(-100), volume).alias("cells"),
    )
    zero = F.struct(
        F.lit(0).cast("bigint").alias("l_orderkey"),
        *[F.lit(0).cast(types[k]).alias(k) for k in KEY[1:]],
    )
    names = ["Ngày", "Giá mở cửa", "Cao", "Thấp", "Lần cuối", "Đóng cửa", "Khối lượng"]
    english = ["Trading_Date", "Open Price", "HIGH", "low", "Last", "Close", "Vol."]
    local = F.array(*[F.lit(n) for n in names])
    other = F.array(*[F.lit(n) for n in english])
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    heads = files.select(
        F.col("ticker").alias("file"), zero.alias("ordinal"),
        F.when(_date_style() == 1, other).otherwise(local).alias("cells"),
    )
    return body.unionByName(heads)


RAW = f"""raw AS (
  SELECT p_brand AS file, CAST(l_shipdate AS date) AS d, ({", ".join(KEY)}) AS ordinal,
    l_orderkey + l_linenumber AS line, CAST(round(l_extendedprice*100) AS bigint) AS c,
    CAST(substr(p_brand, 7) AS int) % 3 AS style, l_quantity * 1000 AS volume,
    CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 50 ELSE -300 END AS low_offset
  FROM lineitem JOIN part ON l_partkey = p_partkey),
clean AS (
  SELECT file, d, max_by({{'c': c, 'low': c + low_offset, 'v': volume}}, ordinal) AS x, count(*) AS n
  FROM raw WHERE line % 13 <> 0 GROUP BY file, d),
votes AS (
  SELECT file, CASE WHEN iso > first AND iso > second THEN 'iso' WHEN second > first THEN 'monthfirst'
    ELSE 'dayfirst' END AS date_order
  FROM (SELECT file, sum(CASE WHEN style = 2 THEN 1 ELSE 0 END) AS iso,
      sum(CASE WHEN style = 0 AND day(d) > 12 OR style = 1 AND month(d) > 12 THEN 1 ELSE 0 END) AS first,
      sum(CASE WHEN style = 0 AND month(d) > 12 OR style = 1 AND day(d) > 12 THEN 1 ELSE 0 END) AS second
    FROM raw GROUP BY file) counts)"""


@query("date_order_detect", f"WITH {RAW} SELECT file, date_order FROM votes")
def date_order_detect(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    return market.detect_date_orders(market.text_columns(raw, market.file_headers(raw))).drop("n")


@query(
    "parse_dates",
    f"""WITH {RAW} SELECT file, CASE style WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%m/%d/%Y')
  ELSE strftime(d, '%Y-%m-%d') END AS text, d AS date, count(*) AS n FROM raw GROUP BY ALL""",
)
def parse_dates(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    texts = market.text_columns(raw, market.file_headers(raw))
    orders = market.detect_date_orders(texts)
    return (
        texts.join(orders.drop("n"), "file")
        .select("file", market.date_text().alias("text"), parse_date(market.date_text(), F.col("date_order")).alias("date"))
        .groupBy("file", "text", "date").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "market_standardize",
    f"""WITH {RAW} SELECT upper(file) AS ticker, d AS Date, x.c / 100.0 AS Open, (x.c + 400) / 100.0 AS High,
  x.low / 100.0 AS Low, (x.c - 100) / 100.0 AS Close, x.v AS Volume FROM clean""",
)
def market_standardize(spark, sf_dir):
    clean = market.stock_table(market.standardize(raw_rows(spark, sf_dir)))
    return clean.select("ticker", "Date", "Open", "High", "Low", "Close", "Volume")


@query(
    "index_standardize",
    f"""WITH {RAW} SELECT 'VNINDEX_' || file AS index_id, d AS Date, x.c / 100.0 AS VN_Open, (x.c + 400) / 100.0 AS VN_High,
  x.low / 100.0 AS VN_Low, (x.c - 100) / 100.0 AS VN_Close, x.v AS VN_Volume FROM clean""",
)
def index_standardize(spark, sf_dir):
    raw = raw_rows(spark, sf_dir).withColumn("file", F.concat(F.lit("VNINDEX_"), "file"))
    return market.index_table(market.standardize(raw)).drop("VN_Change_Pct")


@query(
    "ohlc_invalid_audit",
    f"""WITH {RAW} SELECT file, CAST(sum(CASE WHEN x.low > least(x.c, x.c - 100) THEN 1 ELSE 0 END) AS bigint) AS invalid_rows,
  count(*) AS rows FROM clean GROUP BY file""",
)
def ohlc_invalid_audit(spark, sf_dir):
    clean = market.standardize(raw_rows(spark, sf_dir))
    return clean.groupBy("file").agg(
        F.sum(market.ohlc_invalid().cast("int")).alias("invalid_rows"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "file_audit",
    f"""WITH {RAW}, lines AS (SELECT file, count(*) AS raw_rows,
  CAST(sum(CASE WHEN line % 13 = 0 THEN 1 ELSE 0 END) AS bigint) AS incomplete FROM raw GROUP BY file),
done AS (SELECT file, count(*) AS clean_rows, min(d) AS date_min, max(d) AS date_max,
  CAST(sum(CASE WHEN x.low > least(x.c, x.c - 100) THEN 1 ELSE 0 END) AS bigint) AS bad FROM clean GROUP BY file)
SELECT file, 'SUCCESS' AS status, 'stock' AS file_type, raw_rows, clean_rows, raw_rows - clean_rows AS dropped_rows,
  date_min, date_max, date_order AS date_order_detected, '' AS missing_required_columns,
  incomplete AS dropped_missing_core_rows, raw_rows - incomplete - clean_rows AS duplicate_dates_removed,
  bad AS ohlc_invalid_rows
FROM lines JOIN done USING (file) JOIN votes USING (file)""",
)
def file_audit(spark, sf_dir):
    return market.file_audit(raw_rows(spark, sf_dir))


# ---- text files: records over several lines, code pages ------------------------------------------


def _text_lines(rows, text, place, broken=None):
    """(file, ordinal, text, modified): a row's text cut at its line breaks, ``block`` being the part of the file it lies in.
    The lines of a ``broken`` row but the first lie in the next part."""
    block = F.col("block") if broken is None else F.col("block") + (broken & (F.col("part") > 0)).cast("int")
    return rows.select("*", F.posexplode(F.split(text, "\n")).alias("part", "text")).select(
        "file", F.struct(block.alias("block"), F.struct(*place, F.col("part")).alias("line")).alias("ordinal"), "text",
        F.lit(None).cast("timestamp").alias("modified"),
    )


@query(
    "raw_csv_scan",
    """SELECT p_brand AS file, CAST(l_orderkey AS varchar) || ':' || l_linenumber AS a,
  CASE WHEN l_quantity % 3 = 0 THEN 'note "' || l_returnflag || '",' || chr(10) || chr(10) || 'next ' || l_linestatus
    WHEN l_quantity % 3 = 1 THEN 'ends' || chr(10) ELSE CAST(CAST(round(l_extendedprice * 100) AS bigint) AS varchar) || '" wide' END AS b, l_returnflag AS c
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def raw_csv_scan(spark, sf_dir):
    """Quoted cells with separators, doubled quotes and line breaks, a file per ticker, its blocks cut anywhere."""
    separator = F.when(F.substring("file", 7, 9).cast("int") % 2 == 0, ";").otherwise(",")
    third = F.col("third")
    cell = (
        F.when(third == 0, F.concat(F.lit('"note ""'), "l_returnflag", F.lit('"",\n\nnext '), "l_linestatus", F.lit('"')))
        .when(third == 1, F.lit('"ends\n"'))
        .otherwise(F.concat(cents().cast("string"), F.lit('" wide')))
    )
    text = F.concat(F.concat_ws(":", "l_orderkey", "l_linenumber"), separator, cell, separator, "l_returnflag")
    rows = trades(spark, sf_dir).select(
        F.col("ticker").alias("file"), *KEY, (F.col("l_quantity") % 3).cast("int").alias("third"), "l_returnflag", "l_linestatus",
        (F.floor(F.col("l_orderkey") / 1000) * 2).alias("block"),
    ).where("file is not null and block is not null")
    rows = packed(rows, "rows", ["l_partkey"], table(spark, sf_dir, "lineitem").count())
    in_order = Window.partitionBy("block", "file").orderBy(*KEY)

    def body(rows):
        rows = rows.withColumn("nth", F.dense_rank().over(in_order))
        # the last record of a block lies in two, if it has several lines
        last = F.max("nth").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return _text_lines(rows.withColumn("last", last), text, [F.col("nth")], F.col("nth") == F.col("last"))

    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file")).distinct()
    heads = files.select("file", F.lit(-1).cast("bigint").alias("block"), separator.alias("sep"), F.lit(0).alias("nth"))
    head = _text_lines(heads, F.concat(F.lit("a"), "sep", F.lit('"b\n(text)"'), "sep", F.lit("c")), [F.col("nth")])
    lines = packed(rows, "lines", ["block", "file"], rows.count(), body).unionByName(written(head, "heads"))
    cells = market.parse_lines(lines)
    # as a generator: a filter would be pushed below the cutting and repeat it
    cells = cells.select("file", F.explode(F.filter(F.array("cells"), lambda c: F.get(c, F.lit(0)) != "a")).alias("cells"))
    return cells.select("file", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate("abc")])


_PLAIN_TEXT = r"regexp_replace(coalesce(text, ''), '[\x00-\x1F;,|\"\x7F-\x9F]+', ' ', 'g')"


@query(
    "encoded_lines",
    f"""SELECT lang AS file, CAST(doc_id AS varchar) AS id, nullif(trim(CASE lang WHEN 'en' THEN t ELSE regexp_replace(t, '[^\x00-\xFF]', '?', 'g') END), '') AS text
FROM (SELECT doc_id, lang, {_PLAIN_TEXT} AS t FROM documents) d WHERE lang IN ('en', 'fr', 'de', 'es')""",
)
def encoded_lines(spark, sf_dir):
    """Whole texts as lines of a file per language: UTF-8, Windows-1258, Windows-1252 and Latin-1, told apart by their bytes."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r'[\x00-\x1F;,|"\x7F-\x9F]+', " ")
    docs = table(spark, sf_dir, "documents").where("lang in ('en', 'fr', 'de', 'es')").select("doc_id", "lang", plain.alias("t"))
    line = F.concat(F.col("doc_id").cast("string"), F.lit(";"), "t")
    latin = F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(";"), F.regexp_replace("t", r"[^\x00-\xFF]", "?")), "ISO-8859-1")
    ordinal = lambda block, n: F.struct(F.lit(block).alias("block"), n.cast("bigint").alias("line")).alias("ordinal")
    body = docs.select(
        F.col("lang").alias("file"), ordinal(1, F.col("doc_id")), F.when(F.col("lang") == "en", F.encode(line, "UTF-8")).otherwise(latin).alias("bytes"))
    # fixed values: a byte that only the page meant, or none before it, knows
    marks = {"en": "", "fr": "E9", "de": "9A", "es": "81"}
    heads = docs.select("lang").distinct().select(
        F.col("lang").alias("file"), ordinal(0, F.lit(0)),
        F.concat(F.encode(F.lit("id;text "), "UTF-8"), F.unhex(F.create_map(*[F.lit(x) for p in marks.items() for x in p])[F.col("lang")])).alias("bytes"))
    lines = body.unionByName(heads).select("file", "ordinal", F.col("bytes").cast("string").alias("text"), F.lit(None).cast("timestamp").alias("modified"))
    cells = market.parse_lines(lines).where("ordinal.block = 1")
    return cells.select("file", F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("text"))


@query(
    "bars_dedup_keep_last",
    f"""SELECT p_brand AS ticker, CAST(l_shipdate AS date) AS date, max_by(l_extendedprice, ({", ".join(KEY)})) AS price,
  max_by(l_quantity, ({", ".join(KEY)})) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def bars_dedup_keep_last(spark, sf_dir):
    rows = trades(spark, sf_dir).select(
        "ticker", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("volume"), F.struct(*KEY).alias("ordinal"),
    )
    return market.daily_unique(rows, ["ticker"], "ordinal").drop("ordinal")


@query(
    "load_bars",
    f"WITH {BARS} SELECT ticker, date, close, volume, net_volume_foreign FROM bars",
)
def load_bars(spark, sf_dir):
    """A standardized table whose numbers are texts, read back by the loader dialect."""
    b = bars(spark, sf_dir)
    text = b.select(
        "ticker", F.date_format("date", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit(" "), F.col("close").cast("string")).alias("Close"), F.format_string("%,.1f", "volume").alias("Volume"),
        F.col("net_volume_foreign").cast("string").alias("Net_Volume_Foreign"),
    )
    return market.load_bars(text)


# ---- vendor payloads: one JSON document per bar, in five shapes, with a superseded record ---------


def payloads(spark, sf_dir):
    b = bars(spark, sf_dir)

    # a ticker's vendor writes dates in one of seven shapes
    shapes = [
        F.date_format("date", "yyyy-MM-dd'T'00:00:00"), F.date_format("date", "dd/MM/yyyy"), F.date_format("date", "MM/dd/yyyy 15:30"),
        F.date_format("date", "yyyyMMdd"), F.date_format("date", "MMM d, yyyy"), F.date_format("date", "dd-MMM-yyyy"),
        (F.unix_date("date").cast("bigint") * 86400000).cast("string"),
    ]
    day = F.get(F.array(*shapes), F.substring("ticker", 7, 9).cast("int") % len(shapes))

    def record(cap, day=day):
        return F.to_json(
            F.struct(
                day.alias("date"),
                F.col("close"), F.col("high"), F.col("low"), F.col("volume"),
                cap.alias("marketCap"),
            )
        )

    items = F.concat(
        F.lit("["), record(F.col("volume")), F.lit(", "), record(F.col("volume") * 2000000),
        F.when(F.dayofmonth("date") % 7 == 0, F.concat(F.lit(", "), record(F.col("volume"), F.lit("soon")))).otherwise(""), F.lit("]")
    )
    shape = F.dayofmonth("date") % 5
    body = (
        F.when(shape == 0, items)
        .when(shape == 1, F.concat(F.lit('{"data": '), items, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"status": 1, "prices": '), items, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"data": {"items": '), items, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"message": "none"'), F.lit("}")))
    )
    return b.select(F.col("ticker").alias("symbol"), F.lit(1).alias("fetched_at"), body.alias("body"))


@query(
    "vendor_prices",
    f"""WITH {BARS} SELECT date AS Date, ticker AS Symbol, close AS Close, high AS High, low AS Low, volume AS Volume,
  volume * 2000000 AS MarketCap, volume * 2000000 / 1e9 AS MarketCap_TyDong, 'landing' AS Vendor
FROM bars WHERE day(date) % 5 <> 4""",
)
def vendor_prices(spark, sf_dir):
    return vendor.standardize_prices(payloads(spark, sf_dir), "landing").drop("Open")


@query(
    "vendor_unreadable",
    f"WITH {BARS} SELECT ticker AS symbol, count(*) AS payloads FROM bars WHERE day(date) % 5 = 4 GROUP BY 1",
)
def vendor_unreadable(spark, sf_dir):
    bad = vendor.unreadable_payloads(payloads(spark, sf_dir))
    return bad.groupBy("symbol").agg(F.count(F.lit(1)).alias("payloads"))


@query(
    "vendor_unreadable_dates",
    f"""WITH {BARS} SELECT ticker AS Symbol, 'soon' AS date_text, count(*) AS records FROM bars
WHERE day(date) % 7 = 0 AND day(date) % 5 <> 4 GROUP BY 1""",
)
def vendor_unreadable_dates(spark, sf_dir):
    bad = vendor.unreadable_dates(payloads(spark, sf_dir))
    return bad.groupBy("Symbol", "date_text").agg(F.count(F.lit(1)).alias("records"))


@query(
    "market_cap_scan",
    f"""WITH {BARS}, caps AS (SELECT ticker, date, close, close * 1000000 AS market_cap FROM bars)
SELECT upper(ticker) AS ticker, median(market_cap) AS median_market_cap,
  CASE WHEN median(market_cap) < 1e9 THEN 'review' ELSE 'ok' END AS status FROM caps GROUP BY 1""",
    {"median_market_cap": 0},
)
def market_cap_scan(spark, sf_dir):
    raw = bars(spark, sf_dir).select(
        F.col("ticker").alias("symbol"), F.col("date"), F.col("close"),
        (F.col("close") * 1000000).alias("marketCapitalization"),
    )
    return vendor.market_cap_check(vendor.scan_market_cap(raw, "close"))
