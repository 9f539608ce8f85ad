"""Run registered queries on Spark and their SQL on DuckDB, compare values.

Usage: python tests/check_oracle.py [sf] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


#: no text of a table is this one, so that a null differs from an empty text
NULL = "<null>"


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        col = df[c]
        if str(col.dtype).startswith("datetime") or (col.dtype == object and col.notna().any()
                and hasattr(col.dropna().iloc[0], "isoformat")):
            col = pd.to_datetime(col).dt.strftime("%Y-%m-%d")
        elif col.dtype == bool or (col.dtype == object and col.notna().any()
                and isinstance(col.dropna().iloc[0], bool)):
            col = col.map(lambda x: None if x is None else str(bool(x)))
        elif pd.api.types.is_numeric_dtype(col):
            col = col.astype("float64")
        out[c] = col.where(col.notna(), None).map(lambda x: NULL if x is None else (repr(float(x)) if isinstance(x, (int, float)) else str(x)))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns differ: {sorted(set(spark_pdf.columns) ^ set(duck_pdf.columns))}"
    if len(spark_pdf) != len(duck_pdf):
        return f"row counts differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = {c: int((a[c] != b[c]).sum()) for c in a.columns if (a[c] != b[c]).any()}
    if bad:
        c = next(iter(bad))
        rows = a.index[a[c] != b[c]][:3]
        return f"values differ {bad}: {a.loc[rows].to_dict('records')} vs {b.loc[rows].to_dict('records')}"
    return "ok"


def main() -> int:
    from barloom.catalog import QUERIES
    from barloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        q = QUERIES[name]
        try:
            t0 = time.time()
            left = q.run(spark, sf_dir).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"{name:32s} rows-only {len(left):7d}  spark {t1 - t0:5.1f}s", flush=True)
                continue
            right = con.execute(q.oracle()).df()
            t2 = time.time()
            verdict = compare(left, right)
        except Exception as error:  # noqa: BLE001
            verdict, t0, t1, t2, left = f"ERROR {str(error)[:1500]}", 0, 0, 0, []
        failed += verdict != "ok"
        print(f"{name:32s} {verdict[:1800]}  rows {len(left)}  spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s", flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
