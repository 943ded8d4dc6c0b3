"""Run registered queries against their DuckDB statements and compare all values."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as registered  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def local_session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def normal(names, rows):
    """Columns and rows in one fixed order; negative zero reads as zero."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(row[i] + 0.0 if isinstance(row[i], float) else row[i] for i in order)
                   for row in rows],
                  key=lambda row: [(v is None, str(v)) for v in row])


def difference(spark: SparkSession, name: str, folder: str) -> str | None:
    frame = registered.queries()[name](spark, folder)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    names, rows = oracle_rows(registered.oracle_sql()[name], folder)
    want = normal(names, rows)
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for left, right in zip(got, want):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"{left} != {right}"
        for a, b in zip(left, right):
            if isinstance(a, Decimal) and a.as_tuple().exponent != b.as_tuple().exponent:
                return f"scale of {a} and {b}"
    return None


if __name__ == "__main__":
    session = local_session()
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(registered.queries())
    for query in wanted:
        start = time.time()
        try:
            problem = difference(session, query, folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {query} {time.time() - start:.2f}s"
              f"{'' if problem is None else ' ' + problem}", flush=True)
