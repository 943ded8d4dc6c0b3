"""Command line: load an extract once, then ask for reports.

    python -m debtatlas ingest EXTRACT.csv WAREHOUSE
    python -m debtatlas report pareto_summary WAREHOUSE
    python -m debtatlas report entity_rows WAREHOUSE --out rows.parquet
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from debtatlas.plans.reports import REPORTS
from debtatlas.session import release, settle
from debtatlas.sources.catalog import publish_parquet, read_published
from debtatlas.sources.roll_csv import profile_raw, read_roll
from debtatlas.sources.staging import stage

SHOWN = 100


def ingest(spark: SparkSession, extract: str, warehouse: str) -> None:
    raw = publish_parquet(read_roll(spark, extract), f"{warehouse}/divida_fgts")
    publish_parquet(stage(raw), f"{warehouse}/stg_divida_fgts")
    profile_raw(raw).show(truncate=False)


def report(spark: SparkSession, name: str, warehouse: str, out: str | None = None,
           shown: int = SHOWN) -> None:
    """Write all rows of a report to ``out`` (Parquet, or CSV for a name in .csv), or show
    the first and say how many more there are."""
    silver = read_published(spark, f"{warehouse}/stg_divida_fgts")
    rows = REPORTS[name](silver)
    if out is not None:
        writer = rows.write.mode("overwrite")
        if out.endswith(".csv"):
            writer.option("header", True).csv(out)
        else:
            writer.parquet(out)
        print(f"all rows are in {out}")
    else:
        rows = settle(rows)
        rows.show(shown, truncate=False)
        left = rows.count() - shown
        if left > 0:
            print(f"{left} more rows; --out PATH writes all of them")
    release(spark)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="debtatlas")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("ingest", help="replace the raw and staging tables")
    load.add_argument("extract")
    load.add_argument("warehouse")
    ask = commands.add_parser("report", help="show one report")
    ask.add_argument("name", choices=sorted(REPORTS))
    ask.add_argument("warehouse")
    ask.add_argument("--out", help="write all rows there, as CSV if the name ends in .csv")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("debtatlas").getOrCreate()
    if chosen.command == "ingest":
        ingest(spark, chosen.extract, chosen.warehouse)
    else:
        report(spark, chosen.name, chosen.warehouse, chosen.out)


if __name__ == "__main__":
    main()
