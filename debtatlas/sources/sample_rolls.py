"""Debtor rolls derived from the sales tables, for tests, checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtatlas.sources.roll_csv import DOCUMENT, NAME, SELECTED, TOTAL, TRADE_NAME

MONEY = "decimal(18,2)"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _brl(amount: Column) -> Column:
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def customer_roll(spark: SparkSession, folder: str) -> DataFrame:
    """Raw text roll: a record per customer with orders, in every document shape."""
    price = F.col("o_totalprice").cast(MONEY)
    owed = (_table(spark, folder, "orders")
            .groupBy("o_custkey")
            .agg(F.sum(price).alias("tot"),
                 F.sum(F.when((F.col("o_orderstatus") == "F") | (F.col("o_custkey") % 5 == 0),
                              price).otherwise(F.lit(0).cast(MONEY))).alias("sel")))
    rows = _table(spark, folder, "customer").join(owed, F.col("c_custkey") == F.col("o_custkey"))

    key = F.col("c_custkey")
    nine = F.lpad(key.cast("string"), 9, "0")
    root = F.lpad(F.expr("c_custkey div 2").cast("string"), 8, "0")
    branch = F.when(key % 2 == 1, "0002").when(key % 14 == 0, "0003").otherwise("0001")

    def part(text: Column, start: int, size: int) -> Column:
        return F.substring(text, start, size)

    document = (
        F.when(key % 97 == 0, F.lit("12345"))
        .when(key % 37 == 0, F.format_string("***.%s.%s-**", part(nine, 4, 3), part(nine, 7, 3)))
        .when(key % 41 == 0, F.format_string(
            "%s.%s.%s-00", part(nine, 1, 3), part(nine, 4, 3), part(nine, 7, 3)))
        .otherwise(F.format_string(
            " %s.%s.%s/%s-00 ", part(root, 1, 2), part(root, 3, 3), part(root, 6, 3), branch)))
    nation = F.col("c_nationkey")
    name = (F.when(nation == 3, F.concat(F.lit("Municipio de "), "c_name"))
            .when(nation == 5, F.concat(F.lit("MUNICÍPIO DE "), "c_name"))
            .otherwise(F.col("c_name")))
    trade_name = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "  ")
                  .when(nation == 7, "urbfor unit")
                  .otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))))
    return rows.select(
        document.alias(DOCUMENT),
        name.alias(NAME),
        trade_name.alias(TRADE_NAME),
        F.when(key % 101 == 0, "n/d").otherwise(_brl(F.col("tot"))).alias(TOTAL),
        F.when(key % 103 == 0, "").otherwise(_brl(F.col("sel"))).alias(SELECTED))


def line_roll(spark: SparkSession, folder: str) -> DataFrame:
    """Typed roll with a record per order line, for volume."""
    selected = F.col("l_extendedprice").cast(MONEY)
    return _table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("cpf_cnpj"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("nome_devedor"),
        F.nullif(F.trim(F.col("l_returnflag")), F.lit("")).alias("nome_fantasia"),
        (selected * F.col("l_linenumber")).cast(MONEY).alias("valor_total"),
        selected.alias("valor_divida_selecionada"))


def skewed_roll(spark: SparkSession, folder: str) -> DataFrame:
    """Typed roll with a record per order line on which few documents and amounts recur:
    a supplier is a company, the line number its establishment, the quantity its debt."""
    selected = F.col("l_quantity").cast(MONEY)
    return _table(spark, folder, "lineitem").select(
        F.format_string("%08d%04d00", F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long"))
        .alias("cpf_cnpj"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("nome_devedor"),
        F.nullif(F.trim(F.col("l_returnflag")), F.lit("")).alias("nome_fantasia"),
        (selected * F.col("l_linenumber")).cast(MONEY).alias("valor_total"),
        selected.alias("valor_divida_selecionada"))
