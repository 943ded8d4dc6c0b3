"""The typed staging (silver) relation and the report on what its contract dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtatlas.functions.money import brl_sql, parse_brl
from debtatlas.sources.roll_csv import (
    DOCUMENT, NAME, SELECTED, TOTAL, TRADE_NAME)

STAGING_VIEW = "stg_divida_fgts"


def _raw(name: str):
    return F.col(f"`{name}`")


def _trimmed(name: str) -> str:
    return f"trim(`{name}`)"


#: The contract as SQL: each staging column and what it is made of.
CONTRACT = {
    "cpf_cnpj": _trimmed(DOCUMENT),
    "nome_devedor": _trimmed(NAME),
    "nome_fantasia": f"nullif({_trimmed(TRADE_NAME)}, '')",
    "valor_total": brl_sql(f"`{TOTAL}`"),
    "valor_divida_selecionada": brl_sql(f"`{SELECTED}`"),
}


def stage(raw: DataFrame) -> DataFrame:
    """Five typed columns: trimmed text, blank trade names as NULL, money as decimals."""
    return raw.selectExpr(*[f"{made} AS {name}" for name, made in CONTRACT.items()])


def staging_sql(table: str) -> str:
    """The contract as a statement over a raw table of the catalog."""
    columns = ", ".join(f"{made} AS {name}" for name, made in CONTRACT.items())
    return f"SELECT {columns} FROM {table}"


def create_staging_view(raw: DataFrame, name: str = STAGING_VIEW) -> DataFrame:
    """Register the staging relation for SQL users; nothing runs until it is read."""
    silver = stage(raw)
    silver.createOrReplaceTempView(name)
    return silver


def contract_report(raw: DataFrame) -> DataFrame:
    """Per money column: rows, blanks, amounts, and texts the contract turned into NULL."""
    def counts(name: str):
        text = _raw(name)
        blank = text.isNull() | (F.trim(text) == "")
        parsed = parse_brl(text).isNotNull()
        return F.struct(
            F.lit(name).alias("coluna"),
            F.count_if(blank).alias("em_branco"),
            F.count_if(parsed).alias("convertidos"),
            F.count_if(~blank & ~parsed).alias("rejeitados"))

    totals = raw.agg(F.count(F.lit(1)).alias("total_registros"),
                     F.array(counts(TOTAL), counts(SELECTED)).alias("colunas"))
    return (totals
            .select("total_registros", F.explode("colunas").alias("c"))
            .select("c.coluna", "total_registros", "c.em_branco", "c.convertidos",
                    "c.rejeitados"))
