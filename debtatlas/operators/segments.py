"""Segment reports: label rows, summarise per label, show shares of the portfolio."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.functions.labels import (
    PRIVATE_SECTOR, PUBLIC_SECTOR, debt_profile, entity_type, with_institutional_sector)
from debtatlas.functions.money import (
    MONEY, WIDE_MONEY, mean, percent_of, ratio, ratio_percent, round2)
from debtatlas.operators.distribution import cell_totals, exact_median
from debtatlas.session import settle

SELECTED = "valor_divida_selecionada"
TOTAL = "valor_total"


@dataclass(frozen=True)
class Measure:
    """A money column to summarise, and the ending of the names of its results."""

    column: str
    ending: str


FGTS, UNION = Measure(SELECTED, "fgts"), Measure(TOTAL, "uniao")
#: Which measure a row of stacked amounts belongs to.
MEASURE = "medida"


def summarise(cells: DataFrame, medians: DataFrame, label: str, extra: Sequence[Column] = (),
              measures: Sequence[Measure] = (FGTS,)) -> DataFrame:
    """Counts, sums, means and shares per label from totals of its parts.

    ``label`` has a short closed list of outcomes, so joining the medians and taking
    shares handles a few rows. With several measures the parts say in ``medida`` which one
    they are of; rows are counted once.
    """
    first, several = measures[0], len(measures) > 1

    def of(measure: Measure, column: str) -> Column:
        return F.when(F.col(MEASURE) == measure.ending, F.col(column)) if several else F.col(column)

    groups = cells.groupBy(label).agg(
        F.sum(of(first, "n")).alias("total_devedores"),
        *[part for m in measures for part in (
            F.sum(of(m, "soma")).cast(WIDE_MONEY).alias(f"montante_{m.ending}"),
            F.sum(of(m, "com_valor")).alias(f"com_valor_{m.ending}"),
            F.max(of(m, "maior")).cast(MONEY).alias(f"maior_divida_{m.ending}"))],
        *extra)
    if several:
        medians = medians.groupBy(label).agg(
            *[F.max(of(m, "mediana")).alias(f"mediana_{m.ending}") for m in measures])
    else:
        medians = medians.withColumnRenamed("mediana", f"mediana_{first.ending}")
    everyone = Window.partitionBy()

    def share(column: str) -> Column:
        return percent_of(F.col(column), F.sum(column).over(everyone))

    return (groups
            .join(F.broadcast(medians), label, "left")
            .withColumns({"pct_devedores": share("total_devedores")} | {
                name: value for m in measures for name, value in (
                    (f"pct_montante_{m.ending}", share(f"montante_{m.ending}")),
                    (f"ticket_medio_{m.ending}",
                     mean(F.col(f"montante_{m.ending}"), F.col(f"com_valor_{m.ending}"))))})
            .drop(*[f"com_valor_{m.ending}" for m in measures]))


def _stacked(rows: DataFrame, label: str, measures: Sequence[Measure]) -> DataFrame:
    """A row per record and measure: label, ``medida``, ``valor``."""
    return rows.select(label, F.inline(F.array(*[
        F.struct(F.lit(m.ending).alias(MEASURE), F.col(m.column).alias("valor"))
        for m in measures])))


def segment_summary(rows: DataFrame, label: str, carry: Sequence[str] = (),
                    measures: Sequence[Measure] = (FGTS,),
                    order: Sequence[Column] = ()) -> DataFrame:
    """Summary of labelled rows in two passes that shuffle a few thousand rows each:
    totals per label and cell, then the amounts in the cells of the medians.

    Several measures are stacked, so that both passes serve all of them; ``carry`` names
    columns of which only the sum is wanted. NULL amounts count as rows and in no statistic.
    """
    if len(measures) > 1:
        values, value, by = _stacked(rows, label, measures), "valor", [label, MEASURE]
        if carry:
            raise ValueError("sums of further columns come with one measure only")
    else:
        values, value, by = rows, measures[0].column, [label]
    cells = settle(cell_totals(values, value, by=by, carry=carry))
    medians = exact_median(values, value, cells, by)
    summary = summarise(cells, medians, label,
                        [F.sum(c).cast(WIDE_MONEY).alias(c) for c in carry], measures)
    return summary.orderBy(*order) if order else summary


# --- persons and companies -------------------------------------------------------

def entity_rows(silver: DataFrame) -> DataFrame:
    return silver.select(
        "cpf_cnpj", "nome_devedor", SELECTED, TOTAL,
        entity_type(F.col("cpf_cnpj")).alias("tipo_pessoa"))


def entity_report(summary: DataFrame) -> DataFrame:
    return (summary
            .select("tipo_pessoa", "total_devedores", "pct_devedores", "montante_fgts",
                    "pct_montante_fgts", "ticket_medio_fgts", "mediana_fgts",
                    "maior_divida_fgts")
            .orderBy(F.desc("montante_fgts")))


def entity_summary(silver: DataFrame) -> DataFrame:
    return entity_report(segment_summary(entity_rows(silver), "tipo_pessoa"))


# --- selected debt against total debt ---------------------------------------------

def debt_profile_rows(silver: DataFrame) -> DataFrame:
    selected, total = F.col(SELECTED), F.col(TOTAL)
    return silver.select(
        "cpf_cnpj", "nome_devedor", SELECTED, TOTAL,
        ratio_percent(selected, total).alias("pct_fgts"),
        debt_profile(selected, total).alias("perfil_divida"))


def profile_report(summary: DataFrame) -> DataFrame:
    return (summary
            .select("perfil_divida", "total_devedores", "pct_devedores", "montante_fgts",
                    "pct_montante_fgts", F.col(TOTAL).alias("montante_uniao"),
                    "ticket_medio_fgts", "mediana_fgts")
            .orderBy("perfil_divida"))


def profile_summary(silver: DataFrame) -> DataFrame:
    return profile_report(segment_summary(debt_profile_rows(silver), "perfil_divida", carry=[TOTAL]))


def profile_measures(silver: DataFrame) -> DataFrame:
    """The cohorts by selected and by total debt: every statistic, medians too, of both."""
    return segment_summary(debt_profile_rows(silver), "perfil_divida", measures=[FGTS, UNION],
                           order=[F.col("perfil_divida")])


# --- public and private sector -----------------------------------------------------

def sector_rows(silver: DataFrame) -> DataFrame:
    return with_institutional_sector(silver, "esfera_institucional").select(
        "cpf_cnpj", "nome_devedor", "nome_fantasia", SELECTED, TOTAL, "esfera_institucional")


def sector_report(summary: DataFrame) -> DataFrame:
    return (summary
            .select("esfera_institucional", "total_devedores", "pct_devedores",
                    "montante_fgts", "pct_montante_fgts",
                    F.col(TOTAL).alias("montante_uniao"), "ticket_medio_fgts",
                    "mediana_fgts", "maior_divida_fgts")
            .orderBy(F.desc("montante_fgts")))


def sector_summary(silver: DataFrame) -> DataFrame:
    return sector_report(segment_summary(sector_rows(silver), "esfera_institucional", carry=[TOTAL]))


def sector_measures(silver: DataFrame) -> DataFrame:
    """Both sectors by selected and by total debt, largest total debt first."""
    return segment_summary(sector_rows(silver), "esfera_institucional", measures=[FGTS, UNION],
                           order=[F.desc_nulls_last("montante_uniao")])


def sector_median_ratio(silver: DataFrame) -> DataFrame:
    """How many times the public median exceeds the private one: one row."""
    summary = segment_summary(sector_rows(silver), "esfera_institucional")

    def median_of(sector: str) -> Column:
        return F.max(F.when(F.col("esfera_institucional") == sector, F.col("mediana_fgts")))

    return (summary
            .agg(median_of(PUBLIC_SECTOR).alias("mediana_publica"),
                 median_of(PRIVATE_SECTOR).alias("mediana_privada"))
            .withColumn("razao_medianas",
                        round2(ratio(F.col("mediana_publica"), F.col("mediana_privada")))))


# --- members of a segment ------------------------------------------------------------

def segment_members(rows: DataFrame, label: str, outcome: str, k: int | None = None) -> DataFrame:
    """The debtors of one segment, largest first; with ``k`` only that many."""
    members = (rows
               .filter(F.col(label) == outcome)
               .orderBy(F.desc_nulls_last(SELECTED), F.asc_nulls_last("cpf_cnpj"),
                        F.asc_nulls_last("nome_devedor")))
    return members if k is None else members.limit(k)
