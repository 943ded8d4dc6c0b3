"""Several reports of one roll from a cube of its closed labels.

The cube holds totals per combination of labels and cell: 24 combinations whatever the data,
so it stays small. It is written once. Every summary, and where its medians lie, follows
from the cube; a second scan brings the amounts of the middle cells of all reports together
and counts the documents. The roll is read twice, however many reports are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtatlas.functions.labels import debt_profile, entity_type, with_institutional_sector
from debtatlas.functions.money import WIDE_MONEY
from debtatlas.operators.distribution import (
    Handful, amounts_and_documents, cell_of, cell_totals, median_of, middle_cells)
from debtatlas.operators.macro import macro_report, moments
from debtatlas.operators.segments import (
    SELECTED, TOTAL, entity_report, profile_report, sector_report, summarise)
from debtatlas.session import settle

LABELS = ("tipo_pessoa", "perfil_divida", "esfera_institucional")
#: Reports by name, with the label they group by; the first has one group.
GROUPING = {"macro_metrics": None, "entity_summary": "tipo_pessoa",
            "profile_summary": "perfil_divida", "sector_summary": "esfera_institucional"}


def _labelled(silver: DataFrame) -> DataFrame:
    return with_institutional_sector(silver, LABELS[2]).select(
        "cpf_cnpj", SELECTED, TOTAL,
        entity_type(F.col("cpf_cnpj")).alias(LABELS[0]),
        debt_profile(F.col(SELECTED), F.col(TOTAL)).alias(LABELS[1]), LABELS[2])


def label_cube(silver: DataFrame) -> DataFrame:
    """Totals and moments per (entity type, debt profile, sector, cell), written once."""
    return settle(cell_totals(_labelled(silver), SELECTED, by=LABELS, carry=[TOTAL], extra=moments()))


def _middles(cube: DataFrame) -> DataFrame:
    """(relatorio, rotulo, cell, meio, lugar) of every report's groups."""
    found = []
    for report, label in GROUPING.items():
        by = [] if label is None else [label]
        cells = cube.groupBy(*by, "cell").agg(F.sum("com_valor").alias("com_valor"))
        found.append(middle_cells(cells, by).select(
            F.lit(report).alias("relatorio"),
            (F.lit("") if label is None else F.col(label)).alias("rotulo"), "cell", "meio", "lugar"))
    return reduce(DataFrame.unionAll, found)


def _per_report(amounts: DataFrame) -> DataFrame:
    """The amounts once for each report, under the label it groups by."""
    sides = F.array(*[F.struct(F.lit(report).alias("relatorio"),
                               (F.lit("") if label is None else F.col(label)).alias("rotulo"))
                      for report, label in GROUPING.items()])
    return (amounts.select(F.inline(sides), "cell", "valor", "n_valor")
            .groupBy("relatorio", "rotulo", "cell", "valor").agg(F.sum("n_valor").alias("n_valor")))


def portfolio_reports(silver: DataFrame) -> dict[str, DataFrame]:
    """``macro_metrics`` and the three segment summaries, from two scans in all.

    Each is what the operator of that name returns. NULL and equal amounts, empty rolls and
    labels without records are treated as there.
    """
    cube = label_cube(silver)
    middles = Handful(_middles(cube))
    amounts, documents = amounts_and_documents(
        _labelled(silver), SELECTED, "cpf_cnpj", middles.holds(cell_of(F.col(SELECTED))), LABELS)
    medians = settle(median_of(
        middles.attach(_per_report(amounts), ["relatorio", "rotulo", "cell"]), ["relatorio", "rotulo"]))

    def summary(report: str) -> DataFrame:
        label = GROUPING[report]
        own = (medians.filter(F.col("relatorio") == report)
               .select(F.col("rotulo").alias(label), "mediana"))
        return summarise(cube, own, label, [F.sum(TOTAL).cast(WIDE_MONEY).alias(TOTAL)])

    whole = medians.filter(F.col("relatorio") == "macro_metrics").agg(F.max("mediana").alias("mediana"))
    return {"macro_metrics": macro_report(cube, documents, whole),
            "entity_summary": entity_report(summary("entity_summary")),
            "profile_summary": profile_report(summary("profile_summary")),
            "sector_summary": sector_report(summary("sector_summary"))}


def portfolio_table(silver: DataFrame) -> DataFrame:
    """All four reports as one relation: ``relatorio`` names the report, ``rotulo`` the group
    (NULL for the whole roll); a statistic that a report does not have is NULL."""
    reports = portfolio_reports(silver)
    whole = reports["macro_metrics"].select(
        F.lit("macro_metrics").alias("relatorio"), F.lit(None).cast("string").alias("rotulo"),
        F.col("total_registros").alias("total_devedores"), "devedores_unicos",
        F.col("montante_total_fgts").alias("montante_fgts"),
        F.col("montante_divida_total_uniao").alias("montante_uniao"), "pct_fgts_sobre_total",
        "ticket_medio_fgts", "mediana_fgts", "menor_divida_fgts", "maior_divida_fgts",
        "desvio_padrao_fgts")
    parts = [reports[name].withColumnRenamed(label, "rotulo").withColumn("relatorio", F.lit(name))
             for name, label in GROUPING.items() if label is not None]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), [whole, *parts])
