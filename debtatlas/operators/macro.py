"""Portfolio metrics in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.functions.money import MONEY, WIDE_MONEY, mean, ratio, ratio_percent, round2
from debtatlas.operators.distribution import (
    Handful, amounts_and_documents, cell_of, cell_totals, median_of, middle_cells)
from debtatlas.session import settle

SELECTED = "valor_divida_selecionada"


def moments() -> list[Column]:
    """What the bounds and the spread take from each part of the roll."""
    amount = F.col(SELECTED)
    return [F.min(amount).alias("menor"), F.avg(amount.cast("double")).alias("media"),
            F.var_pop(amount).alias("variancia")]


def macro_metrics(silver: DataFrame) -> DataFrame:
    """Counts, sums, share, mean, median, bounds and spread of the whole roll.

    One pass takes totals per cell, from which all but two columns follow. A second one
    sends the documents, to be counted once each, and the amounts of the median's cell.
    """
    cells = settle(cell_totals(silver, SELECTED, carry=["valor_total"], extra=moments()))
    middles = Handful(middle_cells(cells))
    amounts, documents = amounts_and_documents(
        silver, SELECTED, "cpf_cnpj", middles.holds(cell_of(F.col(SELECTED))))
    return macro_report(cells, documents, median_of(middles.attach(amounts, ["cell"])))


def macro_report(cells: DataFrame, documents: DataFrame, median: DataFrame) -> DataFrame:
    """The one row from totals of the roll's parts; the spread is put together from the
    spread within the parts and between their means."""
    everything = Window.partitionBy()
    total_mean = (F.sum(F.col("com_valor") * F.col("media")).over(everything)
                  / F.sum("com_valor").over(everything))
    squares = F.col("com_valor") * (F.col("variancia") + F.pow(F.col("desvio"), 2))
    totals = (cells
              .withColumn("desvio", F.when(F.col("com_valor") > 0, F.col("media") - total_mean))
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_registros"),
                   F.sum("com_valor").alias("com_valor"),
                   F.sum("soma").cast(WIDE_MONEY).alias("montante_total_fgts"),
                   F.sum("valor_total").cast(WIDE_MONEY).alias("montante_divida_total_uniao"),
                   F.min("menor").cast(MONEY).alias("menor_divida_fgts"),
                   F.max("maior").cast(MONEY).alias("maior_divida_fgts"),
                   F.sum(squares).alias("quadrados")))
    spread = F.when(F.col("com_valor") > 1,
                    F.sqrt(F.col("quadrados") / (F.col("com_valor") - 1)))
    return totals.select(
        "total_registros",
        documents.scalar().alias("devedores_unicos"),
        "montante_total_fgts",
        "montante_divida_total_uniao",
        ratio_percent(F.col("montante_total_fgts"), F.col("montante_divida_total_uniao"))
        .alias("pct_fgts_sobre_total"),
        mean(F.col("montante_total_fgts"), F.col("com_valor")).alias("ticket_medio_fgts"),
        median.scalar().alias("mediana_fgts"),
        "menor_divida_fgts",
        "maior_divida_fgts",
        round2(spread).alias("desvio_padrao_fgts"))


def dispersion(silver: DataFrame) -> DataFrame:
    """Coefficient of variation in percent, from the unrounded moments: one row."""
    selected = F.col(SELECTED)
    exact = ratio(F.col("total"), F.col("com_valor"))
    return (silver
            .agg(F.sum(selected).cast(WIDE_MONEY).alias("total"),
                 F.count(selected).alias("com_valor"),
                 F.stddev_samp(selected).alias("spread"))
            .select(mean(F.col("total"), F.col("com_valor")).alias("ticket_medio_fgts"),
                    round2(F.col("spread")).alias("desvio_padrao_fgts"),
                    round2(ratio(F.col("spread"), exact) * F.lit(100.0))
                    .alias("coeficiente_variacao_pct")))
