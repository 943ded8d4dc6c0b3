"""Company groups: establishments that share the root of their document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtatlas.functions.documents import (
    COMPANY_DIGITS, company_root, digits, is_headquarters)
from debtatlas.functions.money import WIDE_MONEY, mean, percent_of, ratio_percent

SELECTED = "valor_divida_selecionada"


def _companies(silver: DataFrame) -> DataFrame:
    return (silver
            .withColumn("digitos", digits(F.col("cpf_cnpj")))
            .filter(F.length("digitos") == COMPANY_DIGITS)
            .withColumn("cnpj_raiz", company_root(F.col("digitos"))))


def corporate_groups(silver: DataFrame) -> DataFrame:
    """Groups with more than one record, largest selected debt first."""
    headquarters = is_headquarters(F.col("digitos"))
    return (_companies(silver)
            .groupBy("cnpj_raiz")
            .agg(F.max("nome_devedor").alias("razao_social_referencia"),
                 F.count(F.lit(1)).alias("total_estabelecimentos"),
                 F.count_if(headquarters).alias("qtd_matrizes_inscritas"),
                 F.count_if(~headquarters).alias("qtd_filiais_inscritas"),
                 F.sum(SELECTED).cast(WIDE_MONEY).alias("montante_fgts_grupo"),
                 F.sum("valor_total").cast(WIDE_MONEY).alias("montante_uniao_grupo"),
                 F.count(SELECTED).alias("com_valor"))
            .filter(F.col("total_estabelecimentos") > 1)
            .withColumn("ticket_medio_por_unidade",
                        mean(F.col("montante_fgts_grupo"), F.col("com_valor")))
            .drop("com_valor")
            .orderBy(F.desc_nulls_last("montante_fgts_grupo"), "cnpj_raiz"))


def group_structure(silver: DataFrame) -> DataFrame:
    """How many groups have each make-up of headquarters and branches on the roll.
    No headquarters at all marks a group that appears through branches only."""
    return (corporate_groups(silver)
            .groupBy("qtd_matrizes_inscritas", "qtd_filiais_inscritas")
            .agg(F.count(F.lit(1)).alias("total_grupos"),
                 F.sum("total_estabelecimentos").alias("total_estabelecimentos"),
                 F.sum("montante_fgts_grupo").cast(WIDE_MONEY).alias("montante_fgts"))
            .withColumn("somente_filiais", F.col("qtd_matrizes_inscritas") == 0)
            .orderBy("qtd_matrizes_inscritas", "qtd_filiais_inscritas"))


def branch_only_groups(silver: DataFrame) -> DataFrame:
    """Groups on the roll without their headquarters."""
    return corporate_groups(silver).filter(F.col("qtd_matrizes_inscritas") == 0)


def group_share(silver: DataFrame) -> DataFrame:
    """Selected debt as a share of the total debt, per group."""
    return corporate_groups(silver).select(
        "cnpj_raiz", "razao_social_referencia", "montante_fgts_grupo",
        "montante_uniao_grupo",
        ratio_percent(F.col("montante_fgts_grupo"), F.col("montante_uniao_grupo"))
        .alias("pct_fgts_grupo"))


def multi_unit_share(silver: DataFrame) -> DataFrame:
    """Share of company records that belong to a group: one row."""
    roots = (_companies(silver)
             .groupBy("cnpj_raiz")
             .agg(F.count(F.lit(1)).alias("n")))
    grouped = F.col("n") > 1
    return (roots
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_pessoas_juridicas"),
                 F.count_if(grouped).alias("total_grupos"),
                 F.coalesce(F.sum(F.when(grouped, F.col("n"))), F.lit(0))
                 .alias("total_estabelecimentos"))
            .withColumn("pct_estabelecimentos",
                        percent_of(F.col("total_estabelecimentos"),
                                   F.col("total_pessoas_juridicas"))))
