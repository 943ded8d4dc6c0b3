"""Opt-in approximations from one scan: distinct documents and medians.

Both rest on sketches that merge, so those kept per label answer for any union of labels
without another scan, and the shuffle carries a few kilobytes per label and task. The exact
operators stay the default.

Errors: the number of distinct documents is off by 0.81 % (one standard error, 2^14
registers), and ``DISTINCT_ERROR`` is three of them. The rank of the median is off by at
most 0.45 % of the rows in 99 of 100 cases; ``RANK_ERROR`` is twice that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtatlas.functions.labels import entity_type
from debtatlas.functions.money import MONEY, WIDE_MONEY, mean, ratio_percent, round2
from debtatlas.operators.segments import SELECTED, TOTAL, entity_rows
from debtatlas.session import settle

DOCUMENT = "cpf_cnpj"
REGISTER_BITS, DISTINCT_ERROR = 14, 0.025
ITEMS, RANK_ERROR = 1000, 0.009


def _documents() -> Column:
    """NULL documents are not counted."""
    return F.hll_sketch_agg(DOCUMENT, F.lit(REGISTER_BITS))


def _amounts() -> Column:
    """Amounts in cents; NULL ones do not enter."""
    return F.kll_sketch_agg_bigint((F.col(SELECTED) * 100).cast("long"), F.lit(ITEMS))


def _median(sketch: Column, amounts: Column) -> Column:
    cents = F.when(amounts > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(0.5)))
    return (cents.cast("decimal(20,0)") / 100).cast(MONEY)


def label_sketches(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per label: rows, rows with an amount, and the sketches of documents and amounts."""
    return settle(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(SELECTED).alias("com_valor"),
        _documents().alias("documentos"), _amounts().alias("valores")))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Approximate answers per value of ``by``, a part of the labels or none."""
    together = sketches.groupBy(*by).agg(
        F.sum("n").alias("total_devedores"), F.sum("com_valor").alias("com_valor"),
        F.hll_union_agg("documentos").alias("documentos"),
        F.kll_merge_agg_bigint("valores").alias("valores"))
    return together.select(
        *by, F.coalesce("total_devedores", F.lit(0)).alias("total_devedores"),
        F.coalesce(F.hll_sketch_estimate("documentos"), F.lit(0)).alias("devedores_aprox"),
        _median(F.col("valores"), F.col("com_valor")).alias("mediana_aprox"))


def approximate_metrics(silver: DataFrame) -> DataFrame:
    """The columns of ``macro_metrics`` from one scan: distinct documents and the median are
    approximate, everything else is what the exact operator gives."""
    amount = F.col(SELECTED)
    return silver.agg(
        F.count(F.lit(1)).alias("total_registros"), _documents().alias("documentos"),
        F.sum(amount).cast(WIDE_MONEY).alias("montante_total_fgts"),
        F.sum(TOTAL).cast(WIDE_MONEY).alias("montante_divida_total_uniao"),
        F.count(amount).alias("com_valor"), _amounts().alias("valores"),
        F.min(amount).alias("menor_divida_fgts"), F.max(amount).alias("maior_divida_fgts"),
        F.stddev_samp(amount).alias("desvio")).select(
        "total_registros",
        F.coalesce(F.hll_sketch_estimate("documentos"), F.lit(0)).alias("devedores_unicos"),
        "montante_total_fgts", "montante_divida_total_uniao",
        ratio_percent(F.col("montante_total_fgts"), F.col("montante_divida_total_uniao"))
        .alias("pct_fgts_sobre_total"),
        mean(F.col("montante_total_fgts"), F.col("com_valor")).alias("ticket_medio_fgts"),
        _median(F.col("valores"), F.col("com_valor")).alias("mediana_fgts"),
        "menor_divida_fgts", "maior_divida_fgts", round2(F.col("desvio")).alias("desvio_padrao_fgts"))


def _exact(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Per label and for the whole roll (``rotulo`` NULL): documents, amounts, and the amounts
    below and up to the approximate median of ``answers``.

    A label follows from the document, so a document has one label: each is sent once, alone,
    and the labels' counts add up to that of the roll.
    """
    documents = (rows.select(DOCUMENT).where(F.col(DOCUMENT).isNotNull()).distinct()
                 .groupBy(entity_type(F.col(DOCUMENT)).alias("rotulo"))
                 .agg(F.count(F.lit(1)).alias("devedores_unicos")))
    median = answers.where("rotulo is not null").select("rotulo", "mediana_aprox")
    overall = answers.where("rotulo is null").select("mediana_aprox").scalar()
    amount, own = F.col(SELECTED), F.col("mediana_aprox")
    labels = (rows.select("rotulo", SELECTED).join(F.broadcast(median), "rotulo").groupBy("rotulo").agg(
        F.count(amount).alias("com_valor"),
        F.count_if(amount < own).alias("abaixo"), F.count_if(amount <= own).alias("ate"),
        F.count_if(amount < overall).alias("abaixo_todos"), F.count_if(amount <= overall).alias("ate_todos"))
        .join(F.broadcast(documents), "rotulo", "left"))
    counts = ["devedores_unicos", "com_valor", "abaixo", "ate"]
    both = labels.select(F.inline(F.array(
        F.struct("rotulo", *counts),
        F.struct(F.lit(None).cast("string").alias("rotulo"), *counts[:2],
                 F.col("abaixo_todos").alias("abaixo"), F.col("ate_todos").alias("ate")))))
    return both.groupBy("rotulo").agg(*[F.sum(name).alias(name) for name in counts])


def sketch_audit(silver: DataFrame) -> DataFrame:
    """Do the approximations keep their errors? Per entity type, and for the whole roll merged
    from the types' sketches (``rotulo`` NULL): the exact number of documents, and whether the
    approximate one and the rank of the approximate median are within the stated errors."""
    rows = entity_rows(silver).withColumnRenamed("tipo_pessoa", "rotulo")
    sketches = label_sketches(rows, ["rotulo"])
    nobody = F.lit(None).cast("string")
    answers = settle(merged(sketches, ["rotulo"]).unionByName(
        merged(sketches).withColumn("rotulo", nobody)))
    ranks = _exact(rows, answers)
    slack = F.col("com_valor") * RANK_ERROR + 1
    return (answers.join(F.broadcast(ranks.withColumnRenamed("rotulo", "de")),
                         F.col("rotulo").eqNullSafe(F.col("de")), "left")
            .select("rotulo", "total_devedores",
                    F.coalesce("devedores_unicos", F.lit(0)).alias("devedores_unicos"),
                    F.coalesce(F.abs(F.col("devedores_aprox") - F.col("devedores_unicos"))
                               <= F.col("devedores_unicos") * DISTINCT_ERROR + 1, F.lit(True))
                    .alias("devedores_no_limite"),
                    F.coalesce((F.col("abaixo") <= F.col("com_valor") / 2 + slack)
                               & (F.col("ate") >= F.col("com_valor") / 2 - slack), F.lit(True))
                    .alias("mediana_no_limite")))
