"""Approximations against the exact operators, on three sizes."""

import re

import pytest
from pyspark.sql import functions as F

from debtatlas.operators import macro, segments, sketches

COLUMNS = ["cpf_cnpj", "nome_devedor", "nome_fantasia", "valor_total", "valor_divida_selecionada"]


def roll(spark, size):
    """Documents that recur, persons and companies, amounts over many orders of size."""
    n = F.xxhash64(F.col("id"))
    document = F.when(F.col("id") % 3 == 0, F.format_string("***.%06d-**", F.pmod(n, F.lit(size // 2 + 1)))).otherwise(
        F.format_string("%014d", F.pmod(n, F.lit(size))))
    amount = F.pow(F.lit(10.0), F.pmod(n, F.lit(1009)) / 1009 * 9).cast("decimal(18,2)")
    return spark.range(size).select(
        document.alias("cpf_cnpj"), F.lit("A").alias("nome_devedor"), F.lit(None).cast("string").alias("nome_fantasia"),
        amount.alias("valor_total"), F.when(F.col("id") % 11 != 0, amount).alias("valor_divida_selecionada"))


@pytest.mark.parametrize("size", [500, 50_000, 500_000])
def test_errors_are_kept(spark, size):
    rows = roll(spark, size)
    exact, near = macro.macro_metrics(rows).first(), sketches.approximate_metrics(rows).first()
    assert abs(near.devedores_unicos - exact.devedores_unicos) <= exact.devedores_unicos * sketches.DISTINCT_ERROR
    amounts = rows.where("valor_divida_selecionada is not null")
    total = amounts.count()
    below, up_to = [amounts.where(F.expr(f"valor_divida_selecionada {sign} {near.mediana_fgts}")).count()
                    for sign in ("<", "<=")]
    assert below <= total * (0.5 + sketches.RANK_ERROR) + 1 and up_to >= total * (0.5 - sketches.RANK_ERROR) - 1
    for column in set(exact.asDict()) - {"devedores_unicos", "mediana_fgts"}:
        assert near[column] == exact[column], column
    audit = sketches.sketch_audit(rows).collect()
    assert len(audit) == 3 and all(r.devedores_no_limite and r.mediana_no_limite for r in audit)


def test_sketches_of_labels_merge_to_those_of_the_roll(spark):
    rows = segments.entity_rows(roll(spark, 20_000))
    kept = sketches.label_sketches(rows, ["tipo_pessoa"])
    one = sketches.merged(kept).first()
    assert one.total_devedores == 20_000
    exact = rows.select(F.count_distinct("cpf_cnpj")).first()[0]
    assert abs(one.devedores_aprox - exact) <= exact * sketches.DISTINCT_ERROR


def test_no_rows_and_no_amounts(spark):
    none = roll(spark, 10).where("false")
    row = sketches.approximate_metrics(none).first()
    assert (row.total_registros, row.devedores_unicos, row.mediana_fgts) == (0, 0, None)
    empty = roll(spark, 10).withColumn("valor_divida_selecionada", F.lit(None).cast("decimal(18,2)"))
    assert sketches.approximate_metrics(empty).first().mediana_fgts is None


def test_exact_counts_beside_the_sketches(spark):
    """Documents that recur or are NULL, amounts that are NULL, and a label without any document."""
    none = F.lit(None).cast("string")
    rows = roll(spark, 3000)
    rows = rows.union(rows.limit(500)).union(rows.limit(40).withColumn("cpf_cnpj", none))
    rows = segments.entity_rows(rows).withColumnRenamed("tipo_pessoa", "rotulo")
    limits = {"Pessoa Jurídica": 900, "Pessoa Física": 7000, "Documento Inválido / Outro": 12, None: 1500}
    answers = spark.createDataFrame([(k, v) for k, v in limits.items()], "rotulo string, n long").select(
        "rotulo", F.col("n").cast("decimal(18,2)").alias("mediana_aprox"))
    local = [(r.rotulo, r.cpf_cnpj, r.valor_divida_selecionada) for r in rows.collect()]
    got = {r.rotulo: (r.devedores_unicos or 0, r.com_valor, r.abaixo, r.ate)
           for r in sketches._exact(rows, answers).collect()}
    want = {}
    for label in {row[0] for row in local} | {None}:
        own = [row for row in local if label in (None, row[0])]
        amounts = [row[2] for row in own if row[2] is not None]
        want[label] = (len({row[1] for row in own} - {None}), len(amounts),
                       sum(x < limits[label] for x in amounts), sum(x <= limits[label] for x in amounts))
    assert got == want and want["Documento Inválido / Outro"][0] == 0


def test_the_audit_sends_each_document_once(spark):
    """Not once more for the whole roll, nor with its label or counts."""
    plan = sketches.sketch_audit(roll(spark, 500))._jdf.queryExecution().executedPlan().toString()
    keys = [keys for keys in re.findall(r"Exchange hashpartitioning\((.*)", plan) if "cpf_cnpj" in keys]
    assert keys and not [k for k in keys if "rotulo" in k], keys
