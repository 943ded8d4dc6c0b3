"""Is the document a key of the roll, and which record stands for it if not?

Key and order are arguments: a key is one column or several, NULL is a value of each, and
records with equal keys are put in any order; the columns it leaves out settle its ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.operators.ranking import position_within
from debtatlas.session import settle

KEY = "cpf_cnpj"
COLUMNS = ("cpf_cnpj", "nome_devedor", "nome_fantasia", "valor_total",
           "valor_divida_selecionada")
POSITION = "indice_duplicidade"

Key = str | Sequence[str]


def impact_order() -> list[Column]:
    """Largest selected debt first, then largest total; names settle what is left."""
    return [F.desc_nulls_last("valor_divida_selecionada"), F.desc_nulls_last("valor_total"),
            F.asc_nulls_last("nome_devedor"), F.asc_nulls_last("nome_fantasia")]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _full_order(key: list[str], order: Sequence[Column] | None,
                columns: Sequence[str]) -> list[Column]:
    """``order``, or the impact, and after it every column outside the key."""
    if order is None and set(columns) == set(COLUMNS):
        return impact_order()
    rest = [F.asc_nulls_last(name) for name in columns if name not in key]
    return [*(impact_order() if order is None else order), *rest]


def repeated_keys(rows: DataFrame, key: Key = KEY) -> DataFrame:
    """Fingerprints of the keys that more than one record has, as ``fingerprint``.

    Tasks count before anything is shuffled, so a key that a third of all records share
    sends one row per task. Two keys with one fingerprint only let a few records through.
    """
    return settle(rows.select(_fingerprint(_names(key)))
                  .groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").select("fingerprint"))


def _fingerprint(key: list[str]) -> Column:
    """64 bits of a key; columns that are NULL count by their place."""
    parts = [part for name in key for part in (F.col(name), F.isnull(name))]
    return F.xxhash64(*parts).alias("fingerprint")


def key_audit(silver: DataFrame, key: Key = KEY, order: Sequence[Column] | None = None,
              columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Every record after the first of its key, in ``order``; empty for a clean key.

    Only records whose key occurs again are ranked: a semi join on the keys counted before
    drops all others where they are read. The columns are ``columns`` and the position.
    """
    key, columns = _names(key), list(columns)
    order = _full_order(key, order, columns)
    rows = silver.select(*columns)
    suspects = settle(rows.withColumn("fingerprint", _fingerprint(key))
                      .join(repeated_keys(rows, key), "fingerprint", "left_semi")
                      .drop("fingerprint"))
    return (position_within(suspects, key, order)
            .filter(F.col("position") > 1)
            .withColumnRenamed("position", POSITION)
            .orderBy(*order, *key, POSITION))


def dedupe(silver: DataFrame, key: Key = KEY, order: Sequence[Column] | None = None,
           columns: Sequence[str] = COLUMNS) -> DataFrame:
    """One record per key, the first in ``order``, by default the one of highest impact.

    Spark keeps the best record of each key before the shuffle, so a key with many records
    sends one per task.
    """
    key, columns = _names(key), list(columns)
    best = Window.partitionBy(*key).orderBy(*_full_order(key, order, columns))
    return (silver.select(*columns)
            .withColumn("position", F.row_number().over(best))
            .filter(F.col("position") == 1)
            .drop("position"))
