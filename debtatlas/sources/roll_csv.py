"""Delimited extracts in, raw (bronze) table out, everything kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the extract that the contract relies on.
DOCUMENT = "CPF/CNPJ"
NAME = "Nome"
TRADE_NAME = "Nome Fantasia"
TOTAL = "Valor Total"
SELECTED = "Valor da Dívida Selecionada"
ROLL_COLUMNS = (DOCUMENT, NAME, TRADE_NAME, TOTAL, SELECTED)

# The extract's format. Blanks at either end of a field are data.
FORMAT = {
    "header": True,
    "sep": ";",
    "encoding": "ISO-8859-1",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

RAW_TABLE = "divida_fgts"


def read_roll(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Read extracts as text columns named by their header.

    Types are never inferred: inference would turn unpunctuated documents into
    numbers and drop their leading zeros. Every file must have the first one's header: a
    file with other columns, or the same in another order, stops the read. Quotes hold
    line breaks only with ``multiline``; files then are read whole, so keep them small.
    """
    raw = spark.read.options(**FORMAT, inferSchema=False, enforceSchema=False, mode="FAILFAST",
                             multiLine=multiline).csv(path)
    missing = [c for c in ROLL_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"extract lacks the columns {missing}; found {raw.columns}")
    return raw


def write_roll(raw: DataFrame, path: str) -> None:
    """Write a raw relation in the extract's format."""
    raw.write.options(**FORMAT).csv(path)


def profile_raw(raw: DataFrame) -> DataFrame:
    """One row per column: its name, its type and the number of records."""
    columns = F.array(*[F.struct(F.lit(name).alias("column_name"),
                                 F.lit(kind).alias("column_type"))
                        for name, kind in raw.dtypes])
    return (raw.agg(F.count(F.lit(1)).alias("total_registros"))
            .select(F.inline(columns), "total_registros"))
