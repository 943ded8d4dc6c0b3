"""Small staging relations held by both engines, and the statements of the reports."""

from __future__ import annotations

import tempfile
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from compare import normal

import oracles

SILVER = ("cpf_cnpj string, nome_devedor string, nome_fantasia string, "
          "valor_total decimal(18,2), valor_divida_selecionada decimal(18,2)")
ARROW = pa.schema([
    ("cpf_cnpj", pa.string()), ("nome_devedor", pa.string()), ("nome_fantasia", pa.string()),
    ("valor_total", pa.decimal128(18, 2)), ("valor_divida_selecionada", pa.decimal128(18, 2))])
REPORT_SQL = oracles._report_sql("stg AS (SELECT * FROM roll)")


def money(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


class Roll:
    """One small staging relation, held by both engines."""

    def __init__(self, spark, rows):
        self.rows = [(k, n, t, money(total), money(sel)) for k, n, t, total, sel in rows]
        self.table = pa.Table.from_pylist(
            [dict(zip(ARROW.names, row)) for row in self.rows], schema=ARROW)
        path = f"{tempfile.mkdtemp(prefix='roll-')}/roll.parquet"
        pq.write_table(self.table, path)
        self.silver = spark.read.schema(SILVER).parquet(path)

    def expected(self, sql):
        con = duckdb.connect()
        con.register("roll", self.table)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        return normal(names, result.fetchall())

    def check(self, name, frame):
        got = normal(frame.columns, [tuple(r) for r in frame.collect()])
        assert got == self.expected(REPORT_SQL[name]), name
