from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import oracles
from debtatlas.functions import labels
from debtatlas.functions.money import mean, parse_brl, percent_of, round2
from debtatlas.operators import pareto

MONEY_TEXT = ["", " ", "n/d", "R$ 1", "1e3", ".5", "5.", "+7", "-3,25", " 12,75 ", "1.234,56",
              "1.234.567,895", "0,005", "-0,005", "12345678901234567,00", "1,2,3", "\t7", "0",
              "9999999999999999,99", "abc", "1 000", ",5", "5,", "-", "1.2.3,4", None]


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_parse_brl_agrees_with_the_contract(spark):
    frame = column(spark, MONEY_TEXT, "string").select("i", parse_brl(F.col("x")).alias("v"))
    got = dict(frame.collect())
    con = duckdb.connect()
    for i, text in enumerate(MONEY_TEXT):
        want = con.execute(
            "SELECT try_cast(replace(replace(trim($1), '.', ''), ',', '.') AS DECIMAL(18,2))",
            [text]).fetchone()[0]
        assert got[i] == want, text


def test_round2_rounds_the_binary_value(spark):
    values = [1.005, 0.285, 2.675, -1.005, 0.125, -0.125, 1e15 + 0.3, 0.0]
    got = [r.v for r in column(spark, values, "double")
           .select("i", round2(F.col("x")).alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round($1::DOUBLE, 2)", [v]).fetchone()[0] for v in values]
    assert got[:2] == [1.0, 0.28]


def test_shares_and_means(spark):
    row = spark.range(1).select(
        percent_of(F.lit(1), F.lit(0)).alias("none"),
        percent_of(F.lit(1), F.lit(3)).alias("third"),
        mean(F.lit(Decimal("0.05")), F.lit(2)).alias("half_cent")).first()
    assert (row.none, row.third, row.half_cent) == (None, 33.33, 0.03)


@pytest.mark.parametrize("document, label", [
    ("12.345.678/0001-00", labels.COMPANY),
    ("12345678000100", labels.COMPANY),
    ("*12.345.678/0001-00", labels.COMPANY),
    ("***.123.456-**", labels.PERSON),
    ("123456", labels.INVALID_DOCUMENT),
    ("123.456.789-00", labels.PERSON),
    ("***.123.45-**", labels.INVALID_DOCUMENT),
    ("", labels.INVALID_DOCUMENT),
    (None, labels.INVALID_DOCUMENT),
])
def test_entity_type(spark, document, label):
    frame = column(spark, [document], "string")
    assert frame.select(labels.entity_type(F.col("x"))).first()[0] == label


@pytest.mark.parametrize("selected, total, label", [
    ("1", "1", labels.PROFILE_EXCLUSIVE),
    ("2", "1", labels.PROFILE_EXCLUSIVE),
    ("0", "0", labels.PROFILE_EXCLUSIVE),
    ("5", "0", labels.PROFILE_EXCLUSIVE),
    ("-5", "0", labels.PROFILE_RESIDUAL),
    ("99.99", "100", labels.PROFILE_MAJORITY),
    ("50", "100", labels.PROFILE_MAJORITY),
    ("49.99", "100", labels.PROFILE_RELEVANT),
    ("10", "100", labels.PROFILE_RELEVANT),
    ("9.99", "100", labels.PROFILE_RESIDUAL),
    (None, "100", labels.PROFILE_RESIDUAL),
    ("1", None, labels.PROFILE_RESIDUAL),
])
def test_debt_profile(spark, selected, total, label):
    row = [tuple(None if v is None else Decimal(v) for v in (selected, total))]
    frame = spark.createDataFrame(row, "s decimal(18,2), t decimal(18,2)")
    assert frame.select(labels.debt_profile(F.col("s"), F.col("t"))).first()[0] == label


@pytest.mark.parametrize("name, trade, public", [
    ("Municipio de X", None, True),
    ("MUNICÍPIO DE X", None, False),
    ("prefeitura de x", None, True),
    ("ACME", "saae", False),
    ("saae x", None, True),
    ("ACME", "Urbfor", True),
    (None, "PREFEITURA", True),
    (None, None, False),
    ("ACME", "secretaria", False),
])
def test_sector(spark, name, trade, public):
    frame = spark.createDataFrame([(name, trade)], "n string, t string")
    got = frame.select(labels.institutional_sector(F.col("n"), F.col("t"))).first()[0]
    assert got == (labels.PUBLIC_SECTOR if public else labels.PRIVATE_SECTOR)


@pytest.mark.parametrize("fragment", oracles.PUBLIC_NAME_FRAGMENTS)
def test_each_name_fragment_marks_a_public_body(spark, fragment):
    rows = [(f"x {fragment.lower()} y", None), (None, f"x {fragment} y"), (fragment[:-1], None)]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, n string, t string")
    got = [r[1] for r in frame.select("i", labels.institutional_sector(F.col("n"), F.col("t"))).orderBy("i").collect()]
    trade = oracles.PUBLIC_SECTOR if fragment in oracles.PUBLIC_TRADE_NAME_FRAGMENTS else oracles.PRIVATE_SECTOR
    assert got == [oracles.PUBLIC_SECTOR, trade, oracles.PRIVATE_SECTOR]


def test_fixed_values_are_those_of_the_statements():
    for name in ("COMPANY", "PERSON", "INVALID_DOCUMENT", "PROFILE_EXCLUSIVE", "PROFILE_MAJORITY",
                 "PROFILE_RELEVANT", "PROFILE_RESIDUAL", "PUBLIC_SECTOR", "PRIVATE_SECTOR",
                 "PUBLIC_NAME_FRAGMENTS", "PUBLIC_TRADE_NAME_FRAGMENTS"):
        assert getattr(labels, name) == getattr(oracles, name)
    assert (pareto.TIERS, pareto.TAIL) == (oracles.TIERS, oracles.TAIL)
