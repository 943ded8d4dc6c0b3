"""Extracts, the staging contract and the catalog."""

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from debtatlas import __main__ as command
from debtatlas.plans.reports import REPORTS, report
from debtatlas.session import release, shared_folder
from debtatlas.sources import catalog, roll_csv, staging

HEADER = "CPF/CNPJ;Nome;Nome Fantasia;Valor Total;Valor da Dívida Selecionada;Extra"
LINES = [
    ' 12.345.678/0001-00 ;JOÃO & FILHOS;  ;"1.234,56";"1.234,56";x',
    '***.123.456-**;"ÓTICA; ""ZÉ""";"";10;n/d;',
    '00012345678;MARIA;Loja ;;12,75;y',
]


@pytest.fixture()
def extract(tmp_path):
    path = tmp_path / "roll.csv"
    path.write_bytes("\r\n".join([HEADER, *LINES, ""]).encode("latin-1"))
    return str(path)


def test_read_keeps_every_column_as_text(spark, extract):
    raw = roll_csv.read_roll(spark, extract)
    assert raw.columns == HEADER.split(";")
    assert {kind for _, kind in raw.dtypes} == {"string"}
    assert [tuple(r) for r in raw.collect()] == [
        (" 12.345.678/0001-00 ", "JOÃO & FILHOS", "  ", "1.234,56", "1.234,56", "x"),
        ("***.123.456-**", 'ÓTICA; "ZÉ"', None, "10", "n/d", None),
        ("00012345678", "MARIA", "Loja ", None, "12,75", "y")]


def test_staging_contract(spark, extract):
    silver = staging.create_staging_view(roll_csv.read_roll(spark, extract))
    assert silver.dtypes == [
        ("cpf_cnpj", "string"), ("nome_devedor", "string"), ("nome_fantasia", "string"),
        ("valor_total", "decimal(18,2)"), ("valor_divida_selecionada", "decimal(18,2)")]
    rows = [tuple(r) for r in spark.table(staging.STAGING_VIEW).collect()]
    assert rows == [
        ("12.345.678/0001-00", "JOÃO & FILHOS", None, Decimal("1234.56"), Decimal("1234.56")),
        ("***.123.456-**", 'ÓTICA; "ZÉ"', None, Decimal("10.00"), None),
        ("00012345678", "MARIA", "Loja", None, Decimal("12.75"))]
    assert report(spark, "macro_metrics").first().total_registros == 3


def test_contract_report_counts_what_was_dropped(spark, extract):
    rows = staging.contract_report(roll_csv.read_roll(spark, extract)).collect()
    assert {r.coluna: (r.total_registros, r.em_branco, r.convertidos, r.rejeitados)
            for r in rows} == {roll_csv.TOTAL: (3, 1, 2, 0), roll_csv.SELECTED: (3, 0, 2, 1)}


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_bytes("Nome;Valor Total\nA;1".encode("latin-1"))
    with pytest.raises(ValueError, match="CPF/CNPJ"):
        roll_csv.read_roll(spark, str(path))


def test_publishing_replaces(spark, extract, tmp_path):
    raw = roll_csv.read_roll(spark, extract)
    for _ in range(2):
        copy = catalog.publish_parquet(raw, str(tmp_path / "bronze"))
        assert copy.schema == raw.schema and copy.count() == 3
    path = spark.conf.get("spark.sql.warehouse.dir")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rolls LOCATION '{tmp_path}/db'")
    for _ in range(2):
        catalog.publish_table(raw, "rolls.divida_fgts")
        assert spark.table("rolls.divida_fgts").count() == 3
    spark.sql("DROP DATABASE rolls CASCADE")
    assert path == spark.conf.get("spark.sql.warehouse.dir")


def test_profile(spark, extract):
    rows = roll_csv.profile_raw(roll_csv.read_roll(spark, extract)).collect()
    assert [tuple(r) for r in rows] == [(c, "string", 3) for c in HEADER.split(";")]


def test_command_line(spark, extract, tmp_path, capsys):
    warehouse = str(tmp_path / "warehouse")
    command.ingest(spark, extract, warehouse)
    command.report(spark, "entity_summary", warehouse)
    shown = capsys.readouterr().out
    assert "Valor da Dívida Selecionada" in shown and "Pessoa Jurídica" in shown


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    for name, head, row in (("a", HEADER, "1;A;;200,00;20,00;x"), (
            "b", "CPF/CNPJ;Nome;Nome Fantasia;Valor da Dívida Selecionada;Valor Total;Extra", "2;B;;20,00;200,00;x")):
        (tmp_path / f"{name}.csv").write_bytes(f"{head}\n{row}\n".encode("latin-1"))
    with pytest.raises(Exception, match="(?i)header"):
        roll_csv.read_roll(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert roll_csv.read_roll(spark, str(tmp_path / "b.csv")).count() == 1


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "roll.csv"
    path.write_bytes((HEADER + '\n1;"A\nB";;1;1;x\n').encode("latin-1"))
    assert roll_csv.read_roll(spark, str(path), multiline=True).first().Nome == "A\nB"
    with pytest.raises(Exception):
        roll_csv.read_roll(spark, str(path)).collect()


def test_a_frame_may_replace_what_it_reads(spark, extract, tmp_path):
    copy = catalog.publish_parquet(roll_csv.read_roll(spark, extract), str(tmp_path / "bronze"))
    less = catalog.publish_parquet(copy.where("Nome = 'MARIA'"), str(tmp_path / "bronze"))
    assert (copy.count(), less.count()) == (3, 1)


def _failing(raw):
    return raw.withColumn("Nome", F.when(F.col("Nome") == "MARIA", F.raise_error(F.lit("half-way")))
                          .otherwise(F.col("Nome")))


def test_a_write_that_fails_leaves_the_old_rows(spark, extract, tmp_path):
    raw, path = roll_csv.read_roll(spark, extract), str(tmp_path / "bronze")
    catalog.publish_parquet(raw, path)
    catalog.publish_table(raw, "divida_teste", str(tmp_path / "table"))
    for publish in (lambda: catalog.publish_parquet(_failing(raw), path),
                    lambda: catalog.publish_table(_failing(raw), "divida_teste", str(tmp_path / "table"))):
        with pytest.raises(Exception, match="half-way"):
            publish()
    assert catalog.read_published(spark, path).count() == 3
    assert spark.table("divida_teste").count() == 3
    assert len(list((tmp_path / "bronze").glob("data-*"))) == 1
    spark.sql("DROP TABLE divida_teste")


def test_a_reader_keeps_its_version(spark, extract, tmp_path):
    raw, path = roll_csv.read_roll(spark, extract), str(tmp_path / "bronze")
    old = catalog.publish_parquet(raw, path)
    for rows in (2, 1):
        assert catalog.publish_parquet(raw.limit(rows), path).count() == rows
        if rows == 2:
            assert old.count() == 3
    assert len(list((tmp_path / "bronze").glob("data-*"))) == catalog.KEPT_VERSIONS
    with pytest.raises(FileNotFoundError):
        catalog.read_published(spark, str(tmp_path / "nowhere"))


def test_a_table_takes_other_columns(spark, extract, tmp_path):
    raw = roll_csv.read_roll(spark, extract)
    catalog.publish_table(raw, "divida_larga", str(tmp_path / "table"))
    catalog.publish_table(staging.stage(raw), "divida_larga", str(tmp_path / "table"))
    assert [tuple(r) for r in catalog.describe_table(spark, "divida_larga").collect()] == [
        ("cpf_cnpj", "string"), ("nome_devedor", "string"), ("nome_fantasia", "string"),
        ("valor_total", "decimal(18,2)"), ("valor_divida_selecionada", "decimal(18,2)")]
    assert spark.table("divida_larga").count() == 3
    spark.sql("DROP TABLE divida_larga")


def test_the_view_outlives_the_session_and_follows_the_table(spark, extract, tmp_path):
    raw = roll_csv.read_roll(spark, extract)
    catalog.publish_table(raw, "divida_base", str(tmp_path / "table"))
    catalog.create_permanent_view(spark, "divida_base", "stg_base")
    other = spark.newSession()
    assert other.table("stg_base").collect() == staging.stage(raw).collect()
    catalog.publish_table(raw.where("Nome = 'MARIA'"), "divida_base", str(tmp_path / "table"))
    assert spark.newSession().table("stg_base").count() == 1
    assert report(spark.newSession(), "macro_metrics", "stg_base").first().total_registros == 1
    with pytest.raises(ValueError):
        catalog.create_permanent_view(spark, "divida_base; DROP TABLE x", "v")
    spark.sql("DROP VIEW stg_base")
    spark.sql("DROP TABLE divida_base")


def test_command_line_writes_every_row(spark, tmp_path, capsys):
    path = tmp_path / "roll.csv"
    path.write_bytes("\n".join([HEADER, *[f"{n};N{n};;{n},00;1,00;x" for n in range(150)]]).encode("latin-1"))
    warehouse, out = str(tmp_path / "warehouse"), str(tmp_path / "rows")
    command.ingest(spark, str(path), warehouse)
    command.report(spark, "entity_rows", warehouse)
    assert "50 more rows" in capsys.readouterr().out
    command.report(spark, "entity_rows", warehouse, out)
    assert spark.read.parquet(out).count() == 150
    command.report(spark, "entity_rows", warehouse, out + ".csv")
    assert spark.read.option("header", True).csv(out + ".csv").count() == 150


def test_nothing_settled_is_left_after_release(spark, extract):
    release(spark)
    silver = staging.stage(roll_csv.read_roll(spark, extract))
    for name in ("pareto_summary", "macro_metrics", "key_audit"):
        REPORTS[name](silver).collect()
    folder = Path(shared_folder(spark).removeprefix("file:"))
    assert len(list(folder.glob("settled-*"))) > 0
    assert release(spark) > 0
    assert list(folder.glob("settled-*")) == []
