"""Every registered query against its statement, and the shape of the plans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as registered
from compare import difference
from debtatlas.plans.reports import REPORTS
from debtatlas.sources.sample_rolls import line_roll

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_statement():
    assert set(registered.library_queries()) == set(registered.library_sql())


@pytest.mark.parametrize("name", list(registered.library_queries()))
def test_query(spark, name):
    assert difference(spark, name, SMALL) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 3


# Facts about the customer roll that both engines were found to agree on.
@pytest.mark.parametrize("name, column, want", [
    ("profile_summary", "perfil_divida", [29, 21, 80, 20]),
    ("sector_summary", "esfera_institucional", [8, 142]),
    ("pareto_summary", "faixa_pareto", [32, 42, 76]),
])
def test_pinned_counts(spark, name, column, want):
    rows = registered.queries()[name](spark, SMALL).orderBy(column).collect()
    assert [r.total_devedores for r in rows] == want


def plan_of(df):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


@pytest.mark.parametrize("name", list(REPORTS))
def test_plans_stay_on_the_jvm_and_off_cross_joins(spark, name):
    plan = plan_of(REPORTS[name](line_roll(spark, SMALL)))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval",
                     "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["pareto_rows", "key_audit", "dedupe"])
def test_rows_never_meet_in_one_partition(spark, name):
    """Single partitions may only gather totals per slice, never rows with documents."""
    plan = plan_of(REPORTS[name](line_roll(spark, SMALL)))
    lines = plan.splitlines()
    for number, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert re.search(r"HashAggregate\(keys=\[slice", lines[number + 1]), plan


def test_scans_read_only_the_needed_columns(spark):
    plan = plan_of(REPORTS["top_ten_share"](line_roll(spark, SMALL)))
    for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", plan):
        assert scan.startswith("l_extendedprice") and "," not in scan
