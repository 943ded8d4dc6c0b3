"""All reports by name, over one staging relation, as frames or as SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtatlas.functions import labels
from debtatlas.operators import groups, macro, pareto, portfolio, quality, segments, sketches
from debtatlas.sources.staging import STAGING_VIEW

TOP = 10


def _members(rows: Callable[[DataFrame], DataFrame], label: str, outcome: str):
    """All debtors of one segment, largest first."""
    return lambda silver: segments.segment_members(rows(silver), label, outcome)


def top_ten_share(silver: DataFrame) -> DataFrame:
    return pareto.top_share(silver, TOP)


#: A key of two columns, either of which may be NULL, and an order of one's own.
SEGMENT_KEY = ("nome_fantasia", "valor_divida_selecionada")


def _smallest_total() -> list[Column]:
    return [F.asc_nulls_last("valor_total"), F.desc_nulls_last("cpf_cnpj")]


def segment_key_audit(silver: DataFrame) -> DataFrame:
    """Debtors that owe as much as another one with their trade name, after the first."""
    return quality.key_audit(silver, SEGMENT_KEY, _smallest_total())


def segment_dedupe(silver: DataFrame) -> DataFrame:
    """One debtor per trade name and selected debt, the one with the least total debt."""
    return quality.dedupe(silver, SEGMENT_KEY, _smallest_total())


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "key_audit": quality.key_audit,
    "dedupe": quality.dedupe,
    "segment_key_audit": segment_key_audit,
    "segment_dedupe": segment_dedupe,
    "macro_metrics": macro.macro_metrics,
    "dispersion": macro.dispersion,
    "entity_rows": segments.entity_rows,
    "entity_summary": segments.entity_summary,
    "corporate_groups": groups.corporate_groups,
    "group_structure": groups.group_structure,
    "branch_only_groups": groups.branch_only_groups,
    "group_share": groups.group_share,
    "multi_unit_share": groups.multi_unit_share,
    "debt_profile_rows": segments.debt_profile_rows,
    "profile_summary": segments.profile_summary,
    "profile_measures": segments.profile_measures,
    "sector_rows": segments.sector_rows,
    "sector_summary": segments.sector_summary,
    "sector_measures": segments.sector_measures,
    "sector_median_ratio": segments.sector_median_ratio,
    "public_sector_members": _members(
        segments.sector_rows, "esfera_institucional", labels.PUBLIC_SECTOR),
    "person_members": _members(segments.entity_rows, "tipo_pessoa", labels.PERSON),
    "invalid_document_members": _members(
        segments.entity_rows, "tipo_pessoa", labels.INVALID_DOCUMENT),
    "exclusive_debt_members": _members(
        segments.debt_profile_rows, "perfil_divida", labels.PROFILE_EXCLUSIVE),
    "first_tier_members": _members(pareto.pareto_rows, "faixa_pareto", pareto.TIERS[0][1]),
    "pareto_rows": pareto.pareto_rows,
    "pareto_summary": pareto.pareto_summary,
    "pareto_cumulative": pareto.pareto_cumulative,
    "top_ten_share": top_ten_share,
    "sketch_audit": sketches.sketch_audit,
    "portfolio_table": portfolio.portfolio_table,
}


def report(spark: SparkSession, name: str, view: str = STAGING_VIEW) -> DataFrame:
    """One report over a registered staging view or table."""
    return REPORTS[name](spark.table(view))
