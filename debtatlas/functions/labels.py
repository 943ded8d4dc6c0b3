"""Row labels behind the segment reports. Each is one Catalyst expression with a
closed list of outcomes, so every report has a handful of groups at any scale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtatlas.functions.documents import (
    COMPANY_DIGITS, MASKED_PERSON_DIGITS, PERSON_DIGITS, digits)
from debtatlas.functions.money import ratio

# Labels shown in the reports.
COMPANY = "Pessoa Jurídica"
PERSON = "Pessoa Física"
INVALID_DOCUMENT = "Documento Inválido / Outro"

PROFILE_EXCLUSIVE = "1. Exclusivo FGTS (100%)"
PROFILE_MAJORITY = "2. Majoritário (50% a 99%)"
PROFILE_RELEVANT = "3. Relevante (10% a 49%)"
PROFILE_RESIDUAL = "4. Residual / Sistêmico (< 10%)"

PUBLIC_SECTOR = "Administração Pública"
PRIVATE_SECTOR = "Iniciativa Privada / Outros"

# Name fragments that mark a public body, matched without regard
# to case but with regard to accents.
PUBLIC_NAME_FRAGMENTS = (
    "MUNICIPIO",
    "PREFEITURA",
    "AUTARQUIA",
    "CAMARA MUNICIPAL",
    "CONSORCIO PUBLICO",
    "CONSORCIO INTERMUNICIPAL",
    "SECRETARIA",
    "ESTADO DO CEARA",
    "SERVICO AUTONOMO DE AGUA",
    "SAAE",
)
PUBLIC_TRADE_NAME_FRAGMENTS = (
    "PREFEITURA",
    "URBFOR",
)


def entity_type(document: Column) -> Column:
    """Company, person or neither, from the digit count and the privacy mask."""
    count = F.length(digits(document))
    masked = (count == MASKED_PERSON_DIGITS) & document.contains("*")
    return (F.when(count == COMPANY_DIGITS, COMPANY)
            .when(masked | (count == PERSON_DIGITS), PERSON)
            .otherwise(INVALID_DOCUMENT))


def debt_profile(selected: Column, total: Column) -> Column:
    """Cohort by the selected debt's share of the total debt. Comparing the amounts
    comes first, so a zero total with a non-negative selected debt is exclusive."""
    share = ratio(selected, total)
    return (F.when(selected >= total, PROFILE_EXCLUSIVE)
            .when(share >= F.lit(0.50), PROFILE_MAJORITY)
            .when(share >= F.lit(0.10), PROFILE_RELEVANT)
            .otherwise(PROFILE_RESIDUAL))


#: (column, fragment) of every pattern, in the order of the fixed values above.
PUBLIC_PATTERNS = (*(("nome_devedor", fragment) for fragment in PUBLIC_NAME_FRAGMENTS),
                   *(("nome_fantasia", fragment) for fragment in PUBLIC_TRADE_NAME_FRAGMENTS))


def matches_any(texts: Mapping[str, Column], patterns: Sequence[tuple[str, str]]) -> Column:
    """Whether a text holds a fragment listed for it, without regard to case.

    One matcher per text, whose fragments are lower-cased beforehand. ``texts`` should be
    columns that hold the lower-cased text (see ``with_institutional_sector``), so that
    it is worked out once a row. Other than a regular expression over all fragments, which took
    half as long again on 8 million names, this stays in generated code.
    """
    fragments: dict[str, list[str]] = {}
    for name, fragment in patterns:
        fragments.setdefault(name, []).append(fragment.lower())
    return reduce(or_, [texts[name].contains(fragment)
                        for name, listed in fragments.items() for fragment in listed])


def _sector(texts: Mapping[str, Column]) -> Column:
    return F.when(matches_any(texts, PUBLIC_PATTERNS), PUBLIC_SECTOR).otherwise(PRIVATE_SECTOR)


def institutional_sector(name: Column, trade_name: Column) -> Column:
    return _sector({"nome_devedor": F.lower(name), "nome_fantasia": F.lower(trade_name)})


def with_institutional_sector(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with the sector as column ``label``, each name lower-cased once."""
    return (rows
            .withColumns({"__name": F.lower("nome_devedor"), "__trade_name": F.lower("nome_fantasia")})
            .withColumn(label, _sector({"nome_devedor": F.col("__name"),
                                        "nome_fantasia": F.col("__trade_name")}))
            .drop("__name", "__trade_name"))
