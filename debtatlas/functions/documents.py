"""Taxpayer documents: companies carry 14 digits, persons 11, or 6 when masked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit counts and slices of the two document kinds.
COMPANY_DIGITS = 14
PERSON_DIGITS = 11
MASKED_PERSON_DIGITS = 6
ROOT_DIGITS = 8
HEADQUARTERS = "0001"


def digits(document: Column) -> Column:
    return F.regexp_replace(document, "[^0-9]", "")


def company_root(company_digits: Column) -> Column:
    return F.substring(company_digits, 1, ROOT_DIGITS)


def is_headquarters(company_digits: Column) -> Column:
    return F.substring(company_digits, ROOT_DIGITS + 1, len(HEADQUARTERS)) == HEADQUARTERS
