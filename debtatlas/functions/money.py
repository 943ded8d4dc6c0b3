"""Fixed-point money and the rounding rules of the published reports.

Sums stay exact decimals. Ratios, means and percentages are doubles, rounded on
the binary value (1.005 gives 1.0), which is why ``F.round(x, 2)`` is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE_MONEY = "decimal(38,2)"


def parse_brl(text: Column) -> Column:
    """``1.234,56`` to a decimal; text that is no number becomes NULL."""
    return F.translate(F.trim(text), ",.", ".").try_cast(MONEY)


def brl_sql(text: str) -> str:
    """The same as an SQL expression over ``text``."""
    return f"try_cast(translate(trim({text}), ',.', '.') AS {MONEY})"


def round2(x: Column) -> Column:
    return F.round(x * F.lit(100.0), 0) / F.lit(100.0)


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient; NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent, scaled before the division."""
    return round2(ratio(part * 100, whole))


def ratio_percent(part: Column, whole: Column) -> Column:
    """Share in percent, scaled after the division."""
    return round2(ratio(part, whole) * F.lit(100.0))


def mean(total: Column, count: Column) -> Column:
    """Mean of money from its exact sum and row count."""
    return round2(ratio(total * 100, count * 100))
