"""Order statistics without sorting the roll: cells, medians and standings.

Each amount has a cell, a coarse order-preserving code computed from the amount
alone. Cells are logarithmic, 1024 to an octave; decimal(18,2) spans under 60
octaves on either side of zero, so there are no more than ``MAX_CELLS`` of them per
group, whatever the data. Totals per (group, cell) combine on the map side and are
small by construction, since groups come from closed label lists: they may be
broadcast and put in order by one task. Whatever needs single amounts then looks
at the few cells that matter, where equal amounts count as one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.functions.money import MONEY, WIDE_MONEY
from debtatlas.session import settle

CELLS_PER_OCTAVE = 1024
MAX_CELLS = 2 * 60 * CELLS_PER_OCTAVE + 2
NULL_CELL = -(2 ** 30)
# Leading bits of an amount in cents that its fine code keeps; within a cell about ten of
# them are the same, so a cell has no more than some 2 ** 18 fine codes.
FINE_BITS = 27


def cell_of(value: Column) -> Column:
    """Non-decreasing integer code of a decimal(18,2); NULL lies below everything."""
    cents = F.abs(value).cast("double") * F.lit(100.0)
    size = (F.floor(F.log2(cents) * F.lit(float(CELLS_PER_OCTAVE))) + 1).cast("int")
    return (F.when(value.isNull(), F.lit(NULL_CELL))
            .when(value > 0, size)
            .when(value < 0, -size)
            .otherwise(F.lit(0)))


def fine_code(cell: Column, value: Column) -> Column:
    """Order-preserving code within a cell: the amount in cents without its low bits.

    Amounts below R$ 1.3 million keep all bits; one fine code holds at most 8,192 different
    amounts at R$ 10 billion."""
    octave = F.floor((F.abs(cell) - 1) / F.lit(CELLS_PER_OCTAVE))
    drop = F.greatest(octave + 1 - FINE_BITS, F.lit(0)).cast("int")
    cents = (value * 100).cast("long")
    return F.coalesce(F.call_function("shiftright", cents, drop), F.lit(0))


def cell_totals(rows: DataFrame, value: str, by: Sequence[str] = (),
                carry: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Per group and cell: rows ``n``, rows with an amount ``com_valor``, their sum
    ``soma`` and largest ``maior``, the sums of ``carry`` and the ``extra`` aggregates."""
    amount = F.col(value)
    return (rows
            .withColumn("cell", cell_of(amount))
            .groupBy(*by, "cell")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count(amount).alias("com_valor"),
                 F.sum(amount).cast(WIDE_MONEY).alias("soma"),
                 F.max(amount).alias("maior"),
                 *[F.sum(c).cast(WIDE_MONEY).alias(c) for c in carry],
                 *extra))


def amounts_in(rows: DataFrame, value: str, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct amounts of the rows that fall in ``cells``, with all columns of ``cells``.

    ``cells`` holds a few cells per group and is sent to every task; rows elsewhere
    are dropped before anything is shuffled.
    """
    return (rows
            .withColumn("cell", cell_of(F.col(value)))
            .join(F.broadcast(cells), list(on))
            .groupBy(*cells.columns, F.col(value).alias("valor"))
            .agg(F.count(F.lit(1)).alias("n_valor")))


class Handful:
    """A few rows per label of a closed list, computed now and kept in the plan itself.

    What is looked up in it needs no join, and its cells can be tested on the amount alone,
    so labels are worked out only for the rows that pass.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.schema, self.columns = rows.schema, rows.columns
        self.rows = rows.collect()

    def holds(self, cell: Column) -> Column:
        return cell.isin(sorted({row.cell for row in self.rows}))

    def attach(self, rows: DataFrame, on: Sequence[str]) -> DataFrame:
        """``rows`` with the other columns, once for each row here that agrees in ``on``."""
        kind = f"array<{self.schema.simpleString()}>"
        known = F.array(*[F.struct(*[F.lit(row[c]).alias(c) for c in self.columns])
                          for row in self.rows]).cast(kind)

        def agrees(row: Column) -> Column:
            return reduce(and_, [row[c].eqNullSafe(F.col(c)) for c in on], F.lit(True))

        others = [c for c in self.columns if c not in on]
        found = F.explode(F.filter(known, agrees)).alias("found")
        return rows.select("*", found).select(*rows.columns, *[F.col(f"found.{c}") for c in others])


def amounts_and_documents(rows: DataFrame, value: str, document: str, wanted: Column,
                          by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Two answers from one scan: how often each amount of the ``wanted`` rows stands, per
    group and cell (``n_valor``), and how many documents there are (one row).

    Every row sends its document, wanted ones also (group, cell, amount); tasks combine
    equal ones, so what is shuffled is documents and a few amounts.
    """
    amount = F.col(value)
    part = F.struct(*by, cell_of(amount).alias("cell"), amount.alias("valor"))
    own = F.struct(F.col(document).alias("documento"), F.when(F.lit(False), part).alias("parte"))
    sent = F.when(wanted, F.array(own, F.struct(F.lit(None).cast("string").alias("documento"),
                                                part.alias("parte")))).otherwise(F.array(own))
    found = settle(rows.select(F.inline(sent))
                   .groupBy("documento", "parte").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("parte").agg(F.sum("n").alias("n_valor"),
                                         F.count("documento").alias("documentos")))
    return (found.filter(F.col("parte").isNotNull()).select("parte.*", "n_valor"),
            found.agg(F.coalesce(F.sum("documentos"), F.lit(0)).alias("documentos")))


# --- medians ----------------------------------------------------------------------------

def middle_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where the two middle amounts of each group lie: ``cell``, which of the two, and
    its place among the cell's amounts in ascending order. ``cells`` is unique per
    group and cell."""
    by = list(by)
    group = Window.partitionBy(*by)
    return (cells
            .filter(F.col("com_valor") > 0)
            .select(*by, "cell", "com_valor",
                    F.sum("com_valor").over(group.orderBy("cell")).alias("ate"),
                    F.sum("com_valor").over(group).alias("m"))
            .select(*by, "cell", (F.col("ate") - F.col("com_valor")).alias("antes"), "ate",
                    F.posexplode(F.array(F.expr("(m + 1) div 2"), F.expr("m div 2 + 1")))
                    .alias("meio", "lugar"))
            .filter(F.expr("antes < lugar and lugar <= ate"))
            .select(*by, "cell", "meio", (F.col("lugar") - F.col("antes")).alias("lugar")))


def median_of(middle_amounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per group as ``mediana`` from the amounts of its middle cells.

    Counts per fine code show in which of them a middle lies; only its amounts are put in
    order. The mean of two middles is cut to cents towards zero. Without groups there is
    one row, NULL for no data.
    """
    coded = middle_amounts.withColumn("fino", fine_code(F.col("cell"), F.col("valor")))
    upwards = Window.partitionBy(*by, "meio").orderBy("fino")
    place = (coded.groupBy(*by, "meio", "lugar", "fino").agg(F.sum("n_valor").alias("n"))
             .withColumn("ate", F.sum("n").over(upwards))
             .filter(F.expr("ate - n < lugar and lugar <= ate"))
             .select(*by, "meio", "fino", (F.col("ate") - F.col("n")).alias("antes_do_fino")))
    inside = Window.partitionBy(*by, "meio").orderBy("valor")
    picked = (coded.join(F.broadcast(place), [*by, "meio", "fino"])
              .withColumn("ate", F.col("antes_do_fino") + F.sum("n_valor").over(inside))
              .filter(F.expr("ate - n_valor < lugar and lugar <= ate")))
    return (picked
            .groupBy(*by)
            .agg((F.sum("valor") * 100).cast("long").alias("ambos"))
            .select(*by, (F.expr("ambos div 2").cast("decimal(20,0)") / 100).cast(MONEY).alias("mediana")))


def exact_median(rows: DataFrame, value: str, cells: DataFrame,
                 by: Sequence[str] = ()) -> DataFrame:
    """Median of ``value`` per group, given the cell totals of the same rows.

    Groups come from closed lists, and each has one or two middle cells.
    """
    middles = Handful(middle_cells(cells, by))
    amount = F.col(value)
    amounts = (rows.filter(middles.holds(cell_of(amount)))
               .groupBy(*by, cell_of(amount).alias("cell"), amount.alias("valor"))
               .agg(F.count(F.lit(1)).alias("n_valor")))
    return median_of(middles.attach(amounts, [*by, "cell"]), by)


# --- standings ----------------------------------------------------------------------------
#
# All rows are thought of as sorted largest first, NULL last. The standing of a part of
# that order, or of an amount, is what lies before it: ``n_antes`` rows worth ``soma_antes``.

def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def part_standing(totals: DataFrame, order: Column) -> DataFrame:
    """Add the standing of each part and the sum of everything. One task suffices: there
    is a row per cell or per slice."""
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "*",
        _before("n", earlier).cast("long").alias("n_antes"),
        _before("soma", earlier).cast(WIDE_MONEY).alias("soma_antes"),
        F.sum("soma").over(Window.partitionBy()).cast(WIDE_MONEY).alias("total"))


def amount_standing(amounts: DataFrame, cells: DataFrame) -> DataFrame:
    """Add the standing of each amount and the sum of everything, given the standing of
    the cells. Fine codes are put in order within their cell, amounts within their code."""
    coded = amounts.withColumn("fino", fine_code(F.col("cell"), F.col("valor")))
    above = (Window.partitionBy("cell").orderBy(F.desc("fino"))
             .rowsBetween(Window.unboundedPreceding, -1))
    larger = (Window.partitionBy("cell", "fino").orderBy(F.desc("valor"))
              .rowsBetween(Window.unboundedPreceding, -1))
    codes = (coded.groupBy("cell", "fino")
             .agg(F.sum("n").alias("n"), F.sum("soma").cast(WIDE_MONEY).alias("soma"))
             .select("cell", "fino", _before("n", above).alias("n_finos"),
                     _before("soma", above).alias("soma_finos")))
    offsets = cells.select("cell", F.col("n_antes").alias("n_celas"),
                           F.col("soma_antes").alias("soma_celas"), "total")
    return (coded
            .join(codes, ["cell", "fino"])
            .join(F.broadcast(offsets), "cell")
            .select("cell", "valor", "n", "soma",
                    (F.col("n_celas") + F.col("n_finos") + _before("n", larger)).alias("n_antes"),
                    (F.col("soma_celas") + F.col("soma_finos") + _before("soma", larger))
                    .cast(WIDE_MONEY).alias("soma_antes"),
                    "total"))
