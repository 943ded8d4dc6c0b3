"""Row numbers over a total order, whatever the size of a group.

Rows are cut into consecutive slices of the order. A serial number breaks the last ties,
so copies of one row can be cut apart too, and no key or amount is too frequent for a
slice. Slices are written to the shared folder before anything is counted in them, because
their borders come from sampling and must not differ between two readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.session import settle

SLICE, SERIAL = "slice", "serial"


def sliced(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with their ``slice`` and a ``serial`` number that tells copies apart."""
    return settle(rows
                  .withColumn(SERIAL, F.monotonically_increasing_id())
                  .repartitionByRange(*order, F.col(SERIAL))
                  .withColumn(SLICE, F.spark_partition_id()))


def _ordered(key: Sequence[str]) -> Column:
    """The key as one value that sorts column by column, NULL first."""
    return F.struct(*[part for place, name in enumerate(key) for part in (
        F.col(name).isNotNull().alias(f"known_{place}"), F.col(name).alias(f"key_{place}"))])


def position_within(rows: DataFrame, by: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``position``: 1, 2, ... per value of the key ``by`` in ``order``; NULL is a value of
    each of its columns.

    Inside a slice rows are numbered per key. Only the first key of a slice can have begun
    before it, so what lies ahead takes two counts per slice: those of its outermost keys.
    """
    by = [by] if isinstance(by, str) else list(by)
    cut = sliced(rows, [*(F.asc_nulls_first(name) for name in by), *order])
    key = _ordered(by)
    edges = cut.groupBy(SLICE).agg(F.min(key).alias("lowest"), F.max(key).alias("highest"))
    outer = (cut.select(SLICE, key.alias("key")).join(F.broadcast(edges), SLICE)
             .filter("key <=> lowest or key <=> highest")
             .groupBy("key", SLICE).agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("key").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ahead = outer.select(F.col(SLICE).alias("of_slice"), F.col("key").alias("of_key"),
                         F.sum("n").over(earlier).alias("ahead")).filter("ahead > 0")
    here = Window.partitionBy(SLICE, *by).orderBy(*order, SERIAL)
    return (cut
            .withColumn("position", F.row_number().over(here).cast("long"))
            .join(F.broadcast(ahead),
                  (F.col(SLICE) == F.col("of_slice")) & key.eqNullSafe(F.col("of_key")), "left")
            .withColumn("position", F.col("position") + F.coalesce("ahead", F.lit(0)))
            .drop("of_slice", "of_key", "ahead", SLICE, SERIAL))
