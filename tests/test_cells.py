"""Cells must never put a larger amount below a smaller one."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from debtatlas.operators.distribution import MAX_CELLS, NULL_CELL, cell_of


def test_cells_follow_the_amounts(spark):
    # Amounts of every size and sign, each with its neighbours one cent away.
    size = F.pow(F.lit(10.0), F.rand(7) * 17.9)
    sign = F.when(F.rand(8) < 0.3, -1).otherwise(1)
    cents = (size * sign).cast("long")
    amounts = (spark.range(200_000)
               .select(F.explode(F.array(cents - 1, cents, cents + 1)).alias("cents"))
               .select((F.col("cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)")
                       .alias("valor")))
    ordered = Window.orderBy("valor")
    falls = (amounts.withColumn("cell", cell_of(F.col("valor")))
             .withColumn("previous", F.lag("cell").over(ordered))
             .filter(F.col("cell") < F.col("previous")))
    assert falls.count() == 0


def test_ends_of_the_domain(spark):
    ends = ["-9999999999999999.99", "-0.01", "0.00", "0.01", "9999999999999999.99", None]
    frame = spark.createDataFrame([(v,) for v in ends], "v string").select(
        cell_of(F.col("v").cast("decimal(18,2)")).alias("cell"))
    low, minus, zero, plus, high, null = [r.cell for r in frame.collect()]
    assert (minus, zero, plus, null) == (-1, 0, 1, NULL_CELL)
    assert high == -low and 2 * high + 2 <= MAX_CELLS and null < low
