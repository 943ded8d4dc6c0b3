"""Concentration of the selected debt: ranking, running totals and tiers.

The roll is put in order by slices, largest amount first, then by document and name; a
slice starts from the count and sum of those before it. No step sorts it in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from debtatlas.functions.money import (
    MONEY, WIDE_MONEY, percent_of, ratio, ratio_percent)
from debtatlas.operators.distribution import (
    Handful, amount_standing, amounts_in, cell_totals, median_of, middle_cells, part_standing)
from debtatlas.operators.ranking import SERIAL, SLICE, sliced
from debtatlas.operators.segments import summarise
from debtatlas.session import settle

SELECTED = "valor_divida_selecionada"

# Tiers by running share of the total, and the tier of the rest.
TIERS = (
    (0.50, "1. Top 50% (Hiperconcentrado)"),
    (0.80, "2. Faixa 50% a 80% (Pareto Core)"),
)
TAIL = "3. Cauda Longa (Últimos 20%)"


def _tier(running: Column, total: Column) -> Column:
    """The record that crosses a limit belongs to the next tier."""
    share = ratio(running, total)
    (first_limit, first_label), *others = TIERS
    label = F.when(share <= F.lit(first_limit), first_label)
    for limit, name in others:
        label = label.when(share <= F.lit(limit), name)
    return label.otherwise(TAIL)


# --- rows ---------------------------------------------------------------------------

def pareto_rows(silver: DataFrame) -> DataFrame:
    """Each record with its rank, running total, share and tier."""
    order = [F.desc_nulls_last(SELECTED), F.asc_nulls_last("cpf_cnpj"),
             F.asc_nulls_last("nome_devedor")]
    cut = sliced(silver.select("cpf_cnpj", "nome_devedor", SELECTED), order)
    offsets = part_standing(
        cut.groupBy(SLICE).agg(F.count(F.lit(1)).alias("n"),
                               F.sum(SELECTED).cast(WIDE_MONEY).alias("soma")),
        F.col(SLICE)).select(SLICE, "n_antes", "soma_antes", "total")
    here = Window.partitionBy(SLICE).orderBy(*order, SERIAL)
    so_far = F.sum(SELECTED).over(here.rowsBetween(Window.unboundedPreceding, 0))
    running = F.col("soma_antes") + F.coalesce(so_far, F.lit(0))
    return (cut.join(F.broadcast(offsets), SLICE)
            .withColumn("ranking", F.col("n_antes") + F.row_number().over(here))
            .withColumn("soma_acumulada_fgts",
                        F.when(F.col("total").isNotNull(), running).cast(WIDE_MONEY))
            .select("cpf_cnpj", "nome_devedor", SELECTED, "ranking",
                    "soma_acumulada_fgts",
                    F.col("total").alias("montante_global_fgts"),
                    ratio_percent(F.col("soma_acumulada_fgts"), F.col("total"))
                    .alias("pct_acumulado_fgts"),
                    _tier(F.col("soma_acumulada_fgts"), F.col("total")).alias("faixa_pareto")))


# --- tiers --------------------------------------------------------------------------

def _copies_within(limit: float) -> str:
    """How many of the ``n`` equal amounts keep the running share at or below ``limit``.

    The share moves one way along equal amounts, so only an amount whose first and
    last copy disagree is searched, by halving.
    """
    def inside(j: str) -> str:
        running = f"cast(soma_antes + {j} * coalesce(valor, 0) AS double)"
        return f"coalesce(try_divide({running}, cast(total AS double)) <= {limit}D, false)"

    middle = "shiftright(span.lo + span.hi, 1)"
    like_first = f"""aggregate(
        sequence(1, 63), struct(1L AS lo, n AS hi),
        (span, _) -> if({inside(middle)} = {inside('1')},
                        struct({middle} AS lo, span.hi AS hi),
                        struct(span.lo AS lo, {middle} AS hi)),
        span -> span.lo)"""
    return f"""CASE WHEN {inside('1')} AND {inside('n')} THEN n
                    WHEN NOT {inside('1')} AND NOT {inside('n')} THEN 0L
                    WHEN {inside('1')} THEN {like_first}
                    ELSE n - {like_first} END"""


def _split_by_tier(standing: DataFrame) -> DataFrame:
    """Divide the copies of each amount among the tiers."""
    limits = [f"{_copies_within(limit)} AS ate_{i}" for i, (limit, _) in enumerate(TIERS)]
    labels = [name for _, name in TIERS] + [TAIL]
    bounds = ["0L", *[f"ate_{i}" for i in range(len(TIERS))], "n"]
    # Shares fall along equal amounts when amount and total differ in sign; the
    # copies of the lowest tier then come last.
    falling = "coalesce((valor < 0) != (total < 0), false)"
    pieces = [f"""('{label}', {high} - {low}, n_antes + if({falling}, n - {high}, {low}))"""
              for label, low, high in zip(labels, bounds, bounds[1:])]
    return (standing
            .selectExpr("*", *limits)
            .selectExpr("cell", "valor", f"inline(array({', '.join(pieces)}))")
            .toDF("cell", "valor", "faixa_pareto", "n", "antes")
            .filter("n > 0"))


def _maybe_middle(standing: DataFrame) -> Column:
    """Whether a tier's middle amounts may lie in a cell, as far as whole cells tell.

    Of a cut cell only the most it can give a tier is known: all its rows with an amount. A
    cell is out of the question where, even so, more of its tier lies on one side than on the
    other side and in the cell together. So what is looked into beyond the cells of the
    middles holds no more rows than the cut cells do.
    """
    own = Window.partitionBy("tier")
    everyone = Window.partitionBy()
    below, above = [w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1) for w in (own, everyone)]
    whole = F.when(~F.col("cut"), F.col("com_valor")).otherwise(0)
    loose = F.when(F.col("cut"), F.col("com_valor")).otherwise(0)
    before, loose_before = [F.coalesce(F.sum(n).over(w), F.lit(0)) for n, w in ((whole, below), (loose, above))]
    after = F.sum(whole).over(own) - before - F.col("com_valor")
    loose_after = F.sum(loose).over(everyone) - loose_before
    return (~F.col("cut") & (F.col("com_valor") > 0)
            & (before <= after + loose_after + F.col("com_valor"))
            & (after <= before + loose_before + F.col("com_valor")))


def pareto_summary(silver: DataFrame) -> DataFrame:
    """Per tier: first and last rank, counts, sums, shares, mean and median.

    Amounts in a cell have one sign, so the running share moves one way through it and a
    cell whose two ends agree lies in one tier. The cells that a limit cuts, and those that
    may hold a tier's median, are looked into in a second scan; the roll is read twice.
    """
    rows = silver.select(SELECTED)
    placed = part_standing(cell_totals(rows, SELECTED), F.desc("cell"))
    at_top = F.col("soma_antes") + F.coalesce(F.col("maior"), F.lit(0))
    at_end = F.col("soma_antes") + F.coalesce(F.col("soma"), F.lit(0))
    ends = placed.withColumn("tier", _tier(at_end, F.col("total"))).withColumn(
        "cut", F.col("tier") != _tier(at_top, F.col("total")))
    standing = settle(ends.withColumn("middle", _maybe_middle(ends)))
    amounts = settle(amounts_in(
        rows, SELECTED, standing.filter("cut or middle").select("cell", "cut"), ["cell"]))
    whole = standing.filter(~F.col("cut")).select(
        F.col("tier").alias("faixa_pareto"), "cell", F.lit(None).cast(MONEY).alias("valor"),
        "n", F.col("n_antes").alias("antes"), "com_valor", "soma")
    amounts_cut = amounts.filter("cut").select(
        "cell", "valor", F.col("n_valor").alias("n"),
        (F.col("n_valor") * F.col("valor")).cast(WIDE_MONEY).alias("soma"))
    split = settle(_split_by_tier(amount_standing(amounts_cut, standing)).select(
        "*", F.col("n").alias("com_valor"),
        (F.col("n") * F.col("valor")).cast(WIDE_MONEY).alias("soma")))
    pieces = (whole.unionByName(split)
              .withColumn("maior", F.lit(None).cast(MONEY))
              .withColumn("de", F.col("antes") + 1)
              .withColumn("ate", F.col("antes") + F.col("n")))

    middles = Handful(middle_cells(
        pieces.groupBy("faixa_pareto", "cell").agg(F.sum("com_valor").alias("com_valor")),
        ["faixa_pareto"]))
    here = middles.holds(F.col("cell"))
    in_whole = (amounts.filter(~F.col("cut") & here)
                .join(F.broadcast(standing.filter("middle").filter(here)
                                  .select("cell", F.col("tier").alias("faixa_pareto"))), "cell"))
    in_split = split.filter(here).withColumn("n_valor", F.col("n"))
    columns = ["faixa_pareto", "cell", "valor", "n_valor"]
    medians = median_of(middles.attach(
        in_whole.select(*columns).unionByName(in_split.select(*columns)), ["faixa_pareto", "cell"]),
        ["faixa_pareto"])
    return (summarise(pieces, medians, "faixa_pareto",
                      [F.min("de").alias("rank_inicial"), F.max("ate").alias("rank_final")])
            .select("faixa_pareto", "rank_inicial", "rank_final", "total_devedores",
                    "pct_devedores", "montante_fgts", "pct_montante_fgts",
                    "ticket_medio_fgts", "mediana_fgts")
            .orderBy("faixa_pareto"))


def pareto_cumulative(silver: DataFrame) -> DataFrame:
    """Tiers accumulated from the top: debtors and amount reached with each of them."""
    so_far = Window.orderBy("faixa_pareto")  # one row per tier
    everyone = Window.partitionBy()
    tiers = pareto_summary(silver)
    reached = tiers.select(
        "faixa_pareto",
        F.sum("total_devedores").over(so_far).alias("devedores_acumulados"),
        F.sum("montante_fgts").over(so_far).cast(WIDE_MONEY).alias("montante_acumulado"),
        F.sum("total_devedores").over(everyone).alias("todos"),
        F.sum("montante_fgts").over(everyone).alias("montante"))
    return reached.select(
        "faixa_pareto", "devedores_acumulados",
        percent_of(F.col("devedores_acumulados"), F.col("todos")).alias("pct_devedores_acumulado"),
        "montante_acumulado",
        percent_of(F.col("montante_acumulado"), F.col("montante")).alias("pct_montante_acumulado"))


def top_share(silver: DataFrame, k: int) -> DataFrame:
    """What the ``k`` largest debtors owe, and its share of everything: one row."""
    largest = silver.select(SELECTED).orderBy(F.desc_nulls_last(SELECTED)).limit(k)
    top = largest.agg(F.count(F.lit(1)).alias("devedores"),
                      F.sum(SELECTED).cast(WIDE_MONEY).alias("montante_fgts"))
    total = silver.agg(F.sum(SELECTED).cast(WIDE_MONEY).alias("total"))
    return (top
            .withColumn("total", total.scalar())
            .select("devedores", "montante_fgts",
                    percent_of(F.col("montante_fgts"), F.col("total")).alias("pct_montante_fgts")))
