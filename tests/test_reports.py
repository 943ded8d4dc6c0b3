"""Every report over hand-made and random rolls, against DuckDB."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from debtatlas.functions import labels
from debtatlas.operators import distribution, pareto, quality, segments
from debtatlas.plans.reports import REPORTS
from rolls import REPORT_SQL

COMPANY = "{:02d}.000.00{}/000{}-00"


def random_roll(seed, size, amounts):
    rng = random.Random(seed)

    def amount():
        kind = rng.random()
        if kind < 0.1:
            return None
        return rng.choice(amounts) if kind < 0.6 else rng.uniform(min(amounts), max(amounts))

    def document():
        return rng.choice([
            COMPANY.format(rng.randrange(4), rng.randrange(3), rng.randrange(1, 4)),
            f"***.{rng.randrange(100, 105)}.456-**", f"123.456.789-{rng.randrange(90, 99)}",
            "12345", "", None])

    names = ["ACME", "Municipio de Itu", "MUNICÍPIO DE ITU", "Saae Norte", None, "Ótica Zé"]
    trades = ["URBFOR", "Loja", None]
    return [(document(), rng.choice(names), rng.choice(trades), amount(), amount())
            for _ in range(size)]


ROLLS = {
    "empty": [],
    "nulls": [(None, None, None, None, None), (None, None, None, None, None),
              ("", "", None, None, None)],
    "one": [("12345", "A", None, 5, 5)],
    "zero_total": [("a", "A", None, 0, 0), ("b", "B", None, 0, 7), ("c", "C", None, 0, -7)],
    "all_zero": [(str(i), "A", None, 0, 0) for i in range(5)],
    "negative": [(str(i), "A", None, 10, -i - 1) for i in range(9)],
    "mixed_signs": [(str(i), "A", None, 10, v) for i, v in
                    enumerate([50, 30, 20, 10, -5, -5, -5, -20, -20, -30, 0, None])],
    "even_median": [("a", "A", "Urbfor", 1, 0.02), ("b", "B", "Urbfor", 1, 0.03),
                    ("c", "C", None, 1, -0.01), ("d", "D", None, 1, -0.02)],
    "dominant": [("a", "A", None, 1000, 900)] + [(str(i), "B", None, 10, 10) for i in range(10)],
    "ties_over_limits": [(str(i % 7), "A", None, 3, 1) for i in range(100)],
    "negative_ties": [("a", "A", None, 3, 100)] + [(str(i), "A", None, 3, -1) for i in range(60)],
    "identical": [("12345", "A", "T", 2, 1)] * 50,
    "duplicated_branch": [("12.345.678/0001-00", "A", None, 5, 3)] * 2,
    "big_amounts": [(str(i), "A", None, f"{7000000000000 - i}.99", f"{6999999999999 - 3 * i}.51")
                    for i in range(12)],
    "random_positive": random_roll(1, 400, [0.01, 10, 10.5, 2500, 1e6]),
    "random_signed": random_roll(2, 400, [-500, -0.01, 0, 0.01, 10, 700]),
    "random_small": random_roll(3, 37, [0.01, 0.02, 0.03]),
}


# Reports whose arithmetic depends on the amounts; the others restate rows or build on these.
STATISTICS = ["key_audit", "dedupe", "segment_key_audit", "portfolio_table", "profile_measures", "macro_metrics", "entity_summary", "corporate_groups",
              "profile_summary", "sector_summary", "pareto_rows", "pareto_summary"]
VARIED = ["empty", "nulls", "zero_total", "mixed_signs", "random_positive", "random_signed"]
CROWDED = ["nulls", "ties_over_limits", "negative_ties", "identical", "random_positive",
           "random_signed"]


@pytest.mark.parametrize("roll_name, name", [
    (roll_name, name) for roll_name in ROLLS for name in REPORTS
    if name in STATISTICS or roll_name in VARIED])
def test_report(make_roll, roll_name, name):
    roll = make_roll(ROLLS[roll_name])
    roll.check(name, REPORTS[name](roll.silver))


@pytest.mark.parametrize("slices", ["1", "16"])
@pytest.mark.parametrize("roll_name", CROWDED)
def test_ranks_do_not_depend_on_the_slices(spark, make_roll, roll_name, slices):
    """With more slices than values, one document or amount covers many of them."""
    kept = {name: spark.conf.get(name) for name in (
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        roll = make_roll(ROLLS[roll_name])
        roll.check("pareto_rows", pareto.pareto_rows(roll.silver))
        roll.check("key_audit", quality.key_audit(roll.silver))
        roll.check("segment_key_audit", REPORTS["segment_key_audit"](roll.silver))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_median_is_exact_beyond_double_precision(make_roll):
    amounts = [f"{999999999999999 - 3 * i}.51" for i in range(12)]
    silver = make_roll([(str(i), "A", None, v, v) for i, v in enumerate(amounts)]).silver
    assert REPORTS["macro_metrics"](silver).first().mediana_fgts == Decimal("999999999999983.01")


def test_every_report_has_a_statement():
    assert set(REPORTS) == set(REPORT_SQL)


def test_published_identities(make_roll):
    silver = make_roll(ROLLS["random_positive"]).silver
    macro = REPORTS["macro_metrics"](silver).first()
    for name in ("entity_summary", "profile_summary", "sector_summary", "pareto_summary"):
        rows = REPORTS[name](silver).collect()
        assert sum(r.total_devedores for r in rows) == macro.total_registros
        assert sum(r.montante_fgts for r in rows) == macro.montante_total_fgts
        assert abs(sum(r.pct_montante_fgts for r in rows) - 100) <= 0.01 * len(rows)
    tiers = REPORTS["pareto_summary"](silver).collect()
    for upper, lower in zip(tiers, tiers[1:]):
        assert lower.rank_inicial == upper.rank_final + 1
    kept, dropped = REPORTS["dedupe"](silver).count(), REPORTS["key_audit"](silver).count()
    assert kept + dropped == macro.total_registros
    for group in REPORTS["corporate_groups"](silver).collect():
        assert (group.qtd_matrizes_inscritas + group.qtd_filiais_inscritas
                == group.total_estabelecimentos)


def test_only_records_of_repeated_keys_are_ranked(spark, make_roll, monkeypatch):
    """Keys that occur once are gone before anything is put in order."""
    seen = []
    ranked = quality.position_within

    def watch(rows, key, order):
        seen.append(rows.count())
        return ranked(rows, key, order)

    monkeypatch.setattr(quality, "position_within", watch)
    silver = make_roll([(str(i), "A", None, 1, i) for i in range(40)]
                       + [("7", "B", None, 1, 1), (None, "C", None, 1, 1), (None, "D", None, 1, 1)]).silver
    assert [(r.cpf_cnpj, r.indice_duplicidade) for r in quality.key_audit(silver).collect()] == [
        ("7", 2), (None, 2)]
    assert seen == [4]


def test_key_and_order_are_arguments(make_roll):
    silver = make_roll([("a", "A", "T", 1, 5), ("b", "A", "T", 2, 5), ("c", "A", None, 3, 5), ("d", "A", None, 4, 5),
                        ("e", "A", "T", 9, None)]).silver
    by_name = quality.key_audit(silver, ["nome_devedor", "nome_fantasia"], [F.desc("cpf_cnpj")])
    assert [(r.cpf_cnpj, r.indice_duplicidade) for r in by_name.collect()] == [("c", 2), ("b", 2), ("a", 3)]
    kept = quality.dedupe(silver, ["nome_devedor", "nome_fantasia"], [F.desc("cpf_cnpj")])
    assert sorted(r.cpf_cnpj for r in kept.collect()) == ["d", "e"]
    wide = silver.withColumn("extra", F.lit(1))
    assert "extra" in quality.dedupe(wide, "nome_devedor", columns=wide.columns).columns


def test_four_reports_from_two_scans(spark, make_roll):
    """What the cube gives is what each report gives, and the roll is read twice in all."""
    from debtatlas.operators import portfolio
    silver = make_roll(ROLLS["random_signed"]).silver
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    schema = silver.schema
    watched = silver.coalesce(1).mapInArrow(counted, schema)
    reports = portfolio.portfolio_reports(watched)
    for name, frame in reports.items():
        assert frame.collect() == REPORTS[name](silver).collect(), name
    assert reads.value == 2


def test_a_crowded_middle_cell_is_split(spark):
    """A million amounts of one cell: the median is exact, and no fine code holds many."""
    low = 10 ** 12
    rows = spark.range(1_000_000).select(
        ((F.lit(low) + F.col("id") * 600 + F.col("id") % 7).cast("decimal(20,0)") / 100)
        .cast("decimal(18,2)").alias("valor"))
    coded = rows.withColumn("cell", distribution.cell_of(F.col("valor")))
    first = coded.groupBy("cell").count().orderBy(F.desc("count")).first()
    assert first["count"] > 500_000
    fullest = (coded.groupBy("cell", distribution.fine_code(F.col("cell"), F.col("valor")).alias("f"))
               .count().agg(F.max("count")).first()[0])
    assert fullest <= 2 ** 13
    cells = distribution.cell_totals(rows, "valor")
    cents = sorted(low + i * 600 + i % 7 for i in (499_999, 500_000))
    got = distribution.exact_median(rows, "valor", cells).first().mediana
    assert got == Decimal(sum(cents) // 2) / 100


def test_fine_codes_follow_the_amounts(spark):
    size = F.pow(F.lit(10.0), F.rand(7) * 17.9)
    cents = (size * F.when(F.rand(8) < 0.4, -1).otherwise(1)).cast("long")
    rows = (spark.range(100_000).select(F.explode(F.array(cents - 1, cents, cents + 1)).alias("c"))
            .select((F.col("c").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("v"))
            .withColumn("cell", distribution.cell_of(F.col("v")))
            .withColumn("f", distribution.fine_code(F.col("cell"), F.col("v"))))
    before = Window.partitionBy("cell").orderBy("v")
    assert rows.withColumn("p", F.lag("f").over(before)).filter("f < p").count() == 0


def test_mean_is_the_same_in_both_reports(make_roll):
    for rows in ROLLS.values():
        silver = make_roll(rows).silver
        assert (REPORTS["dispersion"](silver).first().ticket_medio_fgts
                == REPORTS["macro_metrics"](silver).first().ticket_medio_fgts)


def test_members_are_all_there(make_roll):
    silver = make_roll(ROLLS["random_positive"]).silver
    for name, rows, label, outcome in (
            ("public_sector_members", segments.sector_rows, "esfera_institucional", labels.PUBLIC_SECTOR),
            ("person_members", segments.entity_rows, "tipo_pessoa", labels.PERSON)):
        every = rows(silver).filter(F.col(label) == outcome).count()
        assert REPORTS[name](silver).count() == every > 30
    assert segments.segment_members(
        segments.entity_rows(silver), "tipo_pessoa", labels.PERSON, 3).count() == 3
