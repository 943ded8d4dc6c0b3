"""Quality rules as a short-circuit cascade, in built-in expressions only.

A rule is a column that is true for a text it rejects. What a rule costs and how much it
rejects is measured on a random sample; rules are then tried by rejection per cost, and a
text that one rule rejects is not shown to the next (nested CASE). The order changes the
work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table

#: Expected rows of the sample that costs and selectivities are taken from.
SAMPLE_ROWS = 2_000
MIN_WORDS = 10
REPEAT_WINDOW, REPEAT_PERCENT = 5, 20
SYMBOLS = r"[#*$%&|<>]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it is read for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(text_words: Column) -> Column:
    return F.length(F.array_join(text_words, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def repeated_lines(text_lines: Column) -> Column:
    return (F.size(text_lines) - F.size(F.array_distinct(text_lines))).cast("long")


def repeated_words(text_words: Column) -> Column:
    """Words covered by five-word windows that the text holds twice or more.

    Texts whose windows all differ are done after hashing; only the others sort theirs.
    """
    last = REPEAT_WINDOW - 1

    def covered(hashes: Column) -> Column:
        def same(ordered: Column) -> Column:
            return F.filter(ordered, lambda x, i: (
                F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))))

        def width(places: Column) -> Column:
            return F.aggregate(
                F.transform(places, lambda x, i: F.least(
                    F.lit(REPEAT_WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(REPEAT_WINDOW)))),
                F.lit(0).cast("long"), lambda total, x: total + x)

        marked = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        places = _let(F.sort_array(marked), lambda ordered: F.sort_array(
            F.transform(same(ordered), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")
                      ).otherwise(_let(places, width))

    windows = F.when(F.size(text_words) > last, F.transform(
        F.slice(text_words, 1, F.greatest(F.size(text_words) - last, F.lit(0))),
        lambda word, i: F.xxhash64(word, *(F.get(text_words, i + k) for k in range(1, REPEAT_WINDOW)))))
    return F.coalesce(_let(windows, covered), F.lit(0).cast("long"))


def stutters(text_words: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(text_words, lambda word, i: F.coalesce(
        F.get(text_words, i - 1) == word, F.lit(False))))


class Text:
    """A text with its words and lines, which all rules share."""

    def __init__(self, text: Column, text_words: Column, text_lines: Column) -> None:
        self.text, self.words, self.lines = text, text_words, text_lines


def split_up(docs: DataFrame, text_column: str) -> tuple[DataFrame, Text]:
    """``docs`` with the words and lines of every text beside it; NULL counts as empty."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    names = ("__text", "__words", "__lines")
    return (docs.withColumn(names[0], text).withColumn(names[1], words(F.col(names[0])))
            .withColumn(names[2], lines(F.col(names[0]))), Text(*map(F.col, names)))


#: Rules beside the two of the base; each rejects where it is true.
RULES: dict[str, Callable[[Text], Column]] = {
    "symbols": lambda t: 100 * symbols(t.text) > 5 * word_chars(t.words),
    "repeated_lines": lambda t: 2 * repeated_lines(t.lines) > F.size(t.lines),
    "stutter": lambda t: 5 * stutters(t.words) > F.size(t.words),
    "few_letters": lambda t: 5 * F.length(F.regexp_replace(t.text, r"[^\p{L}]+", "")) < 2 * word_chars(t.words),
    "long_words": lambda t: word_chars(t.words) > 30 * F.size(t.words),
}
BASE_RULES: dict[str, Callable[[Text], Column]] = {
    "few_words": lambda t: F.size(t.words) < MIN_WORDS,
    "repeats": lambda t: 100 * repeated_words(t.words) > REPEAT_PERCENT * F.size(t.words),
}


def measure(docs: DataFrame, text_column: str, rules: dict) -> dict[str, tuple[float, float]]:
    """(seconds, rejected share) of every rule on a random sample of about ``SAMPLE_ROWS``."""
    total = docs.count()
    if not total:
        return {name: (1.0, 0.0) for name in rules}
    sample = settle(docs.select(F.col(text_column).cast("string").alias("text"))
                    .sample(fraction=min(1.0, SAMPLE_ROWS / total), seed=11))
    parts, text = split_up(sample, "text")
    parts = settle(parts.coalesce(1))

    def run(rule: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = parts.agg(F.avg(rule.cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    run(F.lit(False))
    idle = run(F.length(text.text) + F.size(text.words) + F.size(text.lines) < 0)[0]
    found = {}
    for name, rule in rules.items():
        seconds, share = run(rule(text))
        found[name] = (max(seconds - idle, 1e-3), share)
    return found


def in_order(measured: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejection per cost first."""
    return sorted(measured, key=lambda name: (-measured[name][1] / measured[name][0], name))


def first_rejection(text: Text, rules: dict, order: list[str]) -> Column:
    """Name of the first rule that rejects, NULL if none does."""
    found = F.lit(None).cast("string")
    for name in reversed(order):
        found = F.when(rules[name](text), F.lit(name)).otherwise(found)
    return found


def passing(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows that no rule rejects, all columns as they are.

    NULL, empty and blank texts have too few words. Repeated rows are judged one by one; an
    empty table stays empty.
    """
    rules = {**BASE_RULES, **RULES}
    order = in_order(measure(docs, text_column, rules))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # bound inside the expression: a filter on a column of words would be moved below it, and
    # the words would then be taken anew for every element that a rule looks at
    parts = F.struct(text.alias("text"), words(text).alias("words"), lines(text).alias("lines"))
    return docs.where(_let(parts, lambda t: first_rejection(
        Text(t["text"], t["words"], t["lines"]), rules, order).isNull()))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    NULL texts count as empty; doc_id is carried as it is. The base is judged from the counts;
    the other rules are tried, in measured order, only for texts that pass it. Other columns
    are ignored, an empty table gives no rows.
    """
    order = in_order(measure(docs, text_column, RULES))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))

    def verdict(parts: Text, counts: Column) -> Column:
        base = ((counts["n_words"] < MIN_WORDS)
                | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"]))
        kept = F.when(base, F.lit(False)).otherwise(first_rejection(parts, RULES, order).isNull())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*[counts[name].alias(name) for name in names],
                        base.alias("base_failed"), kept.alias("kept"))

    def counted(bound: Column) -> Column:
        parts = Text(bound["text"], bound["words"], bound["lines"])
        counts = F.struct(
            F.size(parts.words).cast("long").alias("n_words"), word_chars(parts.words).alias("word_chars"),
            symbols(parts.text).alias("n_symbols"), repeated_lines(parts.lines).alias("n_dup_lines"),
            repeated_words(parts.words).alias("n_repeat_words"))
        return _let(counts, lambda c: verdict(parts, c))

    # bound inside the expression, for what ``passing`` says
    bound = F.struct(text.alias("text"), words(text).alias("words"), lines(text).alias("lines"))
    return docs.select(F.col(id_column).alias("doc_id"), _let(bound, counted).alias("judged")).select(
        "doc_id", "judged.*")


def op3_quality_rules(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))
