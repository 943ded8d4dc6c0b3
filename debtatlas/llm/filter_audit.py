"""What each of five filters removes, and what it removes in every order of the five.

A byte transducer reads every text once. A table gives each UTF-8 byte a class; a second
table, indexed by the classes of two neighbouring bytes, gives the step's actions: a word
begins, a word ends, a code point, a capital, a symbol. Both are looked up for all bytes of a
slice at once, the class before a text being that of a blank. The spans of the words go
into an open-addressing hash table in rounds: a word whose slot is taken is compared with
the occupant byte by byte, and moves on if they differ, so distinct words are counted
without trusting the hash.

A document then is five failures, a part and two labels. Only counts per combination of
these go on (32 for each part and pair of labels), and all 120 orders are worked out from
them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import settle, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = b"#$%&*|"

# Classes of bytes, and what a step from one class to the next does.
_BLANK, _PLAIN, _CAPITAL, _SYMBOL, _INNER = range(5)
_BEGINS, _ENDS, _POINT, _UPPER, _MARK = (1 << n for n in range(5))
#: Bytes looked up at a time, and bytes of text whose words share a hash table.
_SLICE = 1 << 18
CHUNK_BYTES = 1 << 20


def _classes() -> np.ndarray:
    kind = np.full(256, _PLAIN, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = _BLANK
    kind[0x41:0x5B] = _CAPITAL
    kind[list(SYMBOLS)] = _SYMBOL
    kind[0x80:0xC0] = _INNER
    return kind


def _actions() -> np.ndarray:
    acts = np.zeros((5, 5), np.uint8)
    for before in range(5):
        for now in range(5):
            acts[before, now] = (
                (_BEGINS if before == _BLANK != now else 0) | (_ENDS if now == _BLANK != before else 0)
                | (_POINT if now != _INNER else 0) | (_UPPER if now == _CAPITAL else 0)
                | (_MARK if now == _SYMBOL else 0))
    return acts.ravel()


CLASSES, ACTIONS = _classes(), _actions()


def transduce(data: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: code points, capitals, symbols; and first byte, end and text of each word."""
    counts = {name: np.zeros(len(limits) - 1, np.int64) for name in ("points", "capitals", "symbols")}
    begins, ends = [], []
    texts = limits[:-1][np.diff(limits) > 0]
    for low in range(0, len(data), _SLICE):
        high = min(low + _SLICE, len(data))
        now = CLASSES[data[low:high]]
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[0] = CLASSES[data[low - 1]] if low else _BLANK
        fresh = texts[(texts >= low) & (texts < high)]
        # a word that the text before ends with stops where this text starts
        open_ends = fresh[(fresh > 0) & (before[fresh - low] != _BLANK)]
        before[fresh - low] = _BLANK
        steps = ACTIONS[before * np.uint8(5) + now]
        begins.append(np.flatnonzero(steps & _BEGINS) + low)
        ends.append(np.sort(np.concatenate([np.flatnonzero(steps & _ENDS) + low, open_ends])))
        first = np.searchsorted(limits, low, "right") - 1
        last = np.searchsorted(limits, high, "left")
        inner = np.clip(limits[first:last + 1], low, high) - low
        for name, action in (("points", _POINT), ("capitals", _UPPER), ("symbols", _MARK)):
            total = np.concatenate([[0], np.cumsum((steps & action) != 0)])
            counts[name][first:last] += np.diff(total[inner])
    starts = np.concatenate(begins) if begins else np.empty(0, np.int64)
    stops = np.concatenate(ends) if ends else np.empty(0, np.int64)
    if len(data) and CLASSES[data[-1]] != _BLANK:
        stops = np.append(stops, len(data))
    owner = np.searchsorted(limits, starts, "right") - 1
    return counts | {"starts": starts, "ends": stops, "owner": owner}


def _same_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words at ``left`` and ``right``, of equal ``sizes``, have equal bytes."""
    same = np.ones(len(left), bool)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
        if stop == at + 1:
            same[at] = bool((data[left[at]:left[at] + sizes[at]] == data[right[at]:right[at] + sizes[at]]).all())
        else:
            size = sizes[at:stop]
            inside = words.spread(size)
            apart = (data[np.repeat(left[at:stop], size) + inside] != data[np.repeat(right[at:stop], size) + inside])
            same[at + np.unique(np.repeat(np.arange(stop - at), size)[apart])] = False
        at = stop
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct words of each text, by a hash table of word spans whose hits are verified."""
    keys = words.mix(words.hash_words(data, starts, ends) ^ words.mix(owner.astype(np.uint64)))
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    slots = np.full(size, -1, np.int64)
    found = np.zeros(len(starts), bool)
    for low in range(0, len(starts), _SLICE):
        waiting = np.arange(low, min(low + _SLICE, len(starts)))
        place = (keys[waiting] & np.uint64(size - 1)).astype(np.int64)
        while len(waiting):
            empty = slots[place] < 0
            # of several words that want a free slot, the first one gets it
            slots[place[empty][::-1]] = waiting[empty][::-1]
            occupant = slots[place]
            own = occupant == waiting
            found[waiting[own]] = True
            sizes = ends[waiting] - starts[waiting]
            alike = ~own & (owner[occupant] == owner[waiting]) & (ends[occupant] - starts[occupant] == sizes)
            some = np.flatnonzero(alike)
            alike[some] = _same_bytes(data, starts[occupant[some]], starts[waiting[some]], sizes[some])
            on = ~own & ~alike
            waiting, place = waiting[on], (place[on] + 1) & (size - 1)
    return np.bincount(owner[found], minlength=texts)


_MEASURES = ("doc_id long, part string, text_key binary, n_words long, n_distinct long, n_chars long, "
             "n_capitals long, n_symbols long")


def _measure(batches):
    for batch, data, limits in words.chunks(batches, "text", CHUNK_BYTES):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        read = transduce(data, limits)
        texts = len(limits) - 1
        yield pa.RecordBatch.from_arrays(
            [column["doc_id"], column["part"], column["text_key"],
             pa.array(np.bincount(read["owner"], minlength=texts)),
             pa.array(distinct_words(data, read["starts"], read["ends"], read["owner"], texts)),
             pa.array(read["points"]), pa.array(read["capitals"]), pa.array(read["symbols"])],
            ["doc_id", "part", "text_key", "n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols"])


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             part_column: str = "lang") -> DataFrame:
    """Per row: doc_id, part, text_key (SHA-256), and counts of words, distinct words, code
    points, capitals and symbols. A NULL text or part is empty."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text")).mapInArrow(_measure, _MEASURES)


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             part_column: str = "lang") -> DataFrame:
    """``measures`` and ``failed``: bit n is set where filter n of ABCDE rejects the document.

    A: few words; B: few distinct ones; C: many capitals; D: a symbol; E: a smaller doc_id has
    the same text. Rows without a doc_id fail E never and make no other row fail it; rows that
    share a doc_id do not make each other fail.
    """
    counted = settle(measures(docs, id_column, text_column, part_column))
    copies = settle(counted.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
                    .where("n > 1").select("text_key", "least"))
    n = F.col("n_words")
    rules = [n < MIN_WORDS,
             100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * n,
             100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_chars"),
             F.col("n_symbols") > 0,
             F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    failed = sum((F.when(rule, 1 << bit).otherwise(0) for bit, rule in enumerate(rules)), F.lit(0))
    return counted.join(copies.hint("merge"), "text_key", "left").withColumn("failed", failed).drop("least", "text_key")


def _orders() -> Column:
    """Every order with, at each step, the filter's bit and the bits before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, bit in enumerate(order):
            rows.append(F.struct(
                F.lit("".join(FILTERS[n] for n in order)).alias("filter_order"), F.lit(step + 1).alias("step"),
                F.lit(1 << bit).alias("own"), F.lit(before).alias("earlier")))
            before |= 1 << bit
    return F.array(*rows)


def interaction(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit from documents with ``doc_id``, ``part`` and ``failed``; see ``audit``."""
    marks = settle(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
                   .where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    counts = settle(failed.select("doc_id", "part", "failed").join(marks.hint("merge"), "doc_id", "left")
                    .groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    mask, own, earlier = F.col("failed"), F.col("own"), F.col("earlier")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(earlier) != 0
    # of the orders of all filters, each filter a document fails comes first of those in equally many
    orders = len(list(permutations(FILTERS)))
    firsts = F.expr(f"n * ({orders} div greatest(bit_count(failed), 1))")
    # the table of orders stands once per part, whatever the number of documents
    steps = counts.withColumn("turn", F.explode(_orders())).select("*", "turn.*")
    return (steps.withColumn("firsts", firsts)
            .groupBy("part", "filter_order", "step").agg(
                total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"),
                total(gone & fails).alias("redundant"), total(mask == own).alias("unique_fails"),
                total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
                total(fails, "firsts").alias("shapley")))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A document is removed at the first step whose filter it fails and is redundant at later
    ones. Repeated rows count each. Several labels of a document count as one that has every
    mark any of them has; documents without a label have none. NULL parts are the empty part.
    Other columns are ignored; no documents give no rows.
    """
    return interaction(failures(docs, id_column, text_column, part_column), labels)


def op12_filter_audit(spark, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _order_values(filters: Sequence[str] = FILTERS) -> str:
    return ", ".join(f"('{''.join(order)}', {step + 1}, '{name}', '{''.join(order[:step])}')"
                     for order in permutations(filters) for step, name in enumerate(order))


OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
judged AS (
  SELECT t.doc_id, part,
         concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN t.doc_id > l.least THEN 'E' ELSE '' END) AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM texts t JOIN least l ON l.text = t.text LEFT JOIN labels b ON b.doc_id = t.doc_id),
steps(filter_order, step, own, earlier) AS (VALUES {_order_values()}),
seen AS (
  SELECT part, filter_order, step, own, fails, good, toxic, contains(fails, own) AS failing,
         length(translate(fails, earlier, '')) < length(fails) AS gone
  FROM judged CROSS JOIN steps),
counted AS (
  SELECT part, filter_order, step, any_value(own) AS own,
         count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed,
         count(*) FILTER (gone AND failing) AS redundant, count(*) FILTER (fails = own) AS unique_fails,
         count(*) FILTER (NOT gone AND failing AND good) AS good_lost,
         count(*) FILTER (NOT gone AND failing AND toxic) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
