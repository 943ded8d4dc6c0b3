"""Removal of repeated blocks of lines, in built-in expressions only.

Lines are cut into chunks by content. A hash rolls over the hashes of two neighbouring lines
with a word; where ``divisor`` divides it, the later line is a boundary, and a chunk reaches
from one boundary to the next, both included. Boundaries depend on nothing around them, so a
block is cut alike wherever it stands, and chunks overlap by a line, so what repeats across
neighbouring chunks is covered as one run. Chunks whose hash occurs more than once
are compared byte for byte, and all but the first occurrence (least doc_id, then place) are
taken out.

With a divisor above 1 there are fewer and longer chunks, and blocks without two boundaries
inside are missed: most short ones. ``DIVISOR`` is 1: every line with a word is a boundary, and all lines of every run of
two or more that stands earlier are found.

Only hashes are counted in the first pass; chunk texts travel for repeated hashes alone.
Counting and finding first occurrences combine before the shuffle, and the joins read
written tables, so Spark can split the rows of a block that very many documents share. Joins
are merge joins at every size: one plan, whether few blocks repeat or many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, steps, table

#: One line in so many is a boundary.
DIVISOR = 1
_KEY = ["doc_id", "text_key"]
_WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    """28 bits of a line."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(text_lines: Column, divisor: int = DIVISOR) -> Column:
    """(first line, number of lines) of every chunk: from a boundary to the next one."""
    def boundaries(at: Column) -> Column:
        if divisor == 1:
            return at

        def rolled(n: Column) -> Column:
            before = F.coalesce(line_hash(F.get(text_lines, F.get(at, n - 1))), F.lit(0))
            return 31 * before + line_hash(F.get(text_lines, F.get(at, n)))
        return F.filter(at, lambda line, n: rolled(n) % divisor == 0)

    def spans(at: Column) -> Column:
        return F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda last, k: F.struct(
            F.get(at, k).alias("first"), (last - F.get(at, k) + 1).alias("size")))

    with_words = F.filter(F.sequence(F.lit(0), F.size(text_lines) - 1),
                          lambda i: F.get(text_lines, i).rlike(_WORD))
    return _let(_let(with_words, boundaries), spans)


def _pieces(docs: DataFrame, divisor: int) -> DataFrame:
    """A row per chunk, with its text."""
    cut = docs.select(*_KEY, F.split("text", "\n").alias("lines")).select(
        *_KEY, "lines", chunks(F.col("lines"), divisor).alias("chunks"))
    return cut.select(*_KEY, F.explode(F.transform("chunks", lambda c: F.struct(
        c["first"].alias("first"), c["size"].alias("size"),
        F.array_join(F.slice("lines", c["first"] + 1, c["size"]), "\n").alias("chunk")))).alias("c")
    ).select(*_KEY, "c.*").withColumn("hash", F.xxhash64("chunk"))


def _place() -> Column:
    """First come ids, least first, then rows without one."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "first")


def repeated_lines(docs: DataFrame, id_column: str, text_column: str, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, text_key, lines_gone): numbers of the lines to take out, a row per document.

    A chunk that overlaps its own first occurrence stays.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                         F.col(text_column).cast("string").alias("text"),
                         F.xxhash64(F.col(text_column).cast("string")).alias("text_key"))
    pieces = _pieces(source, divisor)
    with steps(docs.sparkSession) as keep:
        repeated = settle(pieces.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
        candidates = settle(pieces.join(repeated.hint("merge"), "hash", "left_semi"))
        owners = settle(candidates.groupBy("hash", "chunk").agg(F.min(_place()).alias("owner"),
                                                                F.count("*").alias("n"))
                        .where("n > 1").drop("n"))
        overlaps = (F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("text_key") == F.col("owner.text_key"))
                    & (F.col("first") < F.col("owner.first") + F.col("size")))
        gone = (candidates.join(owners.hint("merge"), ["hash", "chunk"]).where(~overlaps)
                .select(*_KEY, F.sequence("first", F.col("first") + F.col("size") - 1).alias("lines")))
        return keep(gone.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("lines_gone")))


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    divisor: int = DIVISOR) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated chunks, and n_lines and
    n_removed_lines beside it.

    A NULL text stays NULL and has no lines; an empty text is one empty line. Rows that share
    doc_id and text are one document and keep or lose the same lines. Rows without a doc_id
    come after all others. A text may become empty. Columns of ``docs`` that are called like
    one of the counts stay, and the count's name gets a ``_``. An empty table gives no rows.
    """
    gone = repeated_lines(docs, id_column, text_column, divisor).select(
        F.col("doc_id").alias("__dedup_id"), F.col("text_key").alias("__dedup_key"), F.col("lines_gone").alias("__dedup_gone"))
    text = F.col(text_column).cast("string")
    joined = docs.join(gone.hint("merge"), F.col(id_column).cast("long").eqNullSafe(F.col("__dedup_id"))
                       & (F.xxhash64(text) == F.col("__dedup_key")), "left")
    cut = joined.withColumn("__dedup_lines", F.split(text, "\n"))
    rest = F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__dedup_lines") - 1), "__dedup_gone"),
        lambda i: F.get("__dedup_lines", i)), "\n")
    lines, removed = _free("n_lines", docs.columns), _free("n_removed_lines", docs.columns)
    return (cut.withColumn(lines, F.coalesce(F.size("__dedup_lines"), F.lit(0)).cast("long"))
            .withColumn(removed, F.coalesce(F.size("__dedup_gone"), F.lit(0)).cast("long"))
            .withColumn(text_column, F.when(F.col("__dedup_gone").isNull(), text).otherwise(rest))
            .drop("__dedup_id", "__dedup_key", "__dedup_gone", "__dedup_lines"))


def op5_line_dedup(spark, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed_lines", "text")


OP5_SQL = """
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM split),
worded AS (
  SELECT doc_id, ls, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM lines WHERE regexp_matches(ls[i + 1], '[^\\x20\\x09-\\x0D]')),
chunks AS (
  SELECT doc_id, i, j, array_to_string(ls[i + 1:j + 1], chr(10)) AS chunk FROM worded WHERE j IS NOT NULL),
owned AS (
  SELECT *, first_value(doc_id) OVER earliest AS owner, first_value(i) OVER earliest AS owner_i
  FROM chunks WINDOW earliest AS (PARTITION BY chunk ORDER BY doc_id, i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM owned
  WHERE doc_id > owner OR i >= owner_i + (j - i + 1)),
kept AS (
  SELECT l.doc_id, l.i, l.ls[l.i + 1] AS line, g.i IS NOT NULL AS gone
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i),
rest AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
       CASE WHEN d.text IS NOT NULL THEN r.text END AS text
FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id
"""
