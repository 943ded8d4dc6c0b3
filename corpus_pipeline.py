"""A corpus pipeline over ``documents``: every stage reads all that its predecessor kept,
written as Parquet, and all but the last return the columns of ``documents``.

Near copies are documents with at least 80 % of their five-word shingles in common. Empty
tables pass through; what each stage does with NULLs, ties and repeated rows is what its
operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtatlas.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from debtatlas.llm.common import reach_workers, settle, table


def _with_lengths(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.passing(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated blocks of lines; a document of which no word is left goes."""
    cut = line_dedup.without_repeats(docs)
    removed = F.col(cut.columns[-1])
    gone = (removed > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _with_lengths(cut.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)).select(*docs.columns)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    reach_workers(spark)
    dropped = settle(minhash.near_duplicates(docs).where("not kept").select("doc_id"))
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    reach_workers(spark)
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op9_packing`` returns them."""
    reach_workers(spark)
    return packing.pack_with_digests(docs)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", keep_one_of_a_kind),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack_tokens),
]

#: The rules, chunks, links, windows and token plans have no SQL; tests compare each stage
#: with a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
