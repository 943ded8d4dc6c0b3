"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import (chat_format, decontaminate, filter_audit, hard_negatives, html_extract, line_dedup, minhash,
               packing, quality_rules, sharding, statements, substring, url_filter, warc)
from .common import reach_workers

Query = Callable[[SparkSession, str], DataFrame]


def _ready(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        reach_workers(spark)
        return query(spark, folder)
    return run


def queries() -> dict[str, Query]:
    found = [sharding.op1_sharding, url_filter.op2_url_filter, quality_rules.op3_quality_rules,
             minhash.op4_minhash_near_dedup, line_dedup.op5_line_dedup,
             substring.op6_substring_dedup, warc.op7_warc, decontaminate.op8_decontamination,
             packing.op9_packing, html_extract.op10_html_extraction,
             hard_negatives.op11_hard_negatives, filter_audit.op12_filter_audit,
             chat_format.op13_chat_formatting]
    return {query.__name__: _ready(query) for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.OP1_SQL, "op5_line_dedup": line_dedup.OP5_SQL,
            "op11_hard_negatives": hard_negatives.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL,
            **statements.STATEMENTS}
