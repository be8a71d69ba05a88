"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REFS = "refs AS (SELECT doc_id AS reference_id, source AS guideline_id, lang AS reference_group_id, text, n_chars, least(n_chars // 1000, 5) AS bucket FROM documents)"
PLACED = REFS + ", placed AS (SELECT *, row_number() OVER (PARTITION BY guideline_id ORDER BY bucket, reference_id) - 1 AS pos FROM refs)"
WORDS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+')"
KEYWORDS = f"kw AS (SELECT DISTINCT reference_id, keyword FROM (SELECT reference_id, unnest({WORDS}) AS keyword FROM refs) WHERE length(keyword) >= 6)"
SEEDS = "seeds AS (SELECT guideline_id AS query_id, reference_id FROM refs WHERE reference_id % 50 = 0)"
SECTION = "guideline_id || '::1|' || reference_group_id || '|0/1.' || bucket || '|B' || bucket || '|1/||2'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
