"""Registry of the corpus queries; a query name maps to its run function and, where SQL can express it, its SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of the package whose queries are registered.
AREAS = [
    "topk_search", "quality", "vector_dedup", "secrets", "quotes", "url_filter", "packing", "near_dedup", "licenses", "mixing",
    "pii", "fill_middle", "hard_negatives",
]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under ``name``."""

    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def load():
    for area in AREAS:
        import_module(f"strandlake.llm.{area}")
    return QUERIES, SQL
