"""Queries over the supplied tables, grouped by the operators they use."""

from importlib import import_module

AREAS = ["restriction", "ligation", "annotation", "translation", "library", "assembly", "sources", "isoform", "reading", "kernel"]


def all_queries():
    from strandlake.plans.catalog import CATALOG

    for area in AREAS:
        import_module(f"strandlake.plans.{area}_queries")
    return CATALOG
