"""Joins of tables that grow with the records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """Mark a side of a join as growing with the records: both sides are shuffled and neither is broadcast.

    Rows that come from an ``explode`` and strings spelled by functions count for little in Spark's estimate of sizes, so
    a table of tiles, windows or bases looks small enough to be gathered on the driver until it has been computed there.
    """
    return df.hint("merge")
