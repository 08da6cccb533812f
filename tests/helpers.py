"""Small molecules and brute-force definitions that the operators are checked against."""

from __future__ import annotations

import random

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(TURN)[::-1]


def dna(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


def records(spark, *rows):
    """``(id, sequence, topology)`` rows as a records table."""
    return spark.createDataFrame(
        [(i, str(i), s, len(s), t) for i, s, t in rows],
        "record_id string, name string, sequence string, length bigint, topology string",
    )


def parts(spark, *rows):
    return spark.createDataFrame(
        list(rows), "record_id string, feature_id string, part_index int, start bigint, length bigint, strand string"
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
