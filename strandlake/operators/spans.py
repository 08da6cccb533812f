"""Tiles of long molecules, and the bases of many spans fetched through tiles.

A molecule is read as tiles so that a chromosome spreads over tasks and no
operator copies a whole sequence for each of its features or fragments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.joining import large

TILE = 8192


def tile_records(records: DataFrame, overlap: int = 0, step: int = TILE, spread: int = 0) -> DataFrame:
    """``(record_id, topology, length, tile, tile_start, bases)``.

    ``bases`` runs ``overlap`` symbols into the next tile, through the origin on
    circles. One regular-expression pass cuts a record of any size. ``spread``
    redistributes the tiles over that many partitions, for few long molecules.
    """
    wrap = F.when(
        (F.col("topology") == "circular") & F.lit(overlap > 0),
        F.substring(
            F.expr(f"repeat(sequence, cast(ceil({overlap} / length(sequence)) as int))"), 1, overlap
        ),
    ).otherwise(F.lit(""))
    text = F.concat("sequence", wrap)
    cut = F.regexp_extract_all(
        text, F.lit(f"(?=(.{{1,{step + overlap}}})).{{1,{step}}}"), F.lit(1)
    )
    n = F.length("sequence")
    tiles = (
        records.select(
            "record_id",
            "topology",
            n.cast("bigint").alias("length"),
            F.posexplode(F.when(n <= step, F.array(text)).otherwise(cut)).alias("tile", "bases"),
        )
        .withColumn("tile_start", F.col("tile").cast("bigint") * step)
        .where(F.col("tile_start") < F.col("length"))
    )
    return tiles.repartition(spread, "record_id", "tile") if spread else tiles


def motif_offsets(text, regex: str):
    """Zero-based starts of all hits of a regular expression, overlapping ones included.

    The first base of every hit becomes a mark, seen by a look ahead into the unmarked text; the marks' places are
    then read off byte by byte, so the work is the same however many hits there are.
    """
    marked = F.regexp_replace(text, f"(?={regex}).", "#").cast("binary")

    def starts(line):
        at = F.filter(F.sequence(F.lit(0), F.octet_length(line) - 1), lambda i: F.substring(line, i + 1, F.lit(1)) == F.lit(b"#"))
        return F.when(F.octet_length(line) > 0, at).otherwise(F.array().cast("array<int>"))

    # The one-element array binds the text once; repeating the expression would search again.
    return F.transform(F.array(marked), starts)[0]


def attach_bases(
    spans: DataFrame,
    records: DataFrame,
    keys: list[str],
    start: str = "start",
    length: str = "length",
    n: str = "n",
    out: str = "bases",
    step: int = TILE,
) -> DataFrame:
    """Add the forward-strand bases of each span.

    ``spans`` holds ``record_id``, a start (any integer, taken modulo ``n``), a length
    (which may exceed one turn of a circle) and the record length ``n``; ``keys``
    identify a row. A span is cut at tile borders, each piece meets only its own tile,
    and the pieces are joined in order.
    """
    s, size, total = F.pmod(F.col(start), F.col(n)), F.col(length), F.col(n)
    laps = spans.withColumn("_ab_s", s).withColumn(
        "_ab_lap",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(pmod({start}, {n}) + {length} - 1) div {n}"))),
    )
    lo = F.when(F.col("_ab_lap") == 0, F.col("_ab_s")).otherwise(F.lit(0))
    hi = F.least(total, F.col("_ab_s") + size - F.col("_ab_lap") * total)
    pieces = (
        laps.withColumn("_ab_lo", lo)
        .withColumn("_ab_hi", hi)
        .withColumn("_ab_tile", F.explode(F.expr(f"sequence(_ab_lo div {step}, (_ab_hi - 1) div {step})")))
    )
    tiles = tile_records(records, 0, step).select(
        F.col("record_id"), F.col("tile").cast("bigint").alias("_ab_tile"), F.col("bases").alias("_ab_bases")
    )
    first = F.greatest(F.col("_ab_lo") - F.col("_ab_tile") * step, F.lit(0))
    last = F.least(F.col("_ab_hi") - F.col("_ab_tile") * step, F.lit(step))
    piece = F.substring(F.col("_ab_bases"), (first + 1).cast("int"), (last - first).cast("int"))
    rest = [c for c in spans.columns if c not in keys]
    found = pieces.join(large(tiles), ["record_id", "_ab_tile"]).select(
        *spans.columns, F.struct("_ab_lap", "_ab_tile", piece.alias("p")).alias("_ab_piece")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_ab_piece")), lambda x: x["p"]), "")
    grouped = found.groupBy(*keys).agg(
        F.first(F.struct(*rest)).alias("_ab_rest"), joined.alias(out)
    )
    return grouped.select(*keys, *[F.col(f"_ab_rest.{c}").alias(c) for c in rest], out).select(
        *spans.columns, out
    )
