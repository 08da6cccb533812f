"""Projection of features onto fragments and other intervals, and batch feature edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.joining import large

BIN = 16384


def _segments(df: DataFrame, start: str, length: str, n: str, bin_width: int) -> DataFrame:
    """Rows per linear stretch ``[seg_lo, seg_hi)`` of a possibly wrapping span and per bin it meets."""
    s = f"pmod({start}, {n})"
    both = (
        f"if({s} + {length} <= {n}, array(named_struct('lo', {s}, 'hi', {s} + {length})), "
        f"array(named_struct('lo', {s}, 'hi', {n}), named_struct('lo', 0L, 'hi', {s} + {length} - {n})))"
    )
    return (
        df.withColumn("_seg", F.explode(F.expr(both)))
        .withColumn("_bin", F.explode(F.expr(f"sequence(_seg.lo div {bin_width}, (_seg.hi - 1) div {bin_width})")))
    )


def project_parts(parts: DataFrame, intervals: DataFrame, bin_width: int = BIN, sizes: DataFrame | None = None) -> DataFrame:
    """Every stretch of a feature part that lies in an interval of the same record.

    ``parts``: ``record_id, feature_id, part_index, start, length, strand``.
    ``intervals``: ``record_id, interval_id, begin, size, n, bottom`` with ``bottom`` true
    for strands read backwards. Spans may wrap. Both sides meet on (record, bin), so a
    chromosome's features spread out; each overlap is reported from one bin only. ``sizes(record_id, n)``, if at
    hand, saves deriving the intervals a second time for the lengths of the records.
    """
    sizes = intervals.select("record_id", "n").distinct() if sizes is None else sizes.select("record_id", "n")
    left = _segments(
        parts.join(large(sizes), "record_id").select("record_id", "feature_id", "part_index", "strand",
                                              F.col("start").alias("p_start"), F.col("length").alias("p_length"), F.col("n").alias("p_n")),
        "p_start", "p_length", "p_n", bin_width,
    ).withColumnRenamed("_seg", "_pseg")
    right = _segments(intervals, "begin", "size", "n", bin_width)
    lo = F.greatest("_seg.lo", "_pseg.lo")
    pairs = (
        left.join(large(right), ["record_id", "_bin"])
        .where("_seg.lo < _pseg.hi and _pseg.lo < _seg.hi")
        .where(F.floor(lo / bin_width) == F.col("_bin"))
        # A turn earlier or later only where the lifted part still meets the interval.
        .withColumn("_shift", F.explode(F.expr(
            "filter(array(-n, 0L, n), k -> p_start + k < begin + size and begin < p_start + k + p_length)")))
        .withColumn("_start", F.col("p_start") + F.col("_shift"))
        .withColumn("_lo", F.greatest("_start", "begin"))
        .withColumn("_hi", F.least(F.col("_start") + F.col("p_length"), F.col("begin") + F.col("size")))
        .where("_lo < _hi")
        # The stretch belongs to the pair of segments in which it begins.
        .where((F.pmod("_lo", "n") >= lo) & (F.pmod("_lo", "n") < F.least("_seg.hi", "_pseg.hi")))
    )
    finish = F.col("begin") + F.col("size")
    flipped = F.when(F.col("strand") == "forward", F.lit("reverse")).when(F.col("strand") == "reverse", F.lit("forward")).otherwise(F.col("strand"))
    return pairs.select(
        "record_id", "interval_id", "bottom", "feature_id", F.col("part_index").alias("source_part"),
        (F.col("_lo") - F.col("_start")).alias("source_offset"),
        F.pmod("_lo", "n").alias("source_start"),
        F.when(F.col("bottom"), finish - F.col("_hi")).otherwise(F.col("_lo") - F.col("begin")).alias("fragment_start"),
        (F.col("_hi") - F.col("_lo")).alias("length"),
        F.when(F.col("bottom"), flipped).otherwise(F.col("strand")).alias("fragment_strand"),
        F.col("topology") if "topology" in intervals.columns else F.lit("linear").alias("topology"),
    )


def project_features(parts: DataFrame, intervals: DataFrame, bin_width: int = BIN, sizes: DataFrame | None = None) -> DataFrame:
    """Coverage of each feature on each interval; features without a retained base are absent.

    ``parts_mapped`` keeps (source part, offset, fragment start, length) in source order and
    ``split_source_parts`` lists parts broken over the ends of a linear interval.
    """
    pieces = project_parts(parts, intervals, bin_width, sizes)
    keys = ["record_id", "interval_id", "bottom", "feature_id"]
    per_part = pieces.groupBy(*keys, "source_part").agg(
        F.count("*").alias("pieces"), F.sum("length").alias("bases"),
        F.first("fragment_strand").alias("fragment_strand"), F.first("topology").alias("topology"),
        F.collect_list(F.struct("source_part", "source_offset", "fragment_start", "length")).alias("mapped"),
    )
    source = parts.groupBy("record_id", "feature_id").agg(F.sum("length").alias("source_bases"))
    return (
        per_part.groupBy(*keys).agg(
            F.first("fragment_strand").alias("fragment_strand"), F.sum("bases").alias("retained_bases"),
            F.array_sort(F.collect_list(F.when((F.col("pieces") > 1) & (F.col("topology") == "linear"), F.col("source_part")))).alias("split_source_parts"),
            F.array_sort(F.flatten(F.collect_list("mapped"))).alias("parts_mapped"),
        )
        .join(large(source), ["record_id", "feature_id"])
        .withColumn("complete", F.col("retained_bases") == F.col("source_bases"))
    )


def fragment_intervals(fragments: DataFrame) -> DataFrame:
    """Both strands of every digest fragment as intervals for projection."""
    sides = F.array(
        *[F.struct(F.col(f"{s}.start").alias("begin"), F.col(f"{s}.length").alias("size"), F.lit(s == "bottom").alias("bottom"))
          for s in ("top", "bottom")]
    )
    return fragments.select("record_id", F.col("fragment_id").alias("interval_id"), "n", "topology", F.inline(sides))


def annotated_digest(parts: DataFrame, fragments: DataFrame, bin_width: int = BIN, sizes: DataFrame | None = None) -> DataFrame:
    """Features of the source on both strands of its digest fragments; ``digest_spans`` is all it needs of them."""
    return project_features(parts, fragment_intervals(fragments), bin_width, sizes)


def core_annotations(parts: DataFrame, cores: DataFrame) -> DataFrame:
    """Features on assembly cores: ``record_id, core_id, start, length, n, orientation``."""
    intervals = cores.select(
        "record_id", F.col("core_id").alias("interval_id"), F.col("start").alias("begin"),
        F.col("length").alias("size"), "n", (F.col("orientation") == "reverse").alias("bottom"),
    )
    return project_features(parts, intervals)
