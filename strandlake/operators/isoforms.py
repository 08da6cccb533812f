"""Isoforms of gene loci and their expression over panels of cell lines.

``transcripts``: ``record_id, transcript_id, state, is_mane_select, mrna_feature_id,
cds_feature_id``; ``expression``: one row per measured cell line; ``panel``: one row per
quantifier and cell line with ``reports_zeros``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.joining import large

DEFAULT_QUANTIFIER = "bambu_lr"


def isoforms(transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """Transcripts with exon and coding spans taken from the features, ascending; ones whose
    mRNA feature is gone are left to ``missing_features``."""
    spans = parts.groupBy("record_id", "feature_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    exons = spans.select("record_id", F.col("feature_id").alias("mrna_feature_id"), F.col("spans").alias("exons"))
    cds = spans.select("record_id", F.col("feature_id").alias("cds_feature_id"), F.col("spans").alias("cds"))
    return transcripts.join(large(exons), ["record_id", "mrna_feature_id"]).join(large(cds), ["record_id", "cds_feature_id"], "left").withColumn(
        "cds", F.coalesce("cds", F.array().cast("array<struct<start:bigint,length:bigint>>")))


def missing_features(transcripts: DataFrame, features: DataFrame) -> DataFrame:
    return transcripts.join(large(features.select("record_id", F.col("feature_id").alias("mrna_feature_id"))), ["record_id", "mrna_feature_id"], "left_anti").select("record_id", "transcript_id")


def panel_means(transcripts: DataFrame, expression: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean over the panel's cell lines and the display state, per transcript and quantifier.

    A quantifier that reports zeros skips missing lines; another one means zero by omission.
    Without any measurement, or unless the transcript is quantified, there is no mean. Sums
    are taken over the measured rows, so nothing is expanded to transcripts x cell lines.
    """
    keys = ["record_id", "quantifier"]
    sizes = panel.groupBy(*keys).agg(F.first("reports_zeros").alias("reports_zeros"), F.count("*").alias("lines"))
    cells = expression.join(large(panel.select(*keys, "cell_line").withColumn("listed", F.lit(True))), [*keys, "cell_line"], "left").groupBy(
        *keys, "transcript_id").agg(F.count("*").alias("rows"), F.count("listed").alias("hits"), F.sum(F.when(F.col("listed"), F.col("mean"))).alias("total"))
    base = transcripts.select("record_id", "transcript_id", "state", "is_mane_select").join(large(sizes), "record_id").join(large(cells), [*keys, "transcript_id"], "left")
    values = F.when(F.col("reports_zeros"), F.col("hits")).otherwise(F.col("lines"))
    mean = F.when((F.col("state") == "quantified") & (F.col("rows") > 0) & (values > 0), F.coalesce("total", F.lit(0.0)) / values)
    return base.select("record_id", "transcript_id", "quantifier", "state", "is_mane_select", mean.alias("panel_mean")).withColumn("display", display_state())


def display_state():
    state, mean = F.col("state"), F.col("panel_mean")
    return (
        F.when((state == "quantified") & (mean > 0), F.lit("expressed")).when((state == "quantified") & mean.isNotNull(), F.lit("not_detected"))
        .when(state == "quantified", F.lit("no_data")).when(state == "discoverable", F.lit("discoverable")).otherwise(F.lit("invisible"))
    )


def isoform_order(means: DataFrame) -> DataFrame:
    """Rank of each transcript per locus and quantifier: mean, evidence, MANE, id."""
    evidence = F.when(F.col("state") == "quantified", 0).when(F.col("state") == "discoverable", 1).otherwise(2)
    order = Window.partitionBy("record_id", "quantifier").orderBy(F.desc_nulls_last("panel_mean"), evidence, F.desc("is_mane_select"), "transcript_id")
    return means.withColumn("rank", F.row_number().over(order))


def default_quantifier(panel: DataFrame) -> DataFrame:
    return panel.groupBy("record_id").agg(
        F.coalesce(F.max(F.when(F.col("quantifier") == DEFAULT_QUANTIFIER, F.col("quantifier"))), F.min("quantifier")).alias("quantifier"))


def uncovered_regions(exons: DataFrame, lengths: DataFrame) -> DataFrame:
    """Stretches ``[start, end)`` of each record that no exon covers.

    ``exons``: ``record_id, start, length``; ``lengths``: ``record_id, length``.
    """
    order = Window.partitionBy("record_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = exons.select("record_id", "start", (F.col("start") + F.col("length")).alias("end"))
    # The end of the molecule acts as one more, empty exon.
    tails = lengths.select("record_id", F.col("length").alias("start"), F.col("length").alias("end"))
    return (
        spans.join(large(lengths.select("record_id")), "record_id", "left_semi").distinct().unionByName(tails)
        .withColumn("at", F.coalesce(F.max("end").over(order), F.lit(0)))
        .where("start > at").select("record_id", F.col("at").alias("start"), F.col("start").alias("end"))
    )


def exon_pieces(views: DataFrame) -> DataFrame:
    """Exons cut at the edges of the coding parts, each piece flagged; ``views`` from ``isoforms``."""
    exon = views.select("record_id", "transcript_id", "cds", F.inline("exons"))
    cuts = F.expr("""array_sort(array_distinct(filter(flatten(array(array(start, start + length), flatten(transform(cds, c -> array(c.start, c.start + c.length))))),
                     p -> p >= start and p <= start + length)))""")
    return exon.withColumn("cuts", cuts).select(
        "record_id", "transcript_id", "cds",
        F.explode(F.expr("transform(sequence(1, size(cuts) - 1), i -> named_struct('start', cuts[i - 1], 'end', cuts[i]))")).alias("p"),
    ).select("record_id", "transcript_id", "p.start", "p.end", F.expr("exists(cds, c -> c.start <= p.start and p.end <= c.start + c.length)").alias("coding"))


def codon_blocks(views: DataFrame, mark: str = "start_codon") -> DataFrame:
    """Blocks of the codon that begins (in reading direction) at ``mark.position``, along the
    exons, so a split codon gives two; a position outside the exons gives one base."""
    held = views.where(F.col(f"{mark}.position").isNotNull()).select(
        "record_id", "transcript_id", "exons", (F.col("strand") == "reverse").alias("back"), F.col(f"{mark}.position").alias("place"))
    # Place inside the spliced transcript, then the three spliced places back on the locus.
    offsets = held.withColumn(
        "before", F.expr("transform(sequence(0, size(exons) - 1), i -> aggregate(slice(exons, 1, i), 0L, (a, e) -> a + e.length))")
    ).withColumn("total", F.expr("aggregate(exons, 0L, (a, e) -> a + e.length)")).withColumn(
        "spliced", F.expr("filter(transform(exons, (e, i) -> if(place >= e.start and place < e.start + e.length, before[i] + place - e.start, null)), x -> x is not null)[0]"))
    lo = F.expr("if(back, greatest(0L, spliced - 2), spliced)")
    hi = F.expr("if(back, spliced + 1, least(total, spliced + 3))")
    cut = offsets.withColumn("lo", lo).withColumn("hi", hi).withColumn("blocks", F.expr(
        """if(spliced is null, array(named_struct('start', place, 'end', place + 1)),
           filter(transform(exons, (e, i) -> named_struct('start', e.start + greatest(lo - before[i], 0L), 'end', e.start + least(hi - before[i], e.length))), b -> b.start < b.end))"""))
    return cut.select("record_id", "transcript_id", F.inline("blocks"))


def isoform_summary(views: DataFrame, means: DataFrame, quantifier: str | None = None, panel: DataFrame | None = None) -> DataFrame:
    """Exon count, coding bases, and mean and display for the asked or the default quantifier.

    A quantifier that no panel has is an error, which names those there are.
    """
    if quantifier is None:
        chosen = means.join(large(default_quantifier(panel)), ["record_id", "quantifier"])
    else:
        chosen = means.where(F.col("quantifier") == quantifier)
        if chosen.isEmpty():
            known = [r.quantifier for r in means.select("quantifier").distinct().orderBy("quantifier").limit(20).collect()]
            raise ValueError(f"no panel has the quantifier {quantifier!r}; there are: {', '.join(map(str, known)) or 'none'}")
    return views.select("record_id", "transcript_id", F.size("exons").alias("exons"), F.expr("aggregate(cds, 0L, (a, c) -> a + c.length)").alias("cds_bases")).join(
        large(chosen.select("record_id", "transcript_id", "quantifier", "panel_mean", "display")), ["record_id", "transcript_id"])


def ordered_features(features: DataFrame, transcripts: DataFrame, order: DataFrame, quantifier: str) -> DataFrame:
    """Features with their ``place`` for a quantifier: features of no transcript first, then
    mRNA and CDS of each transcript by rank, then the unranked; source order without a panel."""
    owned = transcripts.select("record_id", "transcript_id", F.inline(F.array(
        F.struct(F.col("mrna_feature_id").alias("feature_id"), F.lit(0).alias("second")), F.struct(F.col("cds_feature_id").alias("feature_id"), F.lit(1).alias("second")))))
    ranked = owned.join(large(order.where(F.col("quantifier") == quantifier).select("record_id", "transcript_id", "rank")), ["record_id", "transcript_id"], "left").where("feature_id is not null")
    known = order.where(F.col("quantifier") == quantifier).select("record_id").distinct().withColumn("has_panel", F.lit(True))
    joined = features.join(large(ranked), ["record_id", "feature_id"], "left").join(large(known), "record_id", "left")
    group = F.when(F.col("has_panel").isNull() | F.col("second").isNull(), 0).when(F.col("rank").isNotNull(), 1).otherwise(2)
    key = F.when(group == 1, F.struct(F.col("rank").alias("a"), F.col("second").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("record_id").orderBy(group, key, "feature_ord"))).select(*features.columns, "place")
