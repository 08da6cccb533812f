"""Isoforms of loci derived from the tables: each user of the events is a locus, line items shift its
exons, and events measure expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import isoforms as I
from strandlake.plans.catalog import query
from strandlake.plans.testtables import table, with_ctes

N = 6000


def loci(spark, sf_dir):
    """Every user of the events, with the shift that its line items give to the locus' exons."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id")).distinct()
    shifts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("record_id")).agg((F.sum("l_linenumber") % 37).cast("bigint").alias("shift"))
    return users.join(shifts, "record_id", "left").withColumn("shift", F.coalesce("shift", F.lit(0)).cast("bigint"))


_USERS = """
loci AS (SELECT u.record_id, coalesce(m.shift, 0) AS shift FROM (SELECT DISTINCT user_id AS record_id FROM events) u
         LEFT JOIN (SELECT l_suppkey, CAST(sum(l_linenumber) % 37 AS BIGINT) AS shift FROM lineitem GROUP BY 1) m ON m.l_suppkey = u.record_id)"""


def transcripts(spark, sf_dir):
    """Five transcripts per locus."""
    return loci(spark, sf_dir).select("record_id", "shift", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).selectExpr(
        "record_id", "shift", "k", "concat('t', k) as transcript_id", "case (record_id + k) % 5 when 0 then 'discoverable' when 1 then 'invisible' else 'quantified' end as state",
        "k = record_id % 5 as is_mane_select", "concat('feature-', 2 * k + 1) as mrna_feature_id", "concat('feature-', 2 * k + 2) as cds_feature_id",
        "if(record_id % 2 = 0, 'forward', 'reverse') as strand", "named_struct('position', 100L + shift + 10 * k + 148 + 400 * (record_id % 3), 'split', true) as start_codon")


def locus_parts(spark, sf_dir):
    """Five exons of 150 bases and coding parts trimmed at both ends for each transcript."""
    exons = transcripts(spark, sf_dir).select("record_id", "shift", "k", "mrna_feature_id", "cds_feature_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("e"))
    both = """array(named_struct('feature_id', mrna_feature_id, 'start', cast(100 + shift + 10 * k + 400 * e as bigint), 'length', 150L),
                    named_struct('feature_id', cds_feature_id, 'start', cast(100 + shift + 10 * k + 400 * e + if(e = 1, 40, 0) as bigint), 'length', if(e in (1, 3), 110L, 150L)))"""
    return exons.select("record_id", "e", F.expr(f"inline({both})")).where("not (feature_id = 'feature-2' and e = 0)").select(
        "record_id", "feature_id", F.col("e").alias("part_index"), F.lit("forward").alias("strand"), "start", "length")


def expression(spark, sf_dir):
    """Events as measurements: user gives the locus, event type the transcript."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id as record_id", "concat('t', length(event_type) % 5) as transcript_id", "if(event_id % 2 = 0, 'bambu_lr', 'NanoCount_lr') as quantifier",
        "concat('line', event_id % 6) as cell_line", "value")
    return rows.groupBy("record_id", "transcript_id", "quantifier", "cell_line").agg(F.avg("value").alias("mean"))


def panel(spark, sf_dir):
    return loci(spark, sf_dir).selectExpr("record_id", "inline(array(named_struct('quantifier', 'bambu_lr', 'reports_zeros', true), named_struct('quantifier', 'NanoCount_lr', 'reports_zeros', false)))").select(
        "*", F.explode(F.array(*[F.lit(f"line{i}") for i in range(4)])).alias("cell_line"))


_LOCI = _USERS + """,
transcripts AS (SELECT record_id, k, 't' || k AS transcript_id, CASE (record_id + k) % 5 WHEN 0 THEN 'discoverable' WHEN 1 THEN 'invisible' ELSE 'quantified' END AS state,
                k = record_id % 5 AS is_mane_select FROM loci, range(0, 5) r(k)),
expression AS (SELECT user_id AS record_id, 't' || (length(event_type) % 5) AS transcript_id, CASE WHEN event_id % 2 = 0 THEN 'bambu_lr' ELSE 'NanoCount_lr' END AS quantifier,
               'line' || (event_id % 6) AS cell_line, avg(value) AS mean FROM events GROUP BY ALL),
panel AS (SELECT record_id, q AS quantifier, z AS reports_zeros, 'line' || c AS cell_line FROM loci, (VALUES ('bambu_lr', true), ('NanoCount_lr', false)) v(q, z), range(0, 4) r(c)),
cells AS (SELECT t.record_id, t.transcript_id, t.state, t.is_mane_select, p.quantifier, avg(CASE WHEN p.reports_zeros THEN e.mean ELSE coalesce(e.mean, 0) END) AS m
          FROM transcripts t JOIN panel p USING (record_id) LEFT JOIN expression e ON e.record_id = t.record_id AND e.transcript_id = t.transcript_id AND e.quantifier = p.quantifier AND e.cell_line = p.cell_line GROUP BY ALL),
means AS (SELECT c.* EXCLUDE m, CASE WHEN state = 'quantified' AND EXISTS (SELECT 1 FROM expression e WHERE e.record_id = c.record_id AND e.transcript_id = c.transcript_id AND e.quantifier = c.quantifier) THEN m END AS panel_mean FROM cells c),
shown AS (SELECT *, CASE WHEN state = 'quantified' THEN CASE WHEN panel_mean > 0 THEN 'expressed' WHEN panel_mean IS NOT NULL THEN 'not_detected' ELSE 'no_data' END WHEN state = 'discoverable' THEN 'discoverable' ELSE 'invisible' END AS display,
          row_number() OVER (PARTITION BY record_id, quantifier ORDER BY round(panel_mean, 9) DESC NULLS LAST, CASE state WHEN 'quantified' THEN 0 WHEN 'discoverable' THEN 1 ELSE 2 END, is_mane_select DESC, transcript_id) AS rank FROM means)"""


def means(spark, sf_dir):
    found = I.panel_means(transcripts(spark, sf_dir), expression(spark, sf_dir), panel(spark, sf_dir))
    return found.withColumn("panel_mean", F.round("panel_mean", 9))


@query("isoform_expression", with_ctes(_LOCI, "SELECT record_id, transcript_id, quantifier, round(panel_mean, 6) AS panel_mean, display FROM shown"))
def isoform_expression(spark, sf_dir):
    return means(spark, sf_dir).select("record_id", "transcript_id", "quantifier", F.round("panel_mean", 6).alias("panel_mean"), "display")


@query("isoform_ranking", with_ctes(_LOCI, "SELECT record_id, quantifier, transcript_id, CAST(rank AS INTEGER) AS rank FROM shown"))
def isoform_ranking(spark, sf_dir):
    return I.isoform_order(means(spark, sf_dir)).select("record_id", "quantifier", "transcript_id", "rank")


def views(spark, sf_dir):
    return I.isoforms(transcripts(spark, sf_dir), locus_parts(spark, sf_dir))


_EXONS = _USERS + """,
transcripts AS (SELECT record_id, shift, k FROM loci, range(0, 5) r(k)),
exons AS (SELECT record_id, shift, k, 100 + shift + 10 * k + 400 * e AS s, 100 + shift + 10 * k + 400 * e + 150 AS t, e FROM transcripts, range(0, 5) r(e)),
cds AS (SELECT record_id, k, s + CASE WHEN e = 1 THEN 40 ELSE 0 END AS s, s + CASE WHEN e = 1 THEN 40 ELSE 0 END + CASE WHEN e IN (1, 3) THEN 110 ELSE 150 END AS t FROM exons WHERE NOT (k = 0 AND e = 0))"""


@query(
    "isoform_summary",
    with_ctes(_LOCI, """
SELECT record_id, transcript_id, quantifier, CAST(5 AS INTEGER) AS exons, CAST(670 - CASE WHEN k = 0 THEN 150 ELSE 0 END AS BIGINT) AS cds_bases, display FROM shown JOIN (SELECT record_id, transcript_id, k FROM transcripts) USING (record_id, transcript_id) WHERE quantifier = 'bambu_lr'"""),
)
def isoform_summary(spark, sf_dir):
    return I.isoform_summary(views(spark, sf_dir), means(spark, sf_dir), panel=panel(spark, sf_dir)).select("record_id", "transcript_id", "quantifier", "exons", "cds_bases", "display")


@query(
    "uncovered_regions",
    with_ctes(_EXONS, f"""
SELECT record_id, CASE WHEN s = 0 THEN 0 ELSE s + shift END AS start, CASE WHEN e = {N} THEN e ELSE e + shift END AS "end"
FROM loci, (SELECT 0 AS s, 100 AS e UNION ALL SELECT 290 + 400 * j, 500 + 400 * j FROM range(0, 4) r(j) UNION ALL SELECT 1890, {N})"""),
)
def uncovered_regions(spark, sf_dir):
    exons = views(spark, sf_dir).select("record_id", F.inline("exons"))
    lengths = loci(spark, sf_dir).select("record_id", F.lit(N).cast("bigint").alias("length"))
    return I.uncovered_regions(exons, lengths)


@query(
    "exon_pieces",
    with_ctes(_EXONS, """
cuts AS (SELECT record_id, k, e, s AS p FROM exons UNION SELECT record_id, k, e, t FROM exons UNION SELECT x.record_id, x.k, x.e, c.s FROM exons x JOIN cds c ON c.record_id = x.record_id AND c.k = x.k AND c.s > x.s AND c.s < x.t
         UNION SELECT x.record_id, x.k, x.e, c.t FROM exons x JOIN cds c ON c.record_id = x.record_id AND c.k = x.k AND c.t > x.s AND c.t < x.t),
pieces AS (SELECT record_id, k, p AS start, lead(p) OVER (PARTITION BY record_id, k, e ORDER BY p) AS "end" FROM cuts)""", """
SELECT record_id, 't' || k AS transcript_id, start, "end", EXISTS (SELECT 1 FROM cds c WHERE c.record_id = p.record_id AND c.k = p.k AND c.s <= p.start AND p."end" <= c.t) AS coding FROM pieces p WHERE "end" IS NOT NULL"""),
)
def exon_pieces(spark, sf_dir):
    return I.exon_pieces(views(spark, sf_dir))


@query(
    "codon_blocks",
    with_ctes(_EXONS, """
bases AS (SELECT record_id, k, s + j AS p, row_number() OVER (PARTITION BY record_id, k ORDER BY s + j) AS r FROM exons, range(0, 150) q(j)),
marks AS (SELECT b.record_id, b.k, b.r FROM bases b JOIN loci l USING (record_id) WHERE b.p = 100 + l.shift + 10 * b.k + 148 + 400 * (b.record_id % 3)),
taken AS (SELECT b.record_id, b.k, b.p FROM bases b JOIN marks m USING (record_id, k) WHERE b.r BETWEEN CASE WHEN m.record_id % 2 = 0 THEN m.r ELSE m.r - 2 END AND CASE WHEN m.record_id % 2 = 0 THEN m.r + 2 ELSE m.r END),
islands AS (SELECT *, p - row_number() OVER (PARTITION BY record_id, k ORDER BY p) AS g FROM taken)""", """
SELECT record_id, 't' || k AS transcript_id, min(p) AS start, max(p) + 1 AS "end" FROM islands GROUP BY record_id, k, g"""),
)
def codon_blocks(spark, sf_dir):
    return I.codon_blocks(views(spark, sf_dir))
