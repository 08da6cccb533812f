"""Features of the derived constructs on their digest fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import annotation as A
from strandlake.operators import restriction as R
from strandlake.plans.catalog import query
from strandlake.plans.restriction_queries import DIGEST, digest_ctes
from strandlake.plans.testtables import CTES, constructs, feature_parts, with_ctes

CTES["projected"] = """
strands AS (
  SELECT record_id, fragment_id, topology, n, false AS bottom, top_start AS b, top_length AS w FROM fragments
  UNION ALL SELECT record_id, fragment_id, topology, n, true, bottom_start, bottom_length FROM fragments),
projected AS (
  SELECT s.record_id, s.fragment_id, s.bottom, s.topology, p.feature_id, p.part_index, p.strand,
         greatest(p.start + k * n, b) AS lo, least(p.start + k * n + p.length, b + w) AS hi, p.start + k * n AS s0, b, w
  FROM strands s JOIN feature_parts p USING (record_id), (VALUES (-1), (0), (1)) lifts(k)
  WHERE greatest(p.start + k * n, b) < least(p.start + k * n + p.length, b + w)),
piece_counts AS (
  SELECT record_id, fragment_id, bottom, feature_id, part_index, count(*) AS pieces FROM projected GROUP BY ALL)"""


def _annotated(spark, sf_dir):
    records = constructs(spark, sf_dir)
    sizes = records.select("record_id", F.col("length").alias("n"))
    return A.annotated_digest(feature_parts(spark, sf_dir), R.digest_spans(records, DIGEST), 128, sizes)


@query(
    "annotated_digest",
    with_ctes(*digest_ctes(), "features", "feature_parts", "projected", """
SELECT p.record_id, p.fragment_id, p.bottom, p.feature_id,
       CASE WHEN p.bottom AND p.strand = 'forward' THEN 'reverse' WHEN p.bottom AND p.strand = 'reverse' THEN 'forward' ELSE p.strand END AS fragment_strand,
       CAST(sum(hi - lo) AS BIGINT) AS retained_bases, CAST(max(src.bases) AS BIGINT) AS source_bases, sum(hi - lo) = max(src.bases) AS complete
FROM projected p JOIN (SELECT record_id, feature_id, sum(length) AS bases FROM feature_parts GROUP BY ALL) src USING (record_id, feature_id)
GROUP BY p.record_id, p.fragment_id, p.bottom, p.feature_id, p.strand"""),
)
def annotated_digest(spark, sf_dir):
    return _annotated(spark, sf_dir).select(
        "record_id", F.col("interval_id").alias("fragment_id"), "bottom", "feature_id", "fragment_strand",
        "retained_bases", "source_bases", "complete",
    )


@query(
    "projected_feature_parts",
    with_ctes(*digest_ctes(), "features", "feature_parts", "projected", """
SELECT record_id, fragment_id, bottom, feature_id, CAST(part_index AS BIGINT) AS source_part, lo - s0 AS source_offset,
       CASE WHEN bottom THEN b + w - hi ELSE lo - b END AS fragment_start, hi - lo AS length
FROM projected"""),
)
def projected_feature_parts(spark, sf_dir):
    records = constructs(spark, sf_dir)
    intervals = A.fragment_intervals(R.digest_spans(records, DIGEST))
    return A.project_parts(feature_parts(spark, sf_dir), intervals, 128, records.select("record_id", F.col("length").alias("n"))).select(
        "record_id", F.col("interval_id").alias("fragment_id"), "bottom", "feature_id",
        F.col("source_part").cast("bigint").alias("source_part"), "source_offset", "fragment_start", "length",
    )


@query(
    "split_feature_parts",
    with_ctes(*digest_ctes(), "features", "feature_parts", "projected", """
SELECT record_id, fragment_id, bottom, feature_id, string_agg(part_index, ',' ORDER BY part_index) AS split_source_parts
FROM piece_counts JOIN (SELECT DISTINCT record_id, fragment_id, topology FROM fragments) USING (record_id, fragment_id)
WHERE pieces > 1 AND topology = 'linear' GROUP BY record_id, fragment_id, bottom, feature_id"""),
)
def split_feature_parts(spark, sf_dir):
    return _annotated(spark, sf_dir).where("size(split_source_parts) > 0").select(
        "record_id", F.col("interval_id").alias("fragment_id"), "bottom", "feature_id",
        F.array_join(F.transform("split_source_parts", lambda x: x.cast("string")), ",").alias("split_source_parts"),
    )


@query(
    "core_annotations",
    with_ctes("constructs", "features", "feature_parts", """
cores AS (SELECT record_id, record_id % 400 AS b, 100 AS w, record_id % 3 = 0 AS bottom, length AS n FROM constructs)""", """
SELECT record_id, feature_id, CAST(sum(hi - lo) AS BIGINT) AS retained_bases, max(fs) AS fragment_strand FROM (
  SELECT c.record_id, p.feature_id, greatest(p.start + k * n, b) AS lo, least(p.start + k * n + p.length, b + w) AS hi,
         CASE WHEN bottom AND strand = 'forward' THEN 'reverse' WHEN bottom AND strand = 'reverse' THEN 'forward' ELSE strand END AS fs
  FROM cores c JOIN feature_parts p USING (record_id), (VALUES (-1), (0), (1)) lifts(k)) WHERE lo < hi GROUP BY record_id, feature_id"""),
)
def core_annotations(spark, sf_dir):
    cores = constructs(spark, sf_dir).select(
        "record_id", F.lit("core").alias("core_id"), (F.col("record_id") % 400).alias("start"), F.lit(100).cast("bigint").alias("length"),
        F.col("length").alias("n"), F.when(F.col("record_id") % 3 == 0, F.lit("reverse")).otherwise(F.lit("forward")).alias("orientation"),
    )
    return A.core_annotations(feature_parts(spark, sf_dir), cores).select("record_id", "feature_id", "retained_bases", "fragment_strand")
