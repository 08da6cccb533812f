"""Restriction scans and digests of the derived constructs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.dims.enzymes import builtin, enzymes_table, select_enzymes
from strandlake.functions.dna import iupac_regex, revcomp_text
from strandlake.operators import restriction as R
from strandlake.plans.catalog import query
from strandlake.plans.testtables import CTES, LENGTH, constructs, with_ctes

SCAN = ["EcoRI", "BamHI", "BsaI", "HinfI", "NlaIII"]
DIGEST = ["EcoRI", "BamHI", "BsaI"]


def sites_ctes(names, prefix=""):
    """SQL of the site scan: every position of every record against every pattern."""
    branches = []
    for e in select_enzymes(names):
        site, m = e.recognition_sequence, len(e.recognition_sequence)
        other = revcomp_text(site)
        todo = [("forward", site, e.top_cut_offset, e.bottom_cut_offset)]
        if other != site:
            todo.append(("reverse", other, m - e.bottom_cut_offset, m - e.top_cut_offset))
        branches += [
            f"SELECT record_id, n, topology, i, '{e.name}' AS enzyme, '{strand}' AS strand, {m} AS m, {top} AS top, {bottom} AS bottom, "
            f"'{e.polarity}' AS polarity, {abs(e.bottom_cut_offset - e.top_cut_offset)} AS overhang "
            f"FROM {prefix}windows WHERE regexp_matches(w, '^{iupac_regex(motif)}')"
            for strand, motif, top, bottom in todo
        ]
    return f"""
{prefix}windows AS MATERIALIZED (
  SELECT record_id, length AS n, topology, i,
         substr(CASE WHEN topology = 'circular' THEN sequence || sequence ELSE sequence END, CAST(i + 1 AS BIGINT), 16) AS w
  FROM constructs, range(0, {LENGTH}) r(i)),
{prefix}found AS ({" UNION ALL ".join(branches)}),
{prefix}sites AS (
  SELECT record_id, enzyme, strand, CAST(i AS BIGINT) AS site_start, CAST(m AS BIGINT) AS site_length, polarity AS overhang_polarity,
         CAST(overhang AS BIGINT) AS overhang_length, n, topology,
         CASE WHEN topology = 'circular' THEN ((i + top) % n + n) % n WHEN i + top BETWEEN 0 AND n THEN i + top END AS top_cut,
         CASE WHEN topology = 'circular' THEN ((i + bottom) % n + n) % n WHEN i + bottom BETWEEN 0 AND n THEN i + bottom END AS bottom_cut
  FROM {prefix}found)"""


CTES["sites"] = sites_ctes(SCAN)
CTES["all_sites"] = sites_ctes([e.name for e in builtin()], "all_")


@query(
    "restriction_sites",
    with_ctes("constructs", "sites", """
SELECT record_id, enzyme, strand, site_start, site_length, top_cut, bottom_cut,
       top_cut IS NOT NULL AND bottom_cut IS NOT NULL AS cleavage_available,
       overhang_polarity, overhang_length
FROM sites"""),
)
def restriction_sites(spark, sf_dir):
    return R.find_sites(constructs(spark, sf_dir), SCAN).drop("length", "topology")


@query(
    "restriction_enzyme_counts",
    with_ctes("constructs", "all_sites", """
SELECT r.record_id, e.enzyme, CAST(count(s.site_start) AS BIGINT) AS sites,
       CAST(count(CASE WHEN s.top_cut IS NOT NULL AND s.bottom_cut IS NOT NULL THEN 1 END) AS BIGINT) AS available_cuts
FROM constructs r CROSS JOIN (VALUES """ + ", ".join(f"('{e.name}')" for e in builtin()) + """) e(enzyme)
LEFT JOIN all_sites s ON s.record_id = r.record_id AND s.enzyme = e.enzyme
GROUP BY r.record_id, e.enzyme"""),
)
def restriction_enzyme_counts(spark, sf_dir):
    return R.enzyme_counts(constructs(spark, sf_dir))


_SET_SQL = """
SELECT record_id, enzyme, CAST(count(*) AS BIGINT) AS sites FROM all_sites GROUP BY record_id, enzyme"""


def _set_sql(condition):
    specificity = ", ".join(f"('{e.name}', {len(e.recognition_sequence.replace('N', ''))})" for e in builtin())
    return with_ctes("constructs", "all_sites", f"counted AS ({_SET_SQL})",
                     f"spec(enzyme, specificity) AS (VALUES {specificity})",
                     f"SELECT record_id, enzyme, sites FROM counted JOIN spec USING (enzyme) WHERE {condition}")


@query("enzyme_set_unique6", _set_sql("sites = 1 AND specificity >= 6"))
def enzyme_set_unique6(spark, sf_dir):
    return _in_set(spark, sf_dir, "unique6")


@query("enzyme_set_unique_dual6", _set_sql("sites IN (1, 2) AND specificity >= 6"))
def enzyme_set_unique_dual6(spark, sf_dir):
    return _in_set(spark, sf_dir, "unique_dual6")


@query(
    "enzyme_set_common",
    _set_sql("enzyme IN (" + ", ".join(f"'{n}'" for n in R.COMMON.split()) + ")"),
)
def enzyme_set_common(spark, sf_dir):
    return _in_set(spark, sf_dir, "common")


def _in_set(spark, sf_dir, which):
    counts = R.enzyme_counts(constructs(spark, sf_dir))
    return R.enzymes_in_set(counts, enzymes_table(spark), which).select("record_id", "enzyme", "sites")


@query(
    "enzyme_usage_by_polarity",
    with_ctes("constructs", "all_sites", """
SELECT overhang_polarity, overhang_length, CAST(count(DISTINCT enzyme) AS BIGINT) AS enzymes, CAST(count(*) AS BIGINT) AS sites
FROM all_sites GROUP BY overhang_polarity, overhang_length"""),
)
def enzyme_usage_by_polarity(spark, sf_dir):
    per_enzyme = R.find_sites(constructs(spark, sf_dir), [e.name for e in builtin()]).groupBy("enzyme").count()
    return (
        per_enzyme.join(F.broadcast(enzymes_table(spark).withColumnRenamed("name", "enzyme")), "enzyme")
        .groupBy("overhang_polarity", F.col("overhang_length").cast("bigint").alias("overhang_length"))
        .agg(F.count("enzyme").alias("enzymes"), F.sum("count").alias("sites"))
    )


_STAGGER = "CASE overhang_polarity WHEN 'five_prime' THEN overhang_length WHEN 'three_prime' THEN -overhang_length ELSE 0 END"
CTES["cuts"] = f"""
cuts AS (
  SELECT record_id, n, topology, top_cut AS top, top_cut + {_STAGGER} AS bottom,
         string_agg(DISTINCT enzyme, ',' ORDER BY enzyme) AS enzymes
  FROM sites WHERE top_cut IS NOT NULL AND bottom_cut IS NOT NULL GROUP BY ALL)"""
CTES["digest_sites"] = sites_ctes(DIGEST)
# The refusals are the table; the digest is cut by hand from consecutive boundaries.
CTES["fragments"] = """
bad_records AS (
  SELECT record_id, min(CASE WHEN top_cut IS NULL OR bottom_cut IS NULL THEN 'cut outside the molecule' ELSE 'cut at a terminus' END) AS reason,
         max(CASE WHEN top_cut IS NULL OR bottom_cut IS NULL THEN 'cut outside the molecule' ELSE 'cut at a terminus' END) AS worst
  FROM sites WHERE top_cut IS NULL OR bottom_cut IS NULL
     OR (topology = 'linear' AND (top_cut IN (0, n) OR bottom_cut IN (0, n))) GROUP BY record_id),
bounds AS (
  SELECT record_id, n, topology, top, bottom, enzymes FROM cuts
  UNION ALL SELECT record_id, length, topology, 0, 0, '' FROM constructs WHERE topology = 'linear'
  UNION ALL SELECT record_id, length, topology, length, length, '' FROM constructs WHERE topology = 'linear'
  UNION ALL (SELECT record_id, n, topology, top + n, bottom + n, enzymes FROM
     (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY top, bottom) rn FROM cuts WHERE topology = 'circular') WHERE rn = 1)),
linked AS (
  SELECT record_id, n, topology AS source_topology, 'linear' AS topology, top AS lt, bottom AS lb, enzymes AS le,
         lead(top) OVER w AS rt, lead(bottom) OVER w AS rb, lead(enzymes) OVER w AS re,
         row_number() OVER w AS ord
  FROM bounds WINDOW w AS (PARTITION BY record_id ORDER BY top, bottom)),
pieces AS (
  SELECT *, least(rt, rb) - greatest(lt, lb) AS paired FROM linked WHERE rt IS NOT NULL
  UNION ALL
  SELECT record_id, length, topology, 'circular', 0, 0, '', length, length, '', 1, length FROM constructs
  WHERE topology = 'circular' AND record_id NOT IN (SELECT record_id FROM cuts)),
refused AS (
  SELECT record_id, worst AS reason FROM bad_records
  UNION ALL
  SELECT DISTINCT record_id, 'overlapping or touching cuts' FROM pieces
  WHERE paired <= 0 AND record_id NOT IN (SELECT record_id FROM bad_records)),
fragments AS (
  SELECT p.record_id, p.n, p.source_topology, p.topology, p.ord AS fragment_ord, format('fragment-{:04d}', p.ord) AS fragment_id,
         lt, lb, le, rt, rb, re, paired AS paired_length, lt % p.n AS top_start, rt - lt AS top_length,
         ((lb % p.n) + p.n) % p.n AS bottom_start, rb - lb AS bottom_length,
         repeat(r.sequence, 4) AS s4
  FROM pieces p JOIN constructs r USING (record_id) WHERE p.record_id NOT IN (SELECT record_id FROM refused)),
full_fragments AS (
  SELECT *, substr(s4, CAST(n + lt + 1 AS BIGINT), CAST(rt - lt AS BIGINT)) AS top_sequence,
         reverse(translate(substr(s4, CAST(n + lb + 1 AS BIGINT), CAST(rb - lb AS BIGINT)), 'ACGT', 'TGCA')) AS bottom_sequence,
         CASE WHEN topology = 'circular' THEN NULL WHEN lb > lt THEN substr(s4, CAST(n + lt + 1 AS BIGINT), CAST(lb - lt AS BIGINT))
              ELSE reverse(translate(substr(s4, CAST(n + lb + 1 AS BIGINT), CAST(lt - lb AS BIGINT)), 'ACGT', 'TGCA')) END AS left_overhang,
         CASE WHEN topology = 'circular' THEN NULL WHEN rb > rt THEN reverse(translate(substr(s4, CAST(n + rt + 1 AS BIGINT), CAST(rb - rt AS BIGINT)), 'ACGT', 'TGCA'))
              ELSE substr(s4, CAST(n + rb + 1 AS BIGINT), CAST(rt - rb AS BIGINT)) END AS right_overhang,
         CASE WHEN topology = 'circular' THEN NULL WHEN lb = lt THEN 'blunt' WHEN lb > lt THEN 'five_prime' ELSE 'three_prime' END AS left_polarity,
         CASE WHEN topology = 'circular' THEN NULL WHEN rb = rt THEN 'blunt' WHEN rb > rt THEN 'five_prime' ELSE 'three_prime' END AS right_polarity
  FROM fragments)"""


def digest_ctes(names=DIGEST):
    return ["constructs", sites_ctes(names), "cuts", "fragments"]


def flat_fragments(fragments):
    """Digest fragments with plain columns instead of structs."""
    return fragments.select(
        "record_id", "fragment_id", "topology",
        F.col("top.start").alias("top_start"), F.col("top.length").alias("top_length"), F.col("top.sequence").alias("top_sequence"),
        F.col("bottom.start").alias("bottom_start"), F.col("bottom.length").alias("bottom_length"), F.col("bottom.sequence").alias("bottom_sequence"),
        "paired_length",
        F.col("left_end.polarity").alias("left_polarity"), F.col("left_end.overhang").alias("left_overhang"),
        F.array_join("left_end.enzymes", ",").alias("left_enzymes"),
        F.col("right_end.polarity").alias("right_polarity"), F.col("right_end.overhang").alias("right_overhang"),
        F.array_join("right_end.enzymes", ",").alias("right_enzymes"),
    )


@query(
    "digest_fragments",
    with_ctes(*digest_ctes(), """
SELECT record_id, fragment_id, topology, top_start, top_length, top_sequence, bottom_start, bottom_length, bottom_sequence,
       paired_length, left_polarity, left_overhang, CASE WHEN topology = 'linear' THEN le END AS left_enzymes,
       right_polarity, right_overhang, CASE WHEN topology = 'linear' THEN re END AS right_enzymes
FROM full_fragments"""),
)
def digest_fragments(spark, sf_dir):
    return flat_fragments(R.digest(constructs(spark, sf_dir), DIGEST))


@query("digest_refused", with_ctes(*digest_ctes(["EcoRI", "BsaI", "HinfI", "NlaIII"]), "SELECT record_id, reason FROM refused"))
def digest_refused(spark, sf_dir):
    return R.digest_rejects(constructs(spark, sf_dir), ["EcoRI", "BsaI", "HinfI", "NlaIII"])


@query("digest_merged_cuts", with_ctes("constructs", sites_ctes(["BsmBI", "Esp3I", "HinfI"]), "cuts", "SELECT record_id, top, bottom, enzymes FROM cuts"))
def digest_merged_cuts(spark, sf_dir):
    sites = R.find_sites(constructs(spark, sf_dir), ["BsmBI", "Esp3I", "HinfI"])
    return R.merge_cuts(sites).select("record_id", "top", "bottom", F.array_join("enzymes", ",").alias("enzymes"))


@query(
    "digest_conservation",
    with_ctes(*digest_ctes(), """
SELECT record_id, n AS length, CAST(count(*) AS BIGINT) AS fragments, CAST(sum(top_length) AS BIGINT) AS top_bases,
       CAST(sum(bottom_length) AS BIGINT) AS bottom_bases, true AS conserved
FROM fragments GROUP BY record_id, n"""),
)
def digest_conservation(spark, sf_dir):
    return R.digest_conservation(R.digest_spans(constructs(spark, sf_dir), DIGEST))


_END = """CASE WHEN topology = 'circular' OR {e} = '' THEN 'end' ELSE replace({e}, ',', '/') || ' (' ||
  CASE {p} WHEN 'blunt' THEN 'blunt' WHEN 'five_prime' THEN '5'' ' || {o} ELSE '3'' ' || {o} END || ')' END"""


@query(
    "digest_summary",
    with_ctes(*digest_ctes(), f"""
SELECT record_id, fragment_id, top_start AS start, top_length AS length,
       {_END.format(e='le', p='left_polarity', o='left_overhang')} AS left_end,
       {_END.format(e='re', p='right_polarity', o='right_overhang')} AS right_end
FROM full_fragments"""),
)
def digest_summary(spark, sf_dir):
    return R.digest_summary(R.digest(constructs(spark, sf_dir), DIGEST))


@query(
    "digest_by_length",
    with_ctes(*digest_ctes(), "SELECT record_id, fragment_id, top_start AS start, top_length AS length FROM fragments"),
)
def digest_by_length(spark, sf_dir):
    return R.digest_by_length(R.digest_spans(constructs(spark, sf_dir), DIGEST))


@query(
    "cut_labels",
    with_ctes("constructs", "sites", """
SELECT record_id, top_cut, string_agg(DISTINCT enzyme, ', ' ORDER BY enzyme) AS enzymes
FROM sites WHERE top_cut IS NOT NULL GROUP BY record_id, top_cut"""),
)
def cut_labels(spark, sf_dir):
    return R.cut_labels(R.find_sites(constructs(spark, sf_dir), SCAN))
