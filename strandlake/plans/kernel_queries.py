"""Expressions and kernels over pairs of sequences that the tables spell, beside SQL that follows their definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.dna import circular_slice, fold_name, kmer_share
from strandlake.functions.kernels import dimer_screen, hairpin_stem, semiglobal_edits
from strandlake.functions.dna import sequence_sha256
from strandlake.operators import isoforms as I
from strandlake.plans.catalog import query
from strandlake.plans.isoform_queries import transcripts
from strandlake.plans.testtables import constructs, table, with_ctes


@query(
    "circular_slices",
    with_ctes("constructs", """
SELECT record_id, CASE WHEN s < 512 AND w BETWEEN 1 AND 512 AND (s + w <= 512 OR topology = 'circular') THEN substr(sequence || sequence, CAST(s + 1 AS BIGINT), w) END AS bases
FROM (SELECT *, (record_id * 13) % 600 AS s, (record_id * 7) % 530 AS w FROM constructs)"""),
)
def circular_slices(spark, sf_dir):
    rows = constructs(spark, sf_dir).withColumn("s", (F.col("record_id") * 13 % 600).cast("int")).withColumn("w", (F.col("record_id") * 7 % 530).cast("int"))
    return rows.select("record_id", circular_slice("sequence", "s", "w", "topology").alias("bases"))


@query(
    "kmer_shares",
    with_ctes("constructs", """
pairs AS (SELECT record_id, substr(sequence, 1, 40) AS short, substr(sequence, CAST(1 + record_id % 40 AS BIGINT), 200) AS long FROM constructs),
windows AS (SELECT record_id, substr(short, CAST(i AS BIGINT), 6) AS w, contains(long, substr(short, CAST(i AS BIGINT), 6)) OR contains(reverse(translate(long, 'ACGT', 'TGCA')), substr(short, CAST(i AS BIGINT), 6)) AS hit
            FROM pairs, range(1, 36) r(i))""", """
SELECT record_id, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS share FROM windows GROUP BY record_id"""),
)
def kmer_shares(spark, sf_dir):
    rows = constructs(spark, sf_dir).withColumn("short", F.substring("sequence", 1, 40)).withColumn(
        "long", F.substring("sequence", (1 + F.col("record_id") % 40).cast("int"), F.lit(200)))
    return rows.select("record_id", kmer_share("short", "long", 6).alias("share"))


@query("folded_names", "SELECT p_partkey AS record_id, lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS folded FROM part")
def folded_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), fold_name("p_name").alias("folded"))


@query("sequence_hashes", with_ctes("constructs", "SELECT record_id, sha256(sequence) AS hash FROM constructs"))
def sequence_hashes(spark, sf_dir):
    return constructs(spark, sf_dir).select("record_id", sequence_sha256("sequence").alias("hash"))


# Diagonals of one oligo against the turned other one, run by run.
_DIAGONALS = """
oligos AS (SELECT record_id, substr(sequence, 1, CAST(18 + record_id % 5 AS BIGINT)) AS a, substr(sequence, 101, CAST(18 + record_id % 4 AS BIGINT)) AS b FROM constructs),
turned AS (SELECT record_id, a, length(a) AS n, reverse(translate(b, 'ACGT', 'TGCA')) AS t, length(b) AS m FROM oligos),
cells AS (SELECT record_id, n, m, i, j, substr(a, CAST(i AS BIGINT), 1) = substr(t, CAST(j AS BIGINT), 1) AS fits FROM turned, range(1, 23) x(i), range(1, 22) y(j) WHERE i <= n AND j <= m),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, i - j, fits ORDER BY i) AS island FROM cells),
runs AS (SELECT record_id, n, count(*) AS run, max(i) AS last_i, min(j) AS first_j FROM numbered WHERE fits GROUP BY record_id, n, i - j, island)"""


@query(
    "dimer_runs",
    with_ctes("constructs", _DIAGONALS, """
SELECT o.record_id, CAST(coalesce(max(run), 0) AS INTEGER) AS longest_run, CAST(coalesce(max(run) FILTER (last_i = r.n OR first_j = 1), 0) AS INTEGER) AS longest_three_prime_run
FROM oligos o LEFT JOIN runs r USING (record_id) GROUP BY o.record_id"""),
)
def dimer_runs(spark, sf_dir):
    rows = constructs(spark, sf_dir).select(
        "record_id", F.substring("sequence", F.lit(1), (18 + F.col("record_id") % 5).cast("int")).alias("a"), F.substring("sequence", F.lit(101), (18 + F.col("record_id") % 4).cast("int")).alias("b"))
    return rows.withColumn("d", dimer_screen("a", "b")).select("record_id", "d.longest_run", "d.longest_three_prime_run")


@query(
    "hairpin_stems",
    with_ctes("constructs", """
oligos AS (SELECT record_id, substr(sequence, 51, CAST(20 + record_id % 8 AS BIGINT)) AS s FROM constructs),
pairs AS (SELECT record_id, i, j, substr(s, CAST(i AS BIGINT), 1) = translate(substr(s, CAST(j AS BIGINT), 1), 'ACGT', 'TGCA') AS fits
          FROM oligos, range(1, 28) x(i), range(1, 28) y(j) WHERE j - i >= 4 AND j <= length(s)),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY record_id, i + j, fits ORDER BY i) AS island FROM pairs),
stems AS (SELECT record_id, count(*) AS stem FROM numbered WHERE fits GROUP BY record_id, i + j, island)""", """
SELECT o.record_id, CAST(coalesce(max(stem), 0) AS INTEGER) AS stem FROM oligos o LEFT JOIN stems USING (record_id) GROUP BY o.record_id"""),
)
def hairpin_stems(spark, sf_dir):
    rows = constructs(spark, sf_dir).select("record_id", F.substring("sequence", F.lit(51), (20 + F.col("record_id") % 8).cast("int")).alias("s"))
    return rows.select("record_id", hairpin_stem("s").alias("stem"))


@query(
    "semiglobal_distances",
    with_ctes("constructs", """
pairs AS (SELECT record_id, substr(sequence, 61, 6) || substr(sequence, CAST(68 + record_id % 2 AS BIGINT), 6) AS short, substr(sequence, 51, 40) AS long FROM constructs),
stretches AS (SELECT record_id, short, substr(long, CAST(i AS BIGINT), k) AS piece FROM pairs, range(1, 41) r(i), range(8, 17) q(k) WHERE i + k <= 41)""", """
SELECT record_id, CASE WHEN min(levenshtein(short, piece)) <= 4 THEN CAST(min(levenshtein(short, piece)) AS BIGINT) END AS edits FROM stretches GROUP BY record_id"""),
)
def semiglobal_distances(spark, sf_dir):
    at = F.substring("sequence", (68 + F.col("record_id") % 2).cast("int"), F.lit(6))
    rows = constructs(spark, sf_dir).select("record_id", F.concat(F.substring("sequence", 61, 6), at).alias("short"), F.substring("sequence", 51, 40).alias("long"))
    return rows.select("record_id", semiglobal_edits("short", "long", F.lit(4)).alias("edits"))


@query("isoforms_without_features", "SELECT record_id, 't' || k AS transcript_id FROM (SELECT DISTINCT user_id AS record_id FROM events), range(0, 5) r(k) WHERE (record_id + k) % 3 = 0")
def isoforms_without_features(spark, sf_dir):
    known = transcripts(spark, sf_dir)
    there = known.where("(record_id + k) % 3 != 0").select("record_id", F.col("mrna_feature_id").alias("feature_id"))
    return I.missing_features(known, there)
