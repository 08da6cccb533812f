"""Translations and open reading frames of the derived constructs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.dims.genetic_code import STANDARD, code_dimension, genetic_codes
from strandlake.operators import translation as T
from strandlake.operators.sequences import contiguous_spans, feature_sequences
from strandlake.plans.catalog import query
from strandlake.plans.testtables import CTES, constructs, feature_parts, features, with_ctes


def _index(codon):
    b = [f"(strpos('TCAG', substr({codon}, {i}, 1)) - 1)" for i in (1, 2, 3)]
    return f"16 * {b[0]} + 4 * {b[1]} + {b[2]}"


def _amino(codon, table="1"):
    """SQL: residue of an exact codon by its place in the code's 64 letters."""
    cases = " ".join(
        f"WHEN {t} THEN '{''.join(genetic_codes()[t].amino_acids.values())}'" for t in (1, 2, 4, 11)
    )
    letters = f"'{STANDARD}'" if table == "1" else f"CASE {table} {cases} END"
    return f"substr({letters}, CAST({_index(codon)} + 1 AS BIGINT), 1)"


CTES["feature_bases"] = """
feature_bases AS (
  SELECT p.record_id, p.feature_id, p.strand, string_agg(substr(r.sequence || r.sequence, CAST(p.start + 1 AS BIGINT), p.length), '' ORDER BY part_index) AS spliced
  FROM feature_parts p JOIN constructs r USING (record_id) GROUP BY p.record_id, p.feature_id, p.strand),
coding AS (SELECT record_id, feature_id, strand, CASE WHEN strand = 'reverse' THEN reverse(translate(spliced, 'ACGT', 'TGCA')) ELSE spliced END AS s FROM feature_bases)"""


@query(
    "feature_sequences",
    with_ctes("constructs", "features", "feature_parts", "feature_bases",
              "SELECT record_id, feature_id, s AS sequence, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS canonical FROM coding"),
)
def feature_sequences_query(spark, sf_dir):
    from strandlake.functions.dna import canonical_dna

    return feature_sequences(feature_parts(spark, sf_dir), constructs(spark, sf_dir)).select(
        "record_id", "feature_id", "sequence", canonical_dna("sequence").alias("canonical")
    )


@query(
    "contiguous_feature_spans",
    with_ctes("features", "feature_parts", """
SELECT a.record_id, a.feature_id, a.start, a.length FROM feature_parts a
LEFT JOIN (SELECT record_id, feature_id FROM feature_parts WHERE part_index = 1) b ON b.record_id = a.record_id AND b.feature_id = a.feature_id
WHERE a.part_index = 0 AND b.feature_id IS NULL"""),
)
def contiguous_feature_spans(spark, sf_dir):
    return contiguous_spans(feature_parts(spark, sf_dir), constructs(spark, sf_dir)).select("record_id", "feature_id", "start", "length")


def qualified_features(spark, sf_dir):
    """Features with codon_start and transl_table qualifiers spread over their order numbers."""
    return features(spark, sf_dir).withColumn(
        "qualifiers",
        F.array(
            F.struct(F.lit("codon_start").alias("key"), F.expr("cast(1 + feature_ord % 4 as string)").alias("value")),
            F.struct(F.lit("transl_table").alias("key"), F.expr("element_at(array('1', '2', '4', '11'), cast(1 + s0 % 4 as int))").alias("value")),
        ),
    )


CTES["translated"] = f"""
wanted AS (
  SELECT f.record_id, f.feature_id, f.kind, c.s, c.strand, CAST(1 + feature_ord % 4 AS INTEGER) AS codon_start,
         CASE s0 % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 11 END AS table_id
  FROM features f JOIN coding c USING (record_id, feature_id) WHERE f.kind = 'CDS'),
residues AS (
  SELECT record_id, feature_id, table_id, codon_start, strand, length(s) AS size, i, (length(s) - codon_start + 1) // 3 AS k,
         substr(s, codon_start + 3 * i, 3) AS codon
  FROM wanted, range(0, 40) r(i) WHERE strand <> 'unknown' AND codon_start < 4 AND codon_start + 3 * i + 2 <= length(s)),
amino AS (SELECT *, {_amino('codon', 'table_id')} AS aa FROM residues),
translated AS (
  SELECT record_id, feature_id, table_id, codon_start, max(size) AS size, max(k) AS k, string_agg(aa, '' ORDER BY i) AS raw,
         arg_min(codon, i) AS first_codon FROM amino GROUP BY ALL),
finished AS (
  SELECT *, codon_start = 1 AND raw LIKE '%*' AND raw NOT LIKE 'M%' AND first_codon IN (SELECT unnest(CASE table_id
     {" ".join(f"WHEN {t} THEN {sorted(genetic_codes()[t].starts)!r}" for t in (1, 2, 4, 11))} END)) AS initiator
  FROM translated)"""
_TRANSLATED = ["constructs", "features", "feature_parts", "feature_bases", "translated"]


@query(
    "translate_all_cds",
    with_ctes(*_TRANSLATED, """
SELECT record_id, feature_id, table_id, codon_start, CASE WHEN initiator THEN 'M' || substr(raw, 2) ELSE raw END AS protein,
       CAST(length(replace(raw[:-2], '*', '**')) - length(raw[:-2]) AS INTEGER) AS internal_stops, raw LIKE '%*' AS terminal_stop,
       CAST((size - codon_start + 1) % 3 AS INTEGER) AS trailing_bases, first_codon = 'ATG' AS starts_with_atg, initiator AS initiator_as_methionine
FROM finished"""),
)
def translate_all_cds(spark, sf_dir):
    done, _ = T.translate_all_cds(qualified_features(spark, sf_dir), feature_parts(spark, sf_dir), constructs(spark, sf_dir))
    return done.select("record_id", "feature_id", "table_id", "codon_start", "protein", F.size("internal_stops").alias("internal_stops"),
                       "terminal_stop", F.col("trailing_bases").cast("int").alias("trailing_bases"), "starts_with_atg", "initiator_as_methionine")


@query(
    "translation_skipped",
    with_ctes(*_TRANSLATED, """
SELECT record_id, feature_id, CASE WHEN codon_start = 4 THEN 'invalid codon_start' WHEN strand = 'unknown' THEN 'unknown strand'
       ELSE 'coding sequence shorter than one codon' END AS error
FROM wanted WHERE codon_start = 4 OR strand = 'unknown' OR length(s) - codon_start + 1 < 3"""),
)
def translation_skipped(spark, sf_dir):
    return T.translate_all_cds(qualified_features(spark, sf_dir), feature_parts(spark, sf_dir), constructs(spark, sf_dir))[1]


@query(
    "translation_warnings",
    with_ctes(*_TRANSLATED, """
SELECT record_id, feature_id, 'internal_stop_codons' AS code FROM finished WHERE raw[:-2] LIKE '%*%'
UNION ALL SELECT record_id, feature_id, 'incomplete_terminal_codon' FROM finished WHERE (size - codon_start + 1) % 3 > 0
UNION ALL SELECT record_id, feature_id, 'imported_translation_differs' FROM finished
WHERE rtrim(CASE WHEN initiator THEN 'M' || substr(raw, 2) ELSE raw END, '') <> raw AND replace(raw, '*', '') <> ''"""),
)
def translation_warnings(spark, sf_dir):
    done, _ = T.translate_all_cds(qualified_features(spark, sf_dir), feature_parts(spark, sf_dir), constructs(spark, sf_dir))
    plain = done.withColumn("imported", F.expr("if(initiator_as_methionine, concat('?', substring(protein, 2)), protein)"))
    return T.translation_warnings(T.compare_imported(plain))


@query(
    "codon_positions",
    with_ctes(*_TRANSLATED, """
steps AS (SELECT p.record_id, p.feature_id, p.strand, p.part_index, (p.start + j) % 512 AS pos, j FROM feature_parts p, range(0, 80) r(j)
          WHERE j < p.length AND (p.record_id, p.feature_id) IN (SELECT (record_id, feature_id) FROM finished)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id, feature_id ORDER BY CASE WHEN strand = 'reverse' THEN -1 ELSE 1 END * part_index,
                                         CASE WHEN strand = 'reverse' THEN -1 ELSE 1 END * j) - 1 AS k FROM steps)""", """
SELECT a.record_id, a.feature_id, a.i AS codon_index, a.codon, r1.pos AS position_1, r3.pos AS position_3
FROM amino a JOIN ranked r1 ON r1.record_id = a.record_id AND r1.feature_id = a.feature_id AND r1.k = a.codon_start - 1 + 3 * a.i
JOIN ranked r3 ON r3.record_id = a.record_id AND r3.feature_id = a.feature_id AND r3.k = a.codon_start + 1 + 3 * a.i"""),
)
def codon_positions(spark, sf_dir):
    parts = feature_parts(spark, sf_dir)
    done, _ = T.translate_all_cds(qualified_features(spark, sf_dir), parts, constructs(spark, sf_dir))
    return T.codon_positions(done, parts).select(
        "record_id", "feature_id", F.col("codon_index").cast("bigint").alias("codon_index"), "codon", "position_1", "position_3"
    )


@query(
    "translate_ranges",
    with_ctes("constructs", f"""
asked AS (SELECT record_id, record_id * 7 % 512 AS s, record_id * 13 % 512 AS e, topology, CAST(record_id % 3 AS INTEGER) AS frame,
                 record_id % 2 = 1 AND record_id % 5 = 0 OR record_id % 4 = 0 AS back, sequence, length AS n FROM constructs),
valid AS (SELECT *, CASE WHEN e > s THEN e - s ELSE n - s + e END AS w FROM asked WHERE e > s OR (e < s AND topology = 'circular')),
seqs AS (SELECT record_id, frame, CASE WHEN back THEN reverse(translate(substr(sequence || sequence, CAST(s + 1 AS BIGINT), w), 'ACGT', 'TGCA'))
                           ELSE substr(sequence || sequence, CAST(s + 1 AS BIGINT), w) END AS q FROM valid),
cods AS (SELECT record_id, i, substr(q, frame + 1 + 3 * i, 3) AS codon FROM seqs, range(0, 171) r(i) WHERE frame + 3 * i + 3 <= length(q))""",
              f"""SELECT a.record_id, p.protein, v.record_id IS NULL OR p.protein IS NULL AS refused FROM asked a LEFT JOIN valid v USING (record_id)
LEFT JOIN (SELECT record_id, string_agg({_amino('codon')}, '' ORDER BY i) AS protein FROM cods GROUP BY record_id) p USING (record_id)"""),
)
def translate_ranges(spark, sf_dir):
    asked = constructs(spark, sf_dir).selectExpr(
        "record_id", "'range' as range_id", "record_id * 7 % 512 as start", "record_id * 13 % 512 as end",
        "if(record_id % 2 = 1 and record_id % 5 = 0 or record_id % 4 = 0, 'reverse', 'forward') as strand",
        "cast(record_id % 3 as int) as frame", "1 as table_id",
    )
    return T.translate_ranges(asked, constructs(spark, sf_dir)).select(
        "record_id", F.when(F.col("error").isNull(), F.col("protein")).alias("protein"), F.col("error").isNotNull().alias("refused"))


@query(
    "six_frames",
    with_ctes("constructs", """
strands AS (SELECT record_id, 'forward' AS strand, sequence AS q FROM constructs
            UNION ALL SELECT record_id, 'reverse', reverse(translate(sequence, 'ACGT', 'TGCA')) FROM constructs),
cods AS (SELECT record_id, strand, o, i, substr(q, CAST(o + 1 + 3 * i AS BIGINT), 3) AS codon FROM strands, range(0, 3) f(o), range(0, 171) r(i) WHERE o + 3 * i + 3 <= 512)""",
              f"""SELECT record_id, strand, CAST(o AS INTEGER) AS "offset", CASE WHEN strand = 'forward' THEN o ELSE 511 - o END AS first,
       string_agg({_amino('codon')}, '' ORDER BY i) AS protein FROM cods GROUP BY record_id, strand, o"""),
)
def six_frames(spark, sf_dir):
    return T.six_frames(constructs(spark, sf_dir))


def _orf_sql(table, min_codons, starts):
    code = genetic_codes()[table]
    stops = tuple(c for c, a in code.amino_acids.items() if a == "*")
    opens = ("ATG", "ATG") if starts == "atg_only" else tuple(code.starts)
    return with_ctes("constructs", f"""
turned AS (SELECT record_id, topology, 'forward' AS strand, sequence AS q FROM constructs
           UNION ALL SELECT record_id, topology, 'reverse', reverse(translate(sequence, 'ACGT', 'TGCA')) FROM constructs),
scan AS (SELECT record_id, strand, CASE WHEN topology = 'circular' THEN q || q ELSE q END AS q FROM turned),
codons AS (SELECT record_id, strand, i, i % 3 AS phase, substr(q, CAST(i + 1 AS BIGINT), 3) AS codon FROM scan, range(0, 1022) r(i) WHERE i + 3 <= length(q)),
marks AS (SELECT *, codon IN {stops} AS is_stop FROM codons WHERE codon IN {stops} OR codon IN {opens}),
grouped AS (SELECT *, coalesce(sum(CAST(is_stop AS INTEGER)) OVER (PARTITION BY record_id, strand, phase ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM marks),
spans AS (SELECT record_id, strand, phase, min(i) FILTER (NOT is_stop) AS b, max(i) FILTER (is_stop) AS e FROM grouped GROUP BY record_id, strand, phase, g),
ok AS (SELECT *, e + 3 - b AS w FROM spans WHERE b < 512 AND e + 3 - b <= 512 AND (e + 3 - b) // 3 - 1 >= {min_codons}),
best AS (SELECT record_id, strand, e % 512 AS k, max(w) AS length, min(b) FILTER (w = (SELECT max(w) FROM ok o WHERE o.record_id = ok.record_id AND o.strand = ok.strand AND o.e % 512 = ok.e % 512)) AS b FROM ok GROUP BY record_id, strand, e % 512)""",
                     """SELECT record_id, strand, CASE WHEN strand = 'forward' THEN b % 512 ELSE 511 - (b + length - 1) % 512 END AS start, length,
       length // 3 - 1 AS codons, b % 512 % 3 AS frame,
       (CASE WHEN strand = 'forward' THEN b % 512 ELSE 511 - (b + length - 1) % 512 END) + length > 512 AS wraps_origin FROM best""")


@query("open_reading_frames", _orf_sql(1, 20, "atg_only"))
def open_reading_frames(spark, sf_dir):
    return T.find_orfs(constructs(spark, sf_dir), 1, 20).select("record_id", "strand", "start", "length", "codons", "frame", "wraps_origin")


@query("open_reading_frames_table_starts", _orf_sql(11, 10, "table_starts"))
def open_reading_frames_table_starts(spark, sf_dir):
    return T.find_orfs(constructs(spark, sf_dir), 11, 10, "table_starts").select("record_id", "strand", "start", "length", "codons", "frame", "wraps_origin")


@query(
    "codon_usage_by_code",
    with_ctes("constructs", """
cods AS (SELECT substr(sequence, CAST(3 * i + 1 AS BIGINT), 3) AS codon FROM constructs, range(0, 170) r(i))""",
              "codes(table_id, letters) AS (VALUES " + ", ".join(f"({t}, '{''.join(c.amino_acids.values())}')" for t, c in genetic_codes().items()) + ")",
              f"SELECT table_id, substr(letters, CAST({_index('codon')} + 1 AS BIGINT), 1) AS amino_acid, CAST(count(*) AS BIGINT) AS codons FROM cods, codes GROUP BY ALL"),
)
def codon_usage_by_code(spark, sf_dir):
    counted = constructs(spark, sf_dir).select(F.explode(T.split_codons(F.col("sequence"))).alias("codon")).groupBy("codon").count()
    return counted.join(F.broadcast(code_dimension(spark)), "codon").groupBy("table_id", "amino_acid").agg(F.sum("count").alias("codons"))
