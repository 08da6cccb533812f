"""DNA tables derived from the supplied business tables, the same in Spark and in SQL.

Hash digits of a part key spell its bases, line items become its features, customers
become library parts, and events become expression measurements. ``CTES`` holds the
equal SQL, one named fragment per table, for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.joining import large

BLOCKS = 16
LENGTH = 32 * BLOCKS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a compact key table over the session's partitions before it is expanded.

    A part row of a few bytes becomes hundreds of bases and thousands of result rows, so
    input splits by file size would leave most cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _hash_bases(key: str, blocks: int, join: str) -> str:
    digits = join.join(f"md5({key.format(i=i)})" for i in range(blocks))
    text = f"concat({digits})" if join == ", " else digits
    return f"translate({text}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


def constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 512-base construct per part; even keys are circular."""
    bases = _hash_bases("concat(record_id, ':{i}')", BLOCKS, ", ")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), "p_name")
    # Inlined, so that no filter on the bases is pushed below the spread, where few tasks would spell them all.
    spelled = spread(parts, "record_id").select("record_id", "p_name", F.inline(F.array(F.struct(F.expr(bases).alias("sequence")))))
    return spelled.select(
        "record_id",
        F.col("p_name").alias("name"),
        "sequence",
        F.lit(LENGTH).cast("bigint").alias("length"),
        F.expr("if(record_id % 2 = 0, 'circular', 'linear')").alias("topology"),
    )


CTES = {}
CTES["constructs"] = f"""
constructs AS MATERIALIZED (
  SELECT p_partkey AS record_id, p_name AS name,
         {_hash_bases("p_partkey || ':{i}'", BLOCKS, " || ")} AS sequence,
         CAST({LENGTH} AS BIGINT) AS length,
         CASE WHEN p_partkey % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology
  FROM part)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per line item on the construct of its part.

    Features with a line number divisible by four get a second part further along; parts
    wrap on circles and are clipped on linear molecules.
    """
    n = LENGTH
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey as record_id",
        "concat('feature-', l_orderkey, '-', l_linenumber, '-', l_suppkey) as feature_id",
        "(l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey as feature_ord",
        "case l_returnflag when 'A' then 'CDS' when 'R' then 'promoter' else 'misc_feature' end as kind",
        "concat(lower(l_returnflag), l_linestatus, '-', l_suppkey % 7) as label",
        "case l_linenumber % 3 when 0 then 'forward' when 1 then 'reverse' else 'unknown' end as strand",
        f"l_orderkey % {n} as s0",
        "12 + cast(l_quantity as bigint) as w0",
        "l_linenumber % 4 = 0 as two_parts",
        "9 + cast(l_quantity as bigint) % 7 as w1",
        "l_partkey % 2 = 0 as circular",
    )


def feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = LENGTH
    second = f"pmod(s0 + w0 + 10, {n})"
    one = f"named_struct('part_index', 0, 'start', s0, 'length', if(circular, w0, least(w0, {n} - s0)))"
    two = f"named_struct('part_index', 1, 'start', {second}, 'length', if(circular, w1, least(w1, {n} - {second})))"
    return features(spark, sf_dir).selectExpr(
        "record_id", "feature_id", "strand",
        f"inline(if(two_parts, array({one}, {two}), array({one})))",
    )


CTES["features"] = f"""
features AS (
  SELECT l_partkey AS record_id, 'feature-' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS feature_id,
         (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS feature_ord,
         CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'R' THEN 'promoter' ELSE 'misc_feature' END AS kind,
         lower(l_returnflag) || l_linestatus || '-' || (l_suppkey % 7) AS label,
         CASE l_linenumber % 3 WHEN 0 THEN 'forward' WHEN 1 THEN 'reverse' ELSE 'unknown' END AS strand,
         l_orderkey % {LENGTH} AS s0, 12 + CAST(l_quantity AS BIGINT) AS w0,
         l_linenumber % 4 = 0 AS two_parts, 9 + CAST(l_quantity AS BIGINT) % 7 AS w1,
         l_partkey % 2 = 0 AS circular
  FROM lineitem)"""
CTES["feature_parts"] = f"""
feature_parts AS (
  SELECT record_id, feature_id, strand, 0 AS part_index, s0 AS start,
         CASE WHEN circular THEN w0 ELSE least(w0, {LENGTH} - s0) END AS length FROM features
  UNION ALL
  SELECT record_id, feature_id, strand, 1, (s0 + w0 + 10) % {LENGTH},
         CASE WHEN circular THEN w1 ELSE least(w1, {LENGTH} - (s0 + w0 + 10) % {LENGTH}) END
  FROM features WHERE two_parts)"""


def with_ctes(*names_and_body: str) -> str:
    """``with_ctes('constructs', ..., body)``: the named fragments and own CTE text, then the query."""
    *names, body = names_and_body
    return "WITH RECURSIVE " + ",\n".join(CTES.get(n, n) for n in names) + "\n" + body


def _part_of(key: str, cut: str) -> tuple[str, str, str]:
    """Base customer, start and length of a customer's library part; every fourth customer
    carries a trimmed copy and another fourth a point mutant of a neighbour's part."""
    base = f"({key} - CASE {key} % 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 0 END)"
    trim = f"CASE WHEN {key} % 4 = 3 THEN {cut} ELSE 0 END"
    return base, f"(({base} * 37) % 300 + {trim})", f"(24 + ({base} * 7) % 140 - 2 * {trim})"


_BASE, _START, _WIDTH = _part_of("c", "2")


def library_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part per customer: a stretch of a construct, some trimmed or mutated."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    digits = f"array_join(transform(sequence(0, {BLOCKS - 1}), i -> md5(concat(base, ':', i))), '')"
    bases = f"translate({digits}, '0123456789abcdef', 'ACGTACGTACGTACGT')"
    return (
        spread(keys, "c").selectExpr("c", f"{_BASE} as base", f"cast({_START} as int) as s", f"cast({_WIDTH} as int) as w")
        # Inlined as in ``constructs``: joins on the part would else have it spelled below the spread, in one task.
        .selectExpr("c", "base", "s", "w", f"inline(array(named_struct('whole', substring({bases}, s + 1, w))))")
        .selectExpr(
            "c", "base", "cast(s as bigint) as start",
            "if(c % 4 = 2, concat(substring(whole, 1, w div 2), translate(substring(whole, w div 2 + 1, 1), 'ACGT', 'TGCA'), substring(whole, w div 2 + 2)), whole) as part",
        )
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library occurrences: one per order, half of them read on the other strand."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as c", "o_orderkey as feature_ord", "concat('plasmid-', lpad(cast(o_orderkey % 500 as string), 4, '0')) as source_path",
        "o_orderpriority as p", "o_orderstatus as st",
    )
    return orders.join(large(library_parts(spark, sf_dir)), "c").selectExpr(
        "source_path", "feature_ord",
        "case substring(p, 1, 1) when '1' then concat('part-', base) when '2' then concat('PART ', base) else concat('Part ', base) end as label",
        "case st when 'O' then 'CDS' when 'F' then 'promoter' else 'misc_feature' end as kind",
        "case feature_ord % 3 when 0 then '#ff0000' when 1 then '#00ff00' end as color",
        "array(named_struct('key', 'note', 'value', p)) as qualifiers",
        "if(feature_ord % 2 = 0, part, reverse(translate(part, 'ACGT', 'TGCA'))) as sequence",
        "least(part, reverse(translate(part, 'ACGT', 'TGCA'))) as canonical",
        "feature_ord % 5 > 1 as stranded", "start", "1L as parts",
    )


CTES["library_parts"] = f"""
picked AS (SELECT c_custkey AS c, {_BASE.replace('c ', 'c_custkey ')} AS base, {_START.replace('c ', 'c_custkey ')} AS s, {_WIDTH.replace('c ', 'c_custkey ')} AS w FROM customer),
cut_out AS (SELECT c, base, s, w, substr(translate({" || ".join(f"md5(base || ':{i}')" for i in range(BLOCKS))}, '0123456789abcdef', 'ACGTACGTACGTACGT'), CAST(s + 1 AS BIGINT), CAST(w AS BIGINT)) AS whole FROM picked),
library_parts AS (
  SELECT c, base, s AS start, CASE WHEN c % 4 = 2 THEN whole[:w // 2] || translate(whole[w // 2 + 1], 'ACGT', 'TGCA') || whole[w // 2 + 2:] ELSE whole END AS part FROM cut_out)"""
CTES["occurrences"] = """
occurrences AS MATERIALIZED (
  SELECT 'plasmid-' || lpad(CAST(o_orderkey % 500 AS VARCHAR), 4, '0') AS source_path, o_orderkey AS feature_ord,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'part-' || base WHEN '2' THEN 'PART ' || base ELSE 'Part ' || base END AS label,
         CASE o_orderstatus WHEN 'O' THEN 'CDS' WHEN 'F' THEN 'promoter' ELSE 'misc_feature' END AS kind,
         CASE o_orderkey % 3 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#00ff00' END AS color,
         CASE WHEN o_orderkey % 2 = 0 THEN part ELSE reverse(translate(part, 'ACGT', 'TGCA')) END AS sequence,
         least(part, reverse(translate(part, 'ACGT', 'TGCA'))) AS canonical, o_orderkey % 5 > 1 AS stranded, start
  FROM orders JOIN library_parts ON c = o_custkey)"""
CTES["lib_features"] = """
numbered AS (SELECT *, row_number() OVER (ORDER BY source_path, feature_ord) AS id FROM occurrences),
named AS (SELECT canonical, label, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, f) AS r FROM (SELECT canonical, label, count(*) AS n, min(id) AS f FROM numbered GROUP BY ALL)),
kinds AS (SELECT canonical, kind, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, f) AS r FROM (SELECT canonical, kind, count(*) AS n, min(id) AS f FROM numbered GROUP BY ALL)),
colors AS (SELECT canonical, color, row_number() OVER (PARTITION BY canonical ORDER BY n DESC, f) AS r FROM (SELECT canonical, color, count(*) AS n, min(id) AS f FROM numbered WHERE color IS NOT NULL GROUP BY ALL)),
lib_features AS MATERIALIZED (
  SELECT o.canonical, n.label AS name, k.kind, c.color, length(o.canonical) AS length, count(*) AS occurrences, min(o.id) AS first_id,
         2 * count(*) FILTER (o.stranded) >= count(*) AS stranded, arg_min(o.sequence, o.id) FILTER (o.label = n.label) AS sequence
  FROM numbered o JOIN named n ON n.canonical = o.canonical AND n.r = 1 JOIN kinds k ON k.canonical = o.canonical AND k.r = 1
  LEFT JOIN colors c ON c.canonical = o.canonical AND c.r = 1 GROUP BY o.canonical, n.label, k.kind, c.color)"""


# Six forms of one coding stretch per group of customers: as it is, two bases changed, turned with a base lost, trimmed,
# other codons for the same residues, and every twentieth base changed.
_STRETCH = "substr({bases}, CAST(1 + g % 50 AS {int}), CAST(330 + 3 * (g % 7) AS {int}))"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long features of many forms, one per customer; one group in ten shares a name."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    digits = f"array_join(transform(sequence(0, {BLOCKS - 1}), i -> md5(concat(g, '-', i))), '')"
    stretch = _STRETCH.format(bases=f"translate({digits}, '0123456789abcdef', 'ACGTACGTACGTACGT')", int="int")
    turn = "reverse(translate({0}, 'ACGT', 'TGCA'))"
    form = f"""case c % 6 when 0 then s
      when 1 then concat(substring(s, 1, 99), translate(substring(s, 100, 1), 'ACGT', 'TGCA'), substring(s, 101, 99), translate(substring(s, 200, 1), 'ACGT', 'TGCA'), substring(s, 201))
      when 2 then {turn.format("concat(substring(s, 1, 150), substring(s, 152))")}
      when 3 then substring(s, 11, length(s) - 20)
      when 4 then array_join(transform(sequence(0, length(s) div 3 - 1), i -> concat(substring(s, 3 * i + 1, 2), translate(substring(s, 3 * i + 3, 1), 'T', 'C'))), '')
      else array_join(transform(sequence(1, length(s)), i -> if(i % 20 = 0, translate(substring(s, i, 1), 'ACGT', 'TGCA'), substring(s, i, 1))), '') end"""
    return spread(keys, "c").selectExpr("c", "c - c % 6 as g").selectExpr("c", "g", f"inline(array(named_struct('s', {stretch})))").selectExpr(
        "concat('variant-', c) as library_id", f"{form} as sequence", "if(c % 6 = 3, 'misc_feature', 'CDS') as kind",
        "array(case when c % 6 = 3 then concat('trimmed ', c) when g % 60 = 0 then 'Common' when c % 6 = 1 then concat('FAM ', g) else concat('fam-', g) end, concat('own ', c)) as names",
        "c % 30 = 7 as standalone", "c as first_seen",
    )


CTES["variants"] = f"""
stretches AS (SELECT c, g, {_STRETCH.format(bases="translate(" + " || ".join(f"md5(g || '-{i}')" for i in range(BLOCKS)) + ", '0123456789abcdef', 'ACGTACGTACGTACGT')", int="BIGINT")} AS s
              FROM (SELECT c_custkey AS c, c_custkey - c_custkey % 6 AS g FROM customer)),
family_features AS MATERIALIZED (
  SELECT 'variant-' || c AS library_id,
    CASE c % 6 WHEN 0 THEN s
      WHEN 1 THEN s[1:99] || translate(s[100], 'ACGT', 'TGCA') || s[101:199] || translate(s[200], 'ACGT', 'TGCA') || s[201:]
      WHEN 2 THEN reverse(translate(s[1:150] || s[152:], 'ACGT', 'TGCA'))
      WHEN 3 THEN s[11:length(s) - 10]
      WHEN 4 THEN array_to_string([s[3 * i + 1:3 * i + 2] || translate(s[3 * i + 3], 'T', 'C') FOR i IN range(0, length(s) // 3)], '')
      ELSE array_to_string([CASE WHEN i % 20 = 0 THEN translate(s[i], 'ACGT', 'TGCA') ELSE s[i] END FOR i IN range(1, length(s) + 1)], '') END AS seq,
    c % 6 <> 3 AS cds, [CASE WHEN c % 6 = 3 THEN 'trimmed' || c WHEN g % 60 = 0 THEN 'common' ELSE 'fam' || g END, 'own' || c] AS names, c % 30 = 7 AS standalone, c AS ord
  FROM stretches)"""
