"""SQL functions of the scalar helpers, for ``spark.sql`` users.

They are SQL expressions that the analyzer inlines, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandlake.functions import kernels

# name, arguments, result type, body
FUNCTIONS = [
    ("normalize_dna", "s STRING", "STRING", "if(upper(s) rlike '^[ACGTRYSWKMBDHVN]+$', upper(s), null)"),
    ("complement_3to5", "s STRING", "STRING", "translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')"),
    ("revcomp_iupac", "s STRING", "STRING", "reverse(translate(s, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))"),
    ("revcomp", "s STRING", "STRING", "if(s rlike '^[ACGT]*$', reverse(translate(s, 'ACGT', 'TGCA')), null)"),
    ("canonical_dna", "s STRING", "STRING", "if(s rlike '^[ACGT]*$', least(s, reverse(translate(s, 'ACGT', 'TGCA'))), null)"),
    ("gc_bases", "s STRING", "INT", "length(regexp_replace(s, '[^GC]', ''))"),
    ("gc_fraction", "s STRING", "DOUBLE", "length(regexp_replace(s, '[^GC]', '')) / length(s)"),
    ("fold_name", "s STRING", "STRING", r"lower(regexp_replace(s, '[^\\p{L}\\p{N}]', ''))"),
    ("span_within", "s BIGINT, w BIGINT, os BIGINT, ow BIGINT, n BIGINT", "BOOLEAN", "pmod(s - os, n) + w <= ow"),
    ("circular_slice", "s STRING, start INT, width INT, topology STRING", "STRING",
     "case when start < 0 or start >= length(s) or width <= 0 or width > length(s) then null "
     "when start + width <= length(s) or topology = 'circular' then substring(concat(s, s), start + 1, width) end"),
]


def register(spark: SparkSession) -> None:
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("semiglobal_edits", kernels.semiglobal_edits)
    spark.udf.register("dimer_screen", kernels.dimer_screen)
    spark.udf.register("hairpin_stem", kernels.hairpin_stem)
