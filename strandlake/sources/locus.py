"""Gene-locus bundles: nested JSON to a record, transcript features and expression tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import normalize_dna

SCHEMA = """format string, version int, annotation_version string, genomic_start bigint, genomic_end bigint, flank bigint, sequence string,
gene struct<symbol string, gene_id string, chrom string, strand string, gene_type string>,
transcripts array<struct<transcript_id string, transcript_type string, is_mane_select boolean, is_ensembl_canonical boolean, is_basic boolean,
  tsl string, appris string, cds_start_nf boolean, cds_end_nf boolean, protein_id string, aa_len bigint,
  exons array<array<bigint>>, cds array<array<bigint>>, cds_includes_stop boolean, codon_start int,
  start_codon struct<position bigint, split boolean>, stop_codon struct<position bigint, split boolean>, protein string,
  evidence struct<state string, mappings array<struct<source_transcript_id string, status string, same_exon_chain boolean, same_cds_start boolean, same_cds_stop boolean>>,
    junctions bigint, novel_junctions bigint>,
  expression map<string, array<struct<cell_line string, n_libraries bigint, mean double, min double, max double>>>>>,
panel map<string, struct<cell_lines array<struct<cell_line string, libraries bigint>>, reports_zeros boolean>>,
expression_units string, novel_transcripts bigint, provenance array<struct<source string, version string>>"""

# Display colours by evidence.
COLOR_EXPRESSED, COLOR_NOT_FOUND, COLOR_NO_EVIDENCE = "#0072b2", "#e69f00", "#999999"


def read_locus(spark: SparkSession, path) -> DataFrame:
    """Bundles as rows of ``SCHEMA`` plus ``record_id`` (the file path)."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("record_id", F.col("_metadata.file_path"))


def bundle_rejects(bundles: DataFrame) -> DataFrame:
    """Bundles that cannot be used and why; a bad transcript rejects its bundle."""
    n = F.length("sequence")
    outside = F.expr("""exists(transcripts, t -> exists(concat(t.exons, coalesce(t.cds, array())), b -> b[0] >= b[1] or b[0] < 0 or b[1] > length(sequence)))""")
    codon = F.expr("exists(transcripts, t -> coalesce(t.start_codon.position, 0) >= length(sequence) or coalesce(t.stop_codon.position, 0) >= length(sequence))")
    reason = (
        F.when(~F.coalesce(F.col("format").endswith("-locus"), F.lit(False)), F.lit("not a locus bundle"))
        .when(~F.col("version").eqNullSafe(1), F.lit("unsupported bundle version"))
        .when(normalize_dna("sequence").isNull() | (n == 0), F.lit("invalid sequence"))
        .when(~F.coalesce(F.col("gene.strand").isin("+", "-"), F.lit(False)), F.lit("gene strand is not + or -"))
        .when(F.expr("exists(transcripts, t -> t.exons is null or size(t.exons) = 0)"), F.lit("transcript without exons"))
        .when(outside, F.lit("block outside the locus or empty")).when(codon, F.lit("codon outside the locus"))
    )
    return bundles.select("record_id", reason.alias("reason")).where("reason is not null")


def locus_tables(bundles: DataFrame) -> dict[str, DataFrame]:
    """``records, features, parts, transcripts, expression, panel, warnings`` of valid bundles."""
    good = bundles.join(bundle_rejects(bundles), "record_id", "left_anti")
    records = good.select(
        "record_id", F.concat("gene.symbol", F.lit(" locus")).alias("name"), F.upper("sequence").alias("sequence"),
        F.length("sequence").cast("bigint").alias("length"), F.lit("linear").alias("topology"),
    )
    strand = F.when(F.col("gene.strand") == "+", F.lit("forward")).otherwise(F.lit("reverse"))
    # Feature numbers follow the bundle: one per transcript, two where it codes.
    before = F.expr("aggregate(slice(transcripts, 1, at), 0, (a, x) -> a + if(coalesce(size(x.cds), 0) > 0, 2, 1))")
    listed = good.select("record_id", strand.alias("strand"), "transcripts", "gene", F.posexplode("transcripts").alias("at", "t")).withColumn("before", before).withColumn(
        "coding", F.coalesce(F.size("t.cds"), F.lit(0)) > 0
    ).drop("transcripts")
    measured = F.exists(F.flatten(F.map_values(F.coalesce("t.expression", F.create_map().cast("map<string,array<struct<cell_line:string,n_libraries:bigint,mean:double,min:double,max:double>>>")))), lambda c: c["mean"] > 0)
    state = F.col("t.evidence.state")
    color = (
        F.when((state == "quantified") & measured, F.lit(COLOR_EXPRESSED)).when(state.isin("quantified", "discoverable"), F.lit(COLOR_NOT_FOUND))
        .otherwise(F.lit(COLOR_NO_EVIDENCE))
    )
    transcripts = listed.select(
        "record_id", "strand", "at", F.col("t.transcript_id").alias("transcript_id"), state.alias("state"),
        F.coalesce("t.is_mane_select", F.lit(False)).alias("is_mane_select"), color.alias("color"),
        F.format_string("feature-%04d", F.col("before") + 1).alias("mrna_feature_id"),
        F.when(F.col("coding"), F.format_string("feature-%04d", F.col("before") + 2)).alias("cds_feature_id"),
        "t.transcript_type", "t.tsl", "t.appris", "t.cds_start_nf", "t.cds_end_nf", "t.aa_len", "t.start_codon", "t.stop_codon",
        F.col("t.evidence.novel_junctions").alias("novel_junctions"), F.col("t.evidence.mappings").alias("mappings"),
    )
    blocks = F.filter(F.array(
        F.struct(F.col("before").alias("k"), F.when(F.col("coding"), F.lit("mRNA")).otherwise(F.lit("misc_RNA")).alias("kind"), F.col("t.transcript_id").alias("label"), F.col("t.exons").alias("blocks")),
        F.when(F.col("coding"), F.struct((F.col("before") + 1).alias("k"), F.lit("CDS").alias("kind"), F.concat("t.transcript_id", F.lit(" CDS")).alias("label"), F.col("t.cds").alias("blocks"))),
    ), lambda x: x.isNotNull())

    def entry(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    flags = F.concat_ws("; ", F.coalesce("t.transcript_type", F.lit("transcript")), F.when(F.col("t.is_mane_select"), F.lit("MANE Select")),
                        F.concat(F.lit("TSL "), F.col("t.tsl")), F.concat(F.lit("evidence: "), state))
    named = F.array(entry("gene", F.col("gene.symbol")), entry("transcript_id", F.col("t.transcript_id")))
    own = listed.select("record_id", "strand", color.alias("color"), named.alias("named"), entry("note", flags).alias("note"),
                        F.filter(F.array(entry("codon_start", F.col("t.codon_start")), entry("transl_table", F.lit(1)), entry("protein_id", F.col("t.protein_id"))), lambda q: q["value"].isNotNull()).alias("coding_q"),
                        F.inline(blocks)).withColumn("feature_id", F.format_string("feature-%04d", F.col("k") + 1))
    features = own.select("record_id", "feature_id", (F.col("k") + 1).alias("feature_ord"), "kind", "label", "strand", "color",
                          F.when(F.size("blocks") == 1, F.lit("contiguous")).otherwise(F.lit("join")).alias("operator"),
                          F.concat("named", F.when(F.col("kind") == "CDS", F.col("coding_q")).otherwise(F.array("note"))).alias("qualifiers"))
    parts = own.select("record_id", "feature_id", "strand", F.posexplode(F.array_sort("blocks")).alias("part_index", "b")).select(
        "record_id", "feature_id", "strand", "part_index", F.col("b")[0].alias("start"), (F.col("b")[1] - F.col("b")[0]).alias("length"))
    expression = listed.select("record_id", F.col("t.transcript_id").alias("transcript_id"), F.explode("t.expression").alias("quantifier", "cells")).select(
        "record_id", "transcript_id", "quantifier", F.inline("cells"))
    panel = good.select("record_id", F.explode("panel").alias("quantifier", "p")).select("record_id", "quantifier", "p.reports_zeros", F.explode("p.cell_lines").alias("c")).select(
        "record_id", "quantifier", "reports_zeros", "c.cell_line")
    warnings = listed.where("coding and not coalesce(t.cds_includes_stop, false) and not coalesce(t.cds_end_nf, false)").select(
        "record_id", F.lit("locus_cds_without_stop").alias("code"), F.concat("t.transcript_id", F.lit(": the CDS does not include a stop codon")).alias("message"))
    return {"records": records, "features": features, "parts": parts, "transcripts": transcripts, "expression": expression, "panel": panel, "warnings": warnings}
