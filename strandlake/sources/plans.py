"""Design plans as JSON tables: one plan per row, so thousands of designs run in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.assembly import pcr_products

SCHEMAS = {
    "ligation": """plan_id string, version int, topology string, inputs array<struct<path: string, enzymes: array<string>>>,
      fragments array<struct<input: int, fragment_id: string, orientation: string>>""",
    "assembly": """plan_id string, version int, topology string, overlap_length int, annealing_length int, inputs array<struct<path: string>>,
      cores array<struct<input: int, start: bigint, length: bigint, orientation: string, preparation: string>>""",
    "overlaps": """plan_id string, version int, topology string, overlaps array<int>, inputs array<struct<path: string>>,
      fragments array<struct<input: int, start: bigint, length: bigint, orientation: string>>""",
}
VERSIONS = {"ligation": 1, "assembly": 2, "overlaps": 1}


def read_plans(spark: SparkSession, kind: str, path) -> tuple[DataFrame, DataFrame]:
    """Plans of one kind and the refused ones: ``(plans, rejects)``.

    Malformed JSON, fields outside the schema, another version or topology, and empty
    component lists are refused.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    schema = SCHEMAS[kind]
    known = spark.createDataFrame([], schema).columns
    parsed = text.select(
        "source_path", "value", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"),
        F.json_object_keys("value").alias("fields"),
    ).select("source_path", "p.*", "fields").withColumn("plan_id", F.coalesce("plan_id", "source_path"))
    items = {"ligation": "fragments", "assembly": "cores", "overlaps": "fragments"}[kind]
    reason = (
        F.when(F.col("_corrupt_record").isNotNull() | F.col("fields").isNull(), F.lit("malformed JSON"))
        .when(F.size(F.array_except("fields", F.array(*[F.lit(c) for c in known]))) > 0, F.lit("unknown field"))
        .when(~F.col("version").eqNullSafe(VERSIONS[kind]), F.lit("unsupported plan version"))
        .when(~F.coalesce(F.col("topology").isin("linear", "circular"), F.lit(False)), F.lit("topology must be linear or circular"))
        .when(F.coalesce(F.size(items), F.lit(0)) == 0, F.lit("plan selects nothing"))
        .when(F.exists(items, lambda x: (x["input"] < 1) | (x["input"] > F.size("inputs"))), F.lit("invalid input number"))
        .when(F.exists(items, lambda x: ~x["orientation"].isin("forward", "reverse")), F.lit("invalid orientation"))
    )
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason", "_corrupt_record", "fields"), judged.where("reason is not null").select("source_path", "plan_id", "reason")


def ligation_rows(plans: DataFrame) -> DataFrame:
    """Component rows for ``operators.ligation``; ``record_id`` is the path of the input."""
    return plans.select("plan_id", "topology", "inputs", F.size("inputs").alias("input_count"), F.posexplode("fragments").alias("ord", "f")).select(
        "plan_id", "topology", F.col("input_count").alias("inputs"), "ord", "f.input", F.expr("inputs[f.input - 1].path").alias("record_id"),
        F.expr("inputs[f.input - 1].enzymes").alias("enzymes"), "f.fragment_id", "f.orientation")


def assembly_rows(plans: DataFrame) -> DataFrame:
    """Component rows for ``operators.assembly.design_assembly``."""
    return plans.select("plan_id", "topology", "inputs", F.col("overlap_length").alias("overlap"), F.col("annealing_length").alias("annealing"),
                        F.posexplode("cores").alias("ord", "c")).select(
        "plan_id", "topology", "overlap", "annealing", "ord", F.expr("inputs[c.input - 1].path").alias("record_id"),
        "c.start", "c.length", "c.orientation", "c.preparation")


def overlap_rows(plans: DataFrame) -> DataFrame:
    """Component rows for ``operators.assembly.assemble_overlaps``."""
    return plans.select("plan_id", "topology", "inputs", "overlaps", F.posexplode("fragments").alias("ord", "f")).select(
        "plan_id", "topology", "ord", F.expr("inputs[f.input - 1].path").alias("record_id"), "f.start", "f.length", "f.orientation",
        F.coalesce(F.expr("get(overlaps, ord)"), F.lit(0)).alias("overlap"))


def assembly_sources(records: DataFrame | None = None, literals: DataFrame | None = None, digest_strands: DataFrame | None = None,
                     fragments: DataFrame | None = None, pcr: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """One table of assembly inputs from files, literal sequences, digest strands and PCR.

    ``literals``: ``record_id, sequence``; ``digest_strands``: ``record_id, source_record,
    fragment_id, strand`` picked from ``fragments``; ``pcr``: requests for ``pcr_products`` on
    ``templates``.
    """
    columns = ["record_id", "sequence", "length", "topology", "origin"]
    branches = []

    def linear(df, origin):
        return df.select("record_id", "sequence", F.length("sequence").cast("bigint").alias("length"), F.lit("linear").alias("topology"), F.lit(origin).alias("origin"))

    if records is not None:
        branches.append(records.withColumn("origin", F.lit("file")).select(*columns))
    if literals is not None:
        branches.append(linear(literals, "literal"))
    if digest_strands is not None:
        picked = digest_strands.join(fragments.select(F.col("record_id").alias("source_record"), "fragment_id", "top", "bottom"), ["source_record", "fragment_id"])
        branches.append(linear(picked.withColumn("sequence", F.when(F.col("strand") == "bottom", F.col("bottom.sequence")).otherwise(F.col("top.sequence"))), "digest"))
    if pcr is not None:
        made = pcr_products(pcr, templates).where("reason is null").select(F.col("product_id").alias("record_id"), F.col("product").alias("sequence"))
        branches.append(linear(made, "pcr"))
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out
