"""Inspection, filters, integrity checks and batch edits of annotated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.joining import large
from strandlake.operators.translation import translate_features


def inspect(records: DataFrame, features: DataFrame, primers: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One row per record with its counts of features, primers and warnings."""
    out = records.select("record_id", "name", "length", "topology")
    for name, table in (("features", features), ("primers", primers), ("warnings", warnings)):
        if table is None:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
        else:
            out = out.join(large(table.groupBy("record_id").agg(F.count("*").alias(name))), "record_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def list_features(features: DataFrame, label: str | None = None, kind: str | None = None) -> DataFrame:
    """Features whose label holds a text and whose kind equals one, ignoring case, in source order."""
    out = features
    if label is not None:
        out = out.where(F.lower("label").contains(label.lower()))
    if kind is not None:
        out = out.where(F.lower("kind") == kind.lower())
    return out.orderBy("record_id", "feature_ord")


def list_primers(primers: DataFrame) -> DataFrame:
    return primers.select("record_id", "primer_ord", "name", "sequence", "description").orderBy("record_id", "primer_ord")


def sequence_range(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Bases of ``[start, end)`` per request, without wrapping; bad ranges carry an ``error``."""
    joined = requests.join(large(records.select("record_id", "sequence")), "record_id", "left")
    bad = F.col("sequence").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("sequence"))
    return joined.select(
        *requests.columns,
        F.when(~bad, F.substring("sequence", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("bases"),
        F.when(bad, F.lit("range outside the record")).alias("error"),
    )


def strict(records: DataFrame, warnings: DataFrame) -> DataFrame:
    """Only the records that were read without any warning."""
    return records.join(large(warnings.select("record_id").distinct()), "record_id", "left_anti")


def integrity_report(records: DataFrame, features: DataFrame, parts: DataFrame) -> DataFrame:
    """``(record_id, feature_id, problem)`` for every broken rule of the data model."""
    repeated = features.groupBy("record_id", "feature_id").agg(F.count("*").alias("k")).where("k > 1").select("record_id", "feature_id", F.lit("duplicate feature id").alias("problem"))
    unnamed = features.where("feature_id is null or feature_id = ''").select("record_id", "feature_id", F.lit("empty feature id").alias("problem"))
    sized = parts.join(large(records.select("record_id", F.col("length").alias("n"), "topology")), "record_id", "left")
    problem = (
        F.when(F.col("n").isNull(), F.lit("no such record"))
        .when((F.col("start") < 0) | (F.col("start") >= F.col("n")) | (F.col("length") <= 0) | (F.col("length") > F.col("n")), F.lit("region outside the molecule"))
        .when((F.col("topology") == "linear") & (F.col("start") + F.col("length") > F.col("n")), F.lit("arc on a linear molecule"))
    )
    regions = sized.select("record_id", "feature_id", problem.alias("problem")).where("problem is not null")
    out = repeated.unionByName(unnamed).unionByName(regions)
    counts = parts.groupBy("record_id", "feature_id").agg(F.count("*").alias("k"))
    if "operator" in features.columns:
        out = out.unionByName(
            features.join(large(counts), ["record_id", "feature_id"], "left").where("k is null or (operator = 'contiguous') != (k = 1)")
            .select("record_id", "feature_id", F.lit("operator does not match the number of parts").alias("problem"))
        )
    dirty = records.where(~F.col("sequence").rlike("^[ACGTRYSWKMBDHVN]+$")).select("record_id", F.lit(None).cast("string").alias("feature_id"), F.lit("symbol outside the alphabet").alias("problem"))
    return out.unionByName(dirty)


def edit_rejects(edits: DataFrame, records: DataFrame) -> DataFrame:
    """Edits that cannot be applied, with the reason."""
    sized = edits.join(large(records.select("record_id", F.col("length").alias("n"), "topology")), "record_id", "left")
    reason = (
        F.when(F.col("n").isNull(), F.lit("no such record"))
        .when(F.trim("label") == "", F.lit("empty label"))
        .when(~F.col("kind").rlike(r"^\S+$"), F.lit("invalid kind"))
        .when(F.col("color").isNotNull() & ~F.col("color").rlike("^#[0-9A-Fa-f]{6}$"), F.lit("invalid colour"))
        .when((F.col("start") < 0) | (F.col("start") >= F.col("n")) | (F.col("end") < 0) | (F.col("end") > F.col("n")) | (F.col("start") == F.col("end"))
              | ((F.col("end") < F.col("start")) & (F.col("topology") == "linear")), F.lit("invalid range"))
        .when(F.col("translate") & (F.col("strand") == "unknown"), F.lit("a translated feature needs a strand"))
    )
    return sized.select("record_id", "edit_ord", reason.alias("reason")).where("reason is not null")


def add_features(edits: DataFrame, records: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New single-part features from ``(record_id, edit_ord, label, kind, color, start, end,
    strand, translate, codon_start, transl_table, note)``: ``(features, parts, warnings)``.

    Ids continue after the highest one of the record; ``end < start`` wraps on circles. With
    ``translate`` the protein joins the qualifiers and oddities are reported.
    """
    good = edits.join(large(edit_rejects(edits, records)), ["record_id", "edit_ord"], "left_anti").join(
        large(records.select("record_id", F.col("length").alias("n"))), "record_id")
    number = F.expr(r"try_cast(regexp_extract(feature_id, '^feature-(\\d+)$', 1) as bigint)")
    highest = features.groupBy("record_id").agg(F.max(number).alias("top"), F.max("feature_ord").alias("last"))
    order = Window.partitionBy("record_id").orderBy("edit_ord")
    placed = good.join(large(highest), "record_id", "left").withColumn("k", F.row_number().over(order)).withColumn(
        "feature_id", F.format_string("feature-%04d", F.coalesce("top", F.lit(0)) + F.col("k"))
    ).withColumn("feature_ord", F.coalesce("last", F.lit(0)) + F.col("k"))
    wide = F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).otherwise(F.col("n") - F.col("start") + F.col("end"))
    parts = placed.select("record_id", "feature_id", "strand", F.lit(0).alias("part_index"), F.col("start").cast("bigint").alias("start"), wide.cast("bigint").alias("length"))

    def entry(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    coding = placed.where("translate").select("record_id", "feature_id", F.array(entry("codon_start", F.col("codon_start")), entry("transl_table", F.col("transl_table"))).alias("qualifiers"))
    proteins = translate_features(coding, parts.join(large(coding.select("record_id", "feature_id")), ["record_id", "feature_id"], "left_semi"), records)
    shown = placed.join(large(proteins.select("record_id", "feature_id", F.regexp_replace("protein", r"\*$", "").alias("translation"))), ["record_id", "feature_id"], "left")
    qualifiers = F.filter(F.array(
        F.when(F.col("translate"), entry("codon_start", F.col("codon_start"))), F.when(F.col("translate"), entry("transl_table", F.col("transl_table"))),
        F.when(F.col("translation").isNotNull(), entry("translation", F.col("translation"))), F.when(F.col("note").isNotNull(), entry("note", F.col("note"))),
    ), lambda q: q.isNotNull())
    added = shown.select("record_id", "feature_id", "feature_ord", F.when(F.col("translate"), F.lit("CDS")).otherwise(F.col("kind")).alias("kind"), F.trim("label").alias("label"), "color", "strand", F.lit("contiguous").alias("operator"), qualifiers.alias("qualifiers"))
    checks = F.filter(F.array(
        F.when(F.size("internal_stops") > 0, F.lit("internal_stop")), F.when(F.col("trailing_bases") > 0, F.lit("incomplete_codon")),
        F.when(~F.col("terminal_stop"), F.lit("no_stop")), F.when(~F.col("protein").startswith("M"), F.lit("no_start")),
    ), lambda c: c.isNotNull())
    warnings = proteins.where("error is null").select("record_id", "feature_id", F.explode(checks).alias("code"))
    return added, parts, warnings


def remove_features(features: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features without the wanted ones, and the wanted ids that do not exist."""
    keys = ["record_id", "feature_id"]
    return features.join(large(wanted.select(*keys)), keys, "left_anti"), wanted.join(large(features.select(*keys)), keys, "left_anti")
