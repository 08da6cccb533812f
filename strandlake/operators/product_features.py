"""Features of assembly products: carried from the cores, plus primers and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.annotation import project_features
from strandlake.operators.joining import large


def product_features(components: DataFrame, junctions: DataFrame, cores: DataFrame, parts: DataFrame, features: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(features, warnings)`` of the products.

    ``cores``: ``plan_id, component, record_id, start, length, n, orientation, product_start``.
    Features that survive whole are carried, with pieces that touch merged; clipped ones give
    ``gibson_feature_clipped``. Primers are placed where they anneal on their core, overlaps
    where they lie in the product. Ids follow the start.
    """
    keyed = cores.withColumn("interval_id", F.concat_ws("/", F.col("plan_id").cast("string"), F.col("component").cast("string")))
    intervals = keyed.select("record_id", "interval_id", F.col("start").alias("begin"), F.col("length").alias("size"), "n", (F.col("orientation") == "reverse").alias("bottom"))
    mapped = project_features(parts, intervals).join(large(keyed.select("record_id", "interval_id", "plan_id", "component", "product_start")), ["record_id", "interval_id"])
    warnings = mapped.where("not complete").select(
        "plan_id", F.lit("gibson_feature_clipped").alias("code"),
        F.concat("feature_id", F.lit(": "), F.col("retained_bases").cast("string"), F.lit(" of "), F.col("source_bases").cast("string"), F.lit(" bases retained")).alias("message"))
    pieces = mapped.where("complete").select(
        "plan_id", "component", "record_id", "feature_id", "fragment_strand", "product_start", F.explode("parts_mapped").alias("p"))
    order = Window.partitionBy("plan_id", "component", "feature_id").orderBy("p.fragment_start")
    islands = (
        pieces.withColumn("gap", F.coalesce(F.col("p.fragment_start") != F.lag(F.col("p.fragment_start") + F.col("p.length")).over(order), F.lit(True)))
        .withColumn("island", F.sum(F.col("gap").cast("int")).over(order))
        .groupBy("plan_id", "component", "record_id", "feature_id", "fragment_strand", "island")
        .agg((F.min("p.fragment_start") + F.max("product_start")).alias("start"), F.sum("p.length").alias("length"))
    )
    carried = islands.groupBy("plan_id", "component", "record_id", "feature_id", F.col("fragment_strand").alias("strand")).agg(
        F.array_sort(F.collect_list(F.struct("start", "length"))).alias("parts")
    ).join(large(features.select("record_id", "feature_id", "kind", "label")), ["record_id", "feature_id"]).select("plan_id", "kind", "label", "strand", "parts")
    lying = components.join(large(cores.select("plan_id", "component", "product_start", "length")), ["plan_id", "component"]).where("preparation = 'pcr'")

    def primer(side, start):
        return lying.select(
            "plan_id", F.lit("primer_bind").alias("kind"), F.concat(F.lit(side[0].upper()), F.col("component").cast("string")).alias("label"), F.lit(side).alias("strand"),
            F.array(F.struct(start.cast("bigint").alias("start"), F.length(f"{side}_annealing").cast("bigint").alias("length"))).alias("parts"))

    primers = primer("forward", F.col("product_start")).unionByName(primer("reverse", F.col("product_start") + F.col("length") - F.length("reverse_annealing")))
    overlaps = junctions.where("usable").select(
        "plan_id", F.lit("misc_feature").alias("kind"), F.concat(F.lit("overlap "), F.col("after_component").cast("string")).alias("label"), F.lit("unknown").alias("strand"),
        F.array(F.struct(F.col("product_start").cast("bigint").alias("start"), F.length("overlap_sequence").cast("bigint").alias("length"))).alias("parts"))
    made = products.where("reason is null").select("plan_id")
    every = carried.unionByName(primers).unionByName(overlaps).join(large(made), "plan_id", "left_semi")
    place = Window.partitionBy("plan_id").orderBy(F.col("parts")[0]["start"], "kind", "label")
    return every.withColumn("feature_id", F.format_string("feature-%04d", F.row_number().over(place))), warnings
