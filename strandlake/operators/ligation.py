"""Ligation of selected digest fragments, one plan per design, many plans per job.

``plan`` has one row per component: ``plan_id, ord, input, record_id, fragment_id,
orientation, topology`` (``topology`` of the product, equal on all rows of a plan).
``inputs`` counts the digest instances of the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.ends import end_reason, fits
from strandlake.operators.joining import large

def plan_rejects(plan: DataFrame) -> DataFrame:
    """Plans of an invalid shape, with the reason."""
    per_use = plan.groupBy("plan_id", "input", "fragment_id").agg(
        F.count("*").alias("uses"), F.max("inputs").alias("inputs")
    )
    shape = per_use.groupBy("plan_id").agg(
        F.max("inputs").alias("inputs"), F.sum("uses").alias("components"), F.max("uses").alias("reuse"),
        F.max((F.col("input") < 1) | (F.col("input") > F.col("inputs")) | (F.col("fragment_id") == "")).alias("stray"),
    )
    reason = (
        F.when(F.col("inputs") < 1, F.lit("a plan needs an input digest"))
        .when(F.col("stray"), F.lit("a component names no input or no fragment"))
        .when(F.col("reuse") > 1, F.lit("fragment reused"))
    )
    return shape.select("plan_id", reason.alias("reason")).where("reason is not null")


def _flip_end(end):
    strand = F.when(end["protruding_strand"] == "forward", F.lit("reverse")).when(
        end["protruding_strand"] == "reverse", F.lit("forward")
    )
    return F.when(end.isNotNull(), end.withField("protruding_strand", strand))


def oriented_components(plan: DataFrame, fragments: DataFrame) -> DataFrame:
    """Components with strands and ends as they lie in the product.

    Reversing swaps the whole strands and the ends; the exposed oligos stay as they are.
    """
    joined = plan.join(
        large(fragments.select("record_id", "fragment_id", "top", "bottom", "left_end", "right_end")),
        ["record_id", "fragment_id"], "left",
    )
    back = F.col("orientation") == "reverse"
    return joined.select(
        *plan.columns,
        F.col("top").isNotNull().alias("exists"),
        F.when(back, F.col("bottom.sequence")).otherwise(F.col("top.sequence")).alias("top"),
        F.when(back, F.col("top.sequence")).otherwise(F.col("bottom.sequence")).alias("bottom"),
        F.when(back, _flip_end(F.col("right_end"))).otherwise(F.col("left_end")).alias("left"),
        F.when(back, _flip_end(F.col("left_end"))).otherwise(F.col("right_end")).alias("right"),
    )


def _linked(components: DataFrame) -> DataFrame:
    order = Window.partitionBy("plan_id").orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        components.withColumn("place", F.row_number().over(order))
        .withColumn("count", F.count("*").over(Window.partitionBy("plan_id")))
        .withColumn("next_left", F.coalesce(F.lead("left").over(order), F.first("left").over(whole)))
        .withColumn("top_start", F.sum(F.length("top")).over(order) - F.length("top"))
        .withColumn("bottom_before", F.sum(F.length("bottom")).over(order))
        .withColumn("bottom_total", F.sum(F.length("bottom")).over(Window.partitionBy("plan_id")))
    )


def junctions(components: DataFrame) -> DataFrame:
    """Every junction of every plan: a right end against the next left end."""
    linked = _linked(components).withColumn("closure", F.col("place") == F.col("count"))
    reason = end_reason("right.polarity", "right.overhang", "next_left.polarity", "next_left.overhang")
    return linked.where("not closure or topology = 'circular'").select(
        "plan_id", F.col("place").alias("after_component"),
        F.when(F.col("closure"), F.lit(1)).otherwise(F.col("place") + 1).alias("before_component"),
        "closure",
        F.when(F.col("closure"), F.lit(0)).otherwise(F.col("top_start") + F.length("top")).alias("top_boundary"),
        (F.col("bottom_total") - F.col("bottom_before")).alias("bottom_boundary"),
        reason.alias("reason"), fits(reason).alias("compatible"),
    )


def placements(components: DataFrame) -> DataFrame:
    """Where each component lies on both product strands."""
    back = F.col("orientation") == "reverse"
    return _linked(components).select(
        "plan_id", F.col("place").alias("component"), "input", "fragment_id", "orientation",
        F.col("top_start"), F.length("top").cast("bigint").alias("top_length"),
        F.when(back, F.lit("reverse")).otherwise(F.lit("forward")).alias("top_strand"),
        (F.col("bottom_total") - F.col("bottom_before")).alias("bottom_start"),
        F.length("bottom").cast("bigint").alias("bottom_length"),
        F.when(back, F.lit("forward")).otherwise(F.lit("reverse")).alias("bottom_strand"),
    )


def _stagger(end):
    n = F.length(end["overhang"])
    return F.when(end["polarity"] == "five_prime", n).when(end["polarity"] == "three_prime", -n).otherwise(F.lit(0))


def ligation_outcomes(plan: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row per plan: the product, or the ``reason`` it was refused for."""
    components = oriented_components(plan, fragments)
    linked = _linked(components)
    fit = end_reason("right.polarity", "right.overhang", "next_left.polarity", "next_left.overhang")
    open_end = (F.col("place") == F.col("count")) & (F.col("topology") == "linear")
    misfit = F.when(~open_end & ~fits(fit), F.struct("place", fit.alias("why")))
    grouped = linked.groupBy("plan_id").agg(
        F.max("topology").alias("topology"),
        F.min(F.when(~F.col("exists"), F.lit("no such fragment in the digest"))
              .when(F.col("left").isNull(), F.lit("an uncut circle has no ends to join"))).alias("unusable"),
        F.min(misfit).alias("misfit"),
        F.sum(F.length("top")).alias("top_bases"), F.sum(F.length("bottom")).alias("bottom_bases"),
        F.array_sort(F.collect_list(F.struct("place", "top", "bottom", "left", "right"))).alias("c"),
    )
    top = F.array_join(F.transform("c", lambda x: x["top"]), "")
    bottom = F.array_join(F.reverse(F.transform("c", lambda x: x["bottom"])), "")
    product = grouped.select(
        "plan_id", "topology", "unusable", "misfit", "top_bases", "bottom_bases",
        top.alias("top_sequence"), bottom.alias("bottom_sequence"),
        F.element_at("c", 1)["left"].alias("left_end"), F.element_at("c", -1)["right"].alias("right_end"),
        F.size("c").alias("components"),
    )
    delta, last = _stagger(F.col("left_end")), _stagger(F.col("right_end"))
    circular = F.col("topology") == "circular"
    forward = F.reverse(F.translate("bottom_sequence", "ACGT", "TGCA"))
    n = F.length("top_sequence")
    phase = F.pmod(delta, n)
    turned = F.concat(F.expr("substring(top_sequence, _phase + 1)"), F.expr("substring(top_sequence, 1, _phase)"))
    lo = F.greatest(delta, F.lit(0))
    hi = F.least(delta + F.length("bottom_sequence"), n)
    core_top = F.substring("top_sequence", F.col("_lo") + 1, F.col("_hi") - F.col("_lo"))
    core_bottom = F.substring(F.col("_forward"), F.col("_lo") - F.col("_delta") + 1, F.col("_hi") - F.col("_lo"))
    checked = (
        product.withColumn("_delta", delta).withColumn("_phase", phase).withColumn("_forward", forward)
        .withColumn("_lo", lo).withColumn("_hi", hi)
    )
    conserved = F.when(circular, (F.col("top_bases") == F.col("bottom_bases")) & (F.col("_forward") == turned)).otherwise(
        (F.col("_delta") + F.length("bottom_sequence") - n == last) & (F.col("_lo") < F.col("_hi")) & (core_top == core_bottom)
    )
    reason = F.coalesce(
        F.col("unusable"),
        F.when(F.col("misfit").isNotNull(), F.concat(F.lit("junction after component "), F.col("misfit.place").cast("string"), F.lit(": "), F.col("misfit.why"))),
        F.when(~conserved, F.lit("strands are not conserved")),
    )
    return (
        checked.withColumn("reason", reason)
        .withColumn("bottom_forward_start", F.when(circular, F.col("_phase")).otherwise(F.col("_delta")))
        .withColumn("paired_length", F.when(circular, n).otherwise(F.col("_hi") - F.col("_lo")))
        .withColumn("left_end", F.when(~circular, F.col("left_end")))
        .withColumn("right_end", F.when(~circular, F.col("right_end")))
        .select("plan_id", "topology", "components", "top_sequence", "bottom_sequence", "bottom_forward_start",
                "paired_length", "left_end", "right_end", "reason")
    )


def ligate(plan: DataFrame, fragments: DataFrame) -> DataFrame:
    """Products of all valid plans."""
    valid = plan.join(large(plan_rejects(plan)), "plan_id", "left_anti")
    return ligation_outcomes(valid, fragments).where("reason is null").drop("reason")


def ligation_rejects(plan: DataFrame, fragments: DataFrame) -> DataFrame:
    shape = plan_rejects(plan)
    valid = plan.join(large(shape), "plan_id", "left_anti")
    return shape.unionByName(
        ligation_outcomes(valid, fragments).where("reason is not null").select("plan_id", "reason")
    )


def unused_fragments(plan: DataFrame, fragments: DataFrame) -> DataFrame:
    """Fragments of a plan's inputs that the plan leaves over."""
    inputs = plan.select("plan_id", "input", "record_id").distinct()
    used = plan.select("plan_id", "input", "fragment_id")
    return (
        inputs.join(large(fragments.select("record_id", "fragment_id")), "record_id")
        .join(large(used), ["plan_id", "input", "fragment_id"], "left_anti")
        .select("plan_id", "input", "fragment_id")
    )
