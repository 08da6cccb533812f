"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a queue in shuffled order. A document's virtual finish time is the number of words its
source has sent when it ends, divided by the source's target; a second pass over the source follows the first. All
queues are merged by a global range sort on that time and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import SLICES, global_rank, keep, row_key, running_total, table

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A document enters the mix at most so many times.
PASSES = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, passes: int = PASSES) -> DataFrame:
    """``(source, source_no, source_size, target)`` from rows of ``(source, size)``.

    Sources by code point, null last, take ``weights`` in turn and divide ``share`` times all words. A target ends at
    ``passes`` times the source's size; what is over goes to the others by weight, until none is above. Only two sums a
    round come to the driver, whatever the number of sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").isNull(), F.col("source")], "source_no")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = keep(
        ranked.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("most", (F.col("source_size") * passes).cast("double"))
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    budget, level, full = share * total, 0.0, -1
    while True:
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        now = sources.agg(
            F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("most"))).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if now.full == full or not now.open:
            break
        full, level = now.full, (budget - (now.used or 0.0)) / now.open
    return sources.select(
        "source", "source_no", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, passes: int = PASSES, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, text_key, size, source_size, target, copies, taken, position``.

    ``copies`` is how often the document enters the mix (0 to ``passes``), ``taken`` the words it brings and
    ``position`` the words of the mix before its first copy (null if it isn't taken). Whole documents only: a source
    ends less than one document from its target. The order hangs on hashes of id and text, so reruns agree.

    Null text or a text of white space has size 0 and is not taken; a null source is a source of its own; rows that
    repeat an id are documents of their own; an empty table gives no rows. Columns other than doc_id, source and text
    are not read.
    """
    sizes = keep(
        docs.select(
            "doc_id", "source", row_key(F.col("text")).alias("text_key"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        )
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("mark", F.xxhash64(F.lit(seed), "doc_id", "text_key"))
    )
    targets = keep(source_targets(sizes, weights, share, passes))
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("n")).first().n
    known = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # The queue of one source: a shuffled order, cut into slices of the mark so that a hot source is many tasks.
    queue = known.where("size > 0 AND target > 0").withColumn("part", F.shiftrightunsigned("mark", 52))
    order = ["mark", "doc_id", "uid"]
    sent = running_total(queue, "size", ["source_no"], "part", order, "before")
    times = sent.select(
        "uid", "size", "mark", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"), "before", "source_size", "target"
    ).withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"))
    # Fine slices where the cut lies (near 1), wider ones far beyond it.
    times = times.withColumn(
        "at",
        F.when(F.col("finish") < 4, F.floor(F.col("finish") * (SLICES // 4)))
        .otherwise(SLICES + F.floor(F.log2(F.col("finish") / 4) * 64)).cast("int"),
    )
    merged = running_total(times, "size", [], "at", ["finish", "mark", "uid", "pass"], "position")
    chosen = (
        # Targets are sums of doubles: a thousandth of a word bridges their rounding.
        merged.where(F.col("position") + F.col("size") <= F.lit(budget + 1e-3))
        .groupBy("uid")
        .agg(F.count("*").alias("copies"), F.min("position").alias("position"))
    )
    return known.join(chosen, "uid", "left").select(
        "doc_id", "source", "text_key", "size", "source_size", "target",
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"), "position",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    chosen = (
        mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.max("copies").alias("_copies"))
    )
    same = docs["doc_id"].eqNullSafe(chosen["_id"]) & (row_key(docs["text"]) == chosen["_key"])
    return docs.join(chosen, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


@query("op10_fair_mixing")
def run(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "position")
