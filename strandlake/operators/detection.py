"""Exact occurrences of library parts on a collection of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import kmers, span_within
from strandlake.operators.joining import large
from strandlake.operators.sketch import Sketch
from strandlake.operators.spans import TILE, attach_bases, tile_records
from strandlake.session import cut_lineage

MIN_LENGTH = 12


def _seed(s: Column, k: int, every: int = 1) -> Column:
    """The most varied k-mer of a sequence and its offset: ``struct(variety, back, seed)``, of those at each ``every``-th place.

    Runs of one base or of one pair make poor seeds, being everywhere at once.
    """
    windows = F.transform(
        F.filter(F.transform(kmers(s, k), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["i"] % every == 0),
        lambda x: F.struct(
            F.size(F.array_distinct(kmers(x["w"], 3))).alias("variety"), (-x["i"]).alias("back"), x["w"].alias("seed")
        ),
    )
    return F.array_max(windows)


def detect_features(records: DataFrame, library: DataFrame, min_length: int = MIN_LENGTH, step: int = TILE) -> DataFrame:
    """Every exact occurrence of every visible library entry, on both strands and through
    the origin of circles; palindromes once, forward.

    One seed per entry and strand is enough: windows of a tile that a Bloom filter of all seeds
    lets pass meet the seeds in an equi-join, and the few candidates are compared with the bases
    of their span. Entries have the longest seed of a few sizes that they hold: chance windows with a seed grow with
    bases x entries / 4^size, and long seeds keep them below the hits.
    Rows follow the hits, not the bases. ``strand`` is unknown for entries without a direction.
    """
    sizes = [min_length, min_length + 4, 2 * min_length]
    entries = library.where((F.length("sequence") >= min_length) & (F.col("status") != "hidden")).select(
        "library_id", "name", "kind", "family_id", "stranded", F.length("sequence").cast("bigint").alias("length"),
        F.col("sequence").alias("entry"),
    )
    turned = F.reverse(F.translate("entry", "ACGT", "TGCA"))
    both = F.when(turned == F.col("entry"), F.array(F.struct(F.lit("forward").alias("hit"), F.col("entry").alias("text")))).otherwise(
        F.array(F.struct(F.lit("forward").alias("hit"), F.col("entry").alias("text")), F.struct(F.lit("reverse").alias("hit"), turned.alias("text")))
    )
    size, seed = F.lit(sizes[0]), _seed(F.col("text"), sizes[0])
    for k in sizes[1:]:
        size, seed = F.when(F.col("length") >= k, F.lit(k)).otherwise(size), F.when(F.col("length") >= k, _seed(F.col("text"), k, k // 4)).otherwise(seed)
    seeds = entries.select("*", F.inline(both)).drop("entry").withColumn("size", size).withColumn("s", seed).select(
        "*", F.xxhash64("size", "s.seed").alias("key"), (-F.col("s.back")).cast("bigint").alias("offset")
    ).drop("s")
    # Kept once: the filter and the join read them. Only windows that may hold a seed leave their tile.
    seeds = cut_lineage(seeds)
    sketch = Sketch(seeds, "key")
    there = sorted(r.size for r in seeds.select("size").distinct().collect()) or sizes[:1]
    # Windows hold the longest seed; behind the end of linear molecules stands what no seed holds.
    pad = there[-1] - there[0]
    padded = records.select("record_id", "topology", F.when(F.col("topology") == "circular", F.col("sequence")).otherwise(F.concat("sequence", F.lit("-" * pad))).alias("sequence"))
    ring = F.col("topology") == "circular"
    places = (
        tile_records(padded, there[-1] - 1, step)
        .select("record_id", ring.alias("ring"), "length", "tile_start", F.posexplode(kmers("bases", there[-1])).alias("at", "window"))
        .where((F.col("at") < step) & (F.col("tile_start") + F.col("at") < F.col("length")))
        .select("*", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("window", 1, k)) for k in there])).alias("key"))
        .where(sketch.holds(F.col("key")))
        .select("record_id", "ring", (F.col("length") - F.when(F.col("ring"), 0).otherwise(pad)).alias("n"), (F.col("tile_start") + F.col("at")).alias("place"), "key")
    )
    start = F.col("place") - F.col("offset")
    hits = (
        places.join(large(seeds), "key")
        .withColumn("start", F.when(F.col("ring"), F.pmod(start, F.col("n"))).otherwise(start))
        .where("length <= n and start >= 0 and (ring or start + length <= n)")
        .drop("key", "size", "place", "offset", "ring")
    )
    checked = attach_bases(hits, records, ["record_id", "library_id", "hit", "start"], step=step).where("bases = text")
    return checked.select(
        "record_id", "n", "library_id", "name", "kind", "family_id", "start", "length",
        F.when(F.col("stranded"), F.col("hit")).otherwise(F.lit("unknown")).alias("strand"), "hit",
    )


def rank_matches(matches: DataFrame) -> DataFrame:
    """Number the matches of a record by start, longer first, name and id."""
    order = Window.partitionBy("record_id").orderBy("start", F.desc("length"), "name", "library_id", "hit")
    return matches.withColumn("match_index", F.row_number().over(order) - 1)


def annotated_as(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """Add the existing features with the same span and a strand that does not disagree.

    ``spans`` comes from ``sequences.contiguous_spans``.
    """
    there = spans.groupBy("record_id", "start", "length").agg(F.collect_list(F.struct("feature_id", "strand")).alias("_there"))
    # One pass over the matches: features of a span come as a list, read in the match's own row.
    agree = F.filter("_there", lambda x: (x["strand"] == "unknown") | (F.col("strand") == "unknown") | (x["strand"] == F.col("strand")))
    listed = F.array_sort(F.transform(agree, lambda x: x["feature_id"]))
    return matches.join(large(there), ["record_id", "start", "length"], "left").select(
        *matches.columns, F.coalesce(listed, F.array().cast("array<string>")).alias("annotated_as"))


def _containers(matches: DataFrame, same_family: bool, bin_width: int) -> DataFrame:
    """Pairs (inner, outer) of strictly longer matches around each match.

    An outer match is filed under every bin it reaches and an inner one under the bin of
    its start, so only neighbours on the molecule meet.
    """
    keys = ["record_id", "family_id"] if same_family else ["record_id"]
    outer = matches.select(
        *keys, F.col("match_index").alias("o_index"), F.col("start").alias("o_start"), F.col("length").alias("o_length"), F.col("n").alias("o_n"),
        F.explode(F.expr(f"array_distinct(transform(sequence(start div {bin_width}, (start + length - 1) div {bin_width}), "
                         f"b -> pmod(b * {bin_width}, n) div {bin_width}))")).alias("_bin"),
    )
    # A span through the origin also reaches bin 0 and what follows it.
    wrapped = matches.where("start + length > n").select(
        *keys, F.col("match_index").alias("o_index"), F.col("start").alias("o_start"), F.col("length").alias("o_length"), F.col("n").alias("o_n"),
        F.explode(F.expr(f"sequence(0L, (start + length - n - 1) div {bin_width})")).alias("_bin"),
    )
    around = outer.union(wrapped).distinct()
    inner = matches.withColumn("_bin", F.expr(f"start div {bin_width}"))
    return inner.join(large(around), [*keys, "_bin"]).where(
        (F.col("o_length") > F.col("length")) & span_within("start", "length", "o_start", "o_length", "n")
    )


def superseded_by(matches: DataFrame, bin_width: int = 4096) -> DataFrame:
    """Add the index of the longest match of the same family that contains each match.

    The matches, far fewer than the bases they came from, are kept once for the self-join.
    """
    matches = cut_lineage(matches)
    found = _containers(matches, True, bin_width).groupBy("record_id", "match_index").agg(
        F.max_by("o_index", F.struct("o_length", -F.col("o_index"))).alias("superseded_by")
    )
    return matches.join(large(found), ["record_id", "match_index"], "left")


def new_only(matches: DataFrame) -> DataFrame:
    """Matches that no existing feature describes, renumbered with their references."""
    order = Window.partitionBy("record_id").orderBy("match_index")
    kept = matches.where("size(annotated_as) = 0").withColumn("_new", F.row_number().over(order) - 1)
    targets = kept.select("record_id", F.col("match_index").alias("superseded_by"), F.col("_new").alias("_target"))
    return (
        kept.join(large(targets), ["record_id", "superseded_by"], "left")
        .withColumn("match_index", F.col("_new")).withColumn("superseded_by", F.col("_target"))
        .drop("_new", "_target")
    )


def fold_proposals(matches: DataFrame, bin_width: int = 4096) -> DataFrame:
    """One proposal per place and family: unsuperseded matches, the number of variants folded
    into each, and the first longer proposal around it."""
    folded = matches.where("superseded_by is not null").groupBy("record_id", F.col("superseded_by").alias("match_index")).agg(
        F.count("*").alias("variants")
    )
    kept = matches.where("superseded_by is null")
    around = _containers(kept, False, bin_width).groupBy("record_id", "match_index").agg(F.min("o_index").alias("contained_in"))
    return (
        kept.join(large(folded), ["record_id", "match_index"], "left").join(large(around), ["record_id", "match_index"], "left")
        .withColumn("variants", F.coalesce("variants", F.lit(0)))
    )
