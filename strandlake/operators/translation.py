"""Translation of features and ranges, reading frames and open reading frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.dims.genetic_code import code_maps, genetic_codes, split_codons, translate_codons
from strandlake.functions.dna import revcomp_iupac, revcomp_text
from strandlake.operators.joining import large
from strandlake.operators.sequences import coding_sequences
from strandlake.operators.spans import attach_bases, tile_records

FRAME_STEP = 8190  # a multiple of three


def qualifier(key: str) -> Column:
    """Last value of a repeatable qualifier, trimmed."""
    hits = F.filter("qualifiers", lambda q: q["key"] == key)
    return F.trim(F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.when(F.size(hits) > 0, F.lit(""))))


def _translated(coded: DataFrame) -> DataFrame:
    """Protein columns from ``coding, codon_start, table_id``; ``error`` stays where set."""
    maps = F.broadcast(code_maps(coded.sparkSession))
    body = F.expr("substring(coding, codon_start)")
    joined = coded.join(maps, "table_id", "left").withColumn(
        "error",
        F.coalesce(
            "error", F.when(F.col("table_name").isNull(), F.lit("unknown genetic code")),
            F.when(F.length(body) < 3, F.lit("coding sequence shorter than one codon")),
        ),
    )
    codons = F.when(F.col("error").isNull(), split_codons(body))
    out = joined.withColumn("codons", codons).withColumn(
        "amino", F.expr("transform(codons, c -> coalesce(try_element_at(codes, c), 'X'))")
    )
    first_m = (
        F.col("whole_feature") & (F.col("codon_start") == 1) & (F.element_at("amino", -1) == "*")
        & (F.element_at("amino", 1) != "M") & F.expr("array_contains(starts, codons[0])")
    )
    last = F.size("codons") - 1
    return (
        out.withColumn("initiator_as_methionine", F.when(F.col("codons").isNotNull(), first_m))
        .withColumn("protein", F.expr("if(initiator_as_methionine, concat('M', substring(array_join(amino, ''), 2)), array_join(amino, ''))"))
        .withColumn("internal_stops", F.expr("filter(transform(amino, (a, i) -> if(a = '*', i, -1)), i -> i >= 0)"))
        .withColumn("internal_stops", F.filter("internal_stops", lambda i: i < last))
        .withColumn("terminal_stop", F.element_at("amino", -1) == "*")
        .withColumn("trailing_bases", F.when(F.col("codons").isNotNull(), F.length(body) % 3))
        .withColumn("ambiguous_codons", F.size(F.filter("amino", lambda a: a == "X")))
        .withColumn("starts_with_atg", F.element_at("codons", 1) == "ATG")
        .drop("codes", "starts", "amino", "whole_feature")
    )


def translate_features(features: DataFrame, parts: DataFrame, records: DataFrame, table: int | None = None) -> DataFrame:
    """Translate features by their qualifiers ``codon_start`` and ``transl_table``.

    ``table`` overrides the qualifier. Rows that cannot be translated keep the reason in
    ``error``. A complete feature (offset 1, terminal stop) that opens with an alternative
    start of its table gets an initiator M.
    """
    start, code = qualifier("codon_start"), qualifier("transl_table")
    asked = F.lit(table).cast("int") if table is not None else F.coalesce(F.expr("try_cast(_code as int)"), F.lit(1))
    coded = (
        features.select("record_id", "feature_id", "qualifiers")
        .join(large(coding_sequences(parts, records)), ["record_id", "feature_id"])
        .withColumn("_start", start).withColumn("_code", code)
        .withColumn(
            "error",
            F.when(F.col("_start").isNotNull() & ~F.col("_start").isin("1", "2", "3"), F.lit("invalid codon_start"))
            .when(F.col("_code").isNotNull() & F.expr("try_cast(_code as int) is null"), F.lit("invalid transl_table"))
            .when(F.col("strand") == "unknown", F.lit("unknown strand")),
        )
        .withColumn("codon_start", F.coalesce(F.expr("try_cast(_start as int)"), F.lit(1)))
        .withColumn("table_id", asked)
        .withColumn("whole_feature", F.lit(True))
        .drop("_start", "_code")
    )
    return _translated(coded)


def translate_all_cds(features: DataFrame, parts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Translations of every coding feature, and the skipped ones with their reason."""
    coding = features.where("lower(kind) = 'cds'")
    done = translate_features(coding, parts.join(large(coding.select("record_id", "feature_id")), ["record_id", "feature_id"], "left_semi"), records)
    return done.where("error is null").drop("error"), done.where("error is not null").select("record_id", "feature_id", "error")


def codon_positions(translations: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per codon with the reference positions of its three bases in coding order."""
    order = F.transform(
        F.array_sort(F.collect_list(F.struct("part_index", F.expr("sequence(start, start + length - 1)").alias("p")))), lambda x: x["p"]
    )
    places = parts.groupBy("record_id", "feature_id").agg(F.flatten(order).alias("places"))
    joined = translations.join(large(places), ["record_id", "feature_id"]).withColumn(
        "places", F.expr("transform(if(strand = 'reverse', reverse(places), places), p -> pmod(p, n))")
    )
    return joined.select(
        "record_id", "feature_id", "places", "codon_start", F.posexplode("codons").alias("codon_index", "codon"), "protein"
    ).select(
        "record_id", "feature_id", "codon_index", "codon",
        F.expr("substring(protein, codon_index + 1, 1)").alias("amino_acid"),
        *[F.expr(f"places[codon_start - 1 + 3 * codon_index + {i}]").alias(f"position_{i + 1}") for i in range(3)],
    )


def translate_ranges(ranges: DataFrame, records: DataFrame) -> DataFrame:
    """Translate ``(record_id, range_id, start, end, strand, frame, table_id)``.

    On circles ``end < start`` runs through the origin. Bad requests keep an ``error``.
    """
    sized = ranges.join(large(records.select("record_id", F.length("sequence").cast("bigint").alias("n"), "topology")), "record_id")
    span = F.when(F.col("end") > F.col("start"), F.col("end") - F.col("start")).when(
        (F.col("topology") == "circular") & (F.col("end") < F.col("start")), F.col("n") - F.col("start") + F.col("end")
    )
    checked = sized.withColumn("length", span).withColumn(
        "error",
        F.when(~F.col("frame").between(0, 2), F.lit("invalid frame"))
        .when((F.col("start") < 0) | (F.col("start") >= F.col("n")) | (F.col("end") > F.col("n")) | (F.col("end") < 0) | F.col("length").isNull(), F.lit("invalid range")),
    )
    keep = ["record_id", "range_id", "start", "end", "strand", "frame", "table_id", "n"]
    good = attach_bases(checked.where("error is null").select(*keep, "length"), records, ["record_id", "range_id"])
    coded = good.select(
        *keep, F.when(F.col("strand") == "reverse", revcomp_iupac("bases")).otherwise(F.col("bases")).alias("coding"),
        (F.col("frame") + 1).alias("codon_start"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("whole_feature"),
    )
    bad = checked.where("error is not null").select(*keep, "error")
    return _translated(coded).unionByName(bad, allowMissingColumns=True)


def compare_imported(translations: DataFrame, imported: str = "imported") -> DataFrame:
    """Set the computed protein beside an imported one, ignoring one terminal stop of each."""
    clean = F.regexp_replace(F.regexp_replace(imported, r"[\s,]", ""), r"\*$", "")
    mine = F.regexp_replace("protein", r"\*$", "")
    differ = F.expr(
        "array_position(zip_with(split(_mine, ''), split(_theirs, ''), (a, b) -> a <=> b), false)"
    )
    return (
        translations.withColumn("_mine", mine).withColumn("_theirs", clean)
        .withColumn("imported_length", F.length("_theirs"))
        .withColumn("first_difference", F.when(F.col("_mine") != F.col("_theirs"), differ - 1))
        .withColumn("matches", F.col("_mine") == F.col("_theirs"))
        .drop("_mine", "_theirs")
    )


def translation_warnings(translations: DataFrame) -> DataFrame:
    """``(record_id, feature_id, code)`` for everything odd about a translation."""
    checks = [
        (F.size("internal_stops") > 0, "internal_stop_codons"),
        (F.col("trailing_bases") > 0, "incomplete_terminal_codon"),
        (F.col("ambiguous_codons") > 0, "ambiguous_codons"),
    ]
    if "matches" in translations.columns:
        checks.append((~F.col("matches"), "imported_translation_differs"))
    codes = F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in checks]), lambda x: x.isNotNull())
    return translations.select("record_id", "feature_id", F.explode(codes).alias("code"))


def six_frames(records: DataFrame, table: int = 1) -> DataFrame:
    """Proteins of frames +1..+3 and -1..-3; codons over the origin are left out.

    Tiles are translated apart and joined per frame.
    """
    straight = records.withColumn("topology", F.lit("linear"))
    phases = F.array(*[F.struct(F.lit(i).alias("phase")) for i in range(3)])
    cut = tile_records(straight, 2, FRAME_STEP).select(
        "record_id", "length", "tile", "bases", F.inline(phases)
    ).withColumn("whole", F.expr("substring(bases, phase + 1, (length(bases) - phase) div 3 * 3)"))
    forward = F.array_join(translate_codons(split_codons(F.col("whole")), table), "")
    backward = F.array_join(translate_codons(split_codons(revcomp_iupac("whole")), table), "")
    offset = F.pmod(F.col("length") - F.col("phase"), F.lit(3)).cast("int")
    both = F.array(
        F.struct(F.lit("forward").alias("strand"), F.col("phase").alias("offset"), F.col("tile").alias("rank"), forward.alias("protein")),
        F.struct(F.lit("reverse").alias("strand"), offset.alias("offset"), (-F.col("tile")).alias("rank"), backward.alias("protein")),
    )
    return (
        cut.select("record_id", "length", F.inline(both))
        .groupBy("record_id", "length", "strand", "offset")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "protein"))), lambda x: x["protein"]), "").alias("protein"))
        .withColumn("first", F.when(F.col("strand") == "forward", F.col("offset")).otherwise(F.greatest(F.col("length") - F.col("offset") - 1, F.lit(0))))
        .select("record_id", "strand", "offset", "first", "protein")
    )


def find_orfs(records: DataFrame, table: int = 1, min_codons: int = 30, starts: str = "atg_only", step: int = FRAME_STEP) -> DataFrame:
    """Complete open reading frames on both strands, the longest per stop codon.

    ``starts``: ``atg_only`` or ``table_starts``. Only start and stop codons become rows;
    circles are read over two turns, and an ORF never exceeds one.
    """
    if min_codons < 1:
        raise ValueError("min_codons must be at least 1")
    code = genetic_codes()[table]
    stops = sorted(c for c, a in code.amino_acids.items() if a == "*")
    opens = sorted({"ATG"} if starts == "atg_only" else code.starts)
    opens = [c for c in opens if c not in stops]

    def events(strand: str, turn) -> Column:
        # Overlapping windows of three, kept where they open or close a frame.
        wanted = {turn(c): kind for kind, cs in (("stop", stops), ("start", opens)) for c in cs}
        lookup = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
        windows = F.regexp_extract_all("bases", F.lit("(?=(...))"), F.lit(1))
        found = F.transform(windows, lambda w, i: F.struct(F.lit(strand).alias("strand"), i.alias("at"), F.try_element_at(lookup, w).alias("kind")))
        return F.filter(found, lambda e: e["kind"].isNotNull())

    n, circular = F.col("length"), F.col("topology") == "circular"
    raw = (
        tile_records(records, 2, step)
        .select("record_id", "length", "topology", "tile_start",
                F.inline(F.concat(events("forward", lambda c: c), events("reverse", revcomp_text))))
        .where(F.col("at") < step)
        .withColumn("place", F.col("tile_start") + F.col("at"))
        .where("place < length")
    )
    own = F.when(F.col("strand") == "forward", F.col("place")).otherwise(F.pmod(n - 3 - F.col("place"), n))
    turns = F.when(circular, F.array(own, own + n)).otherwise(F.array(own))
    coded = (
        raw.select("record_id", "length", "topology", "strand", "kind", F.explode(turns).alias("at"))
        .where(F.col("at") + 3 <= F.when(circular, 2 * n).otherwise(n))
        .withColumn("phase", F.col("at") % 3)
    )
    before = Window.partitionBy("record_id", "strand", "phase").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stretches = (
        coded.withColumn("stretch", F.coalesce(F.sum((F.col("kind") == "stop").cast("int")).over(before), F.lit(0)))
        .groupBy("record_id", "strand", "phase", "stretch")
        .agg(F.max("length").alias("n"), F.min(F.when(F.col("kind") == "start", F.col("at"))).alias("begin"),
             F.max(F.when(F.col("kind") == "stop", F.col("at"))).alias("stop"))
        .withColumn("length", F.col("stop") + 3 - F.col("begin"))
        .where((F.col("begin") < F.col("n")) & (F.col("length") <= F.col("n")) & (F.col("length") / 3 - 1 >= min_codons))
    )
    best = stretches.groupBy("record_id", "strand", F.pmod("stop", "n").alias("stop_key")).agg(
        F.max("n").alias("n"), F.max("length").alias("length"), F.max_by("begin", F.struct("length", -F.col("begin"))).alias("begin")
    )
    start = F.when(F.col("strand") == "forward", F.pmod("begin", "n")).otherwise(F.col("n") - 1 - F.pmod(F.col("begin") + F.col("length") - 1, F.col("n")))
    placed = best.withColumn("start", start).drop("begin", "stop_key")
    bases = attach_bases(placed, records, ["record_id", "strand", "start", "length"])
    coding = F.when(F.col("strand") == "forward", F.col("bases")).otherwise(revcomp_iupac("bases"))
    order = Window.partitionBy("record_id").orderBy("start", F.col("strand") == "reverse", "length")
    amino = translate_codons(split_codons(F.expr("substring(coding, 1, length(coding) - 3)")), table)
    return (
        bases.withColumn("coding", coding)
        .select(
            "record_id", F.format_string("orf-%04d", F.row_number().over(order)).alias("orf_id"), "strand", "start", "length",
            F.when(F.col("strand") == "forward", F.col("start") % 3)
            .otherwise((F.col("n") - 1 - F.pmod(F.col("start") + F.col("length") - 1, F.col("n"))) % 3).alias("frame"),
            (F.col("length") / 3 - 1).cast("bigint").alias("codons"),
            F.array_join(amino, "").alias("protein"),
            F.substring("coding", 1, 3).alias("start_codon"), F.expr("right(coding, 3)").alias("stop_codon"),
            (F.col("start") + F.col("length") > F.col("n")).alias("wraps_origin"),
        )
    )
