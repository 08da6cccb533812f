"""Restriction sites, enzyme sets and complete digests over a table of records.

``records`` holds ``record_id, name, sequence, length, topology`` with one row per
molecule. All work is per tile until the cuts, which are small, meet on ``record_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.dims.enzymes import Enzyme, builtin, select_enzymes
from strandlake.functions.dna import IUPAC_BASES, first_non_acgt, iupac_regex, revcomp_text
from strandlake.operators.spans import TILE, attach_bases, motif_offsets, tile_records

# The names of the "common" enzyme set.
COMMON = """
AgeI ApaI AscI AvrII BamHI BglII BsrGI ClaI EcoRI EcoRV HindIII HpaI KpnI MfeI MluI
NcoI NdeI NheI NotI NsiI PacI PstI SacI SacII SalI SmaI SpeI SphI StuI XbaI XhoI XmaI
"""


SEED = 6


MOTIF_SCHEMA = (
    "beginning string, regex string, enzyme string, strand string, site_length bigint, top bigint, "
    "bottom bigint, overhang_polarity string, overhang_length bigint"
)


def _beginnings(enzymes: list[Enzyme]) -> list[tuple]:
    """Leading letters of every motif, with ambiguity codes.

    Motifs shorter than a seed are listed at their own length (for windows at the end of a
    linear molecule) and with any letters up to the seed length. ``regex`` checks
    what lies behind the seed of a longer motif.
    """
    rows = []
    for e in enzymes:
        site = e.recognition_sequence
        m, t, b = len(site), e.top_cut_offset, e.bottom_cut_offset
        rows.append((e.name, site, "forward", m, t, b, e.polarity, abs(b - t)))
        other = revcomp_text(site)
        if other != site:
            rows.append((e.name, other, "reverse", m, m - b, m - t, e.polarity, abs(b - t)))
    seeds = []
    for name, site, *rest in rows:
        regex = iupac_regex(site) if len(site) > SEED else None
        seeds += [(site[:size].ljust(size, "N"), regex, name, *rest) for size in range(min(len(site), SEED), SEED + 1)]
    return seeds


def _seed_table(spark, beginnings: list[tuple]) -> DataFrame:
    """Every concrete spelling of each beginning, one base further at a time."""
    table = spark.createDataFrame(beginnings, MOTIF_SCHEMA).withColumn("seed", F.lit(""))
    bases = F.create_map(*[F.lit(x) for code, letters in IUPAC_BASES.items() for x in (code, letters)])
    for i in range(1, SEED + 1):
        letter = F.element_at(bases, F.substring("beginning", i, 1))
        more = F.when(F.length("beginning") >= i, F.filter(F.split(letter, ""), lambda c: c != "")).otherwise(F.array(F.lit("")))
        table = table.withColumn("_next", F.explode(more)).withColumn("seed", F.concat("seed", "_next")).drop("_next")
    return table.drop("beginning")


def _any_of(words: list[str]) -> str:
    """One regular expression for a set of words of ambiguity codes that shares their common beginnings."""
    if "" in words:
        return ""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    letters: dict[str, str] = {}
    for letter, rest in sorted(tails.items()):
        tail = _any_of(rest)
        letters[tail] = "".join(sorted(set(letters.get(tail, "") + "".join(IUPAC_BASES[letter]))))
    branches = [(f"[{ls}]" if len(ls) > 1 else ls) + tail for tail, ls in letters.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def scan_rejects(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None) -> DataFrame:
    """Records that cannot be scanned, with the reason: ``(record_id, reason)``."""
    enzymes = select_enzymes(names, catalogue)
    bad = first_non_acgt("sequence")
    span = max(e.span for e in enzymes)
    short = (F.col("topology") == "circular") & (F.length("sequence") < span)
    return records.select(
        "record_id",
        F.when(
            bad.isNotNull(),
            F.concat(
                F.lit("ambiguous base "), F.substring("sequence", bad + 1, F.lit(1)),
                F.lit(" at position "), bad.cast("string"),
            ),
        ).when(short, F.lit(f"circle shorter than the recognition and cleavage span {span}")).alias("reason"),
    ).where("reason is not null")


def _scannable(records: DataFrame, enzymes: list[Enzyme], skip_short_circles: bool = False) -> DataFrame:
    whole = records.where(~F.col("sequence").rlike("[^ACGT]"))
    if skip_short_circles:
        return whole
    span = max(e.span for e in enzymes)
    return whole.where((F.col("topology") != "circular") | (F.length("sequence") >= span))


def find_sites(
    records: DataFrame,
    names: list[str],
    catalogue: list[Enzyme] | None = None,
    step: int = TILE,
    spread: int = 0,
    skip_short_circles: bool = False,
) -> DataFrame:
    """All recognition sites on both strands, palindromes once as forward.

    One row per site: ``record_id, enzyme, strand, site_start, site_length, top_cut,
    bottom_cut, cleavage_available, overhang_polarity, overhang_length`` plus the
    molecule's ``length`` and ``topology``. A cut outside a linear molecule is null.
    Records listed by ``scan_rejects`` give no rows; with ``skip_short_circles`` only the
    enzymes too long for a small circle are left out.

    One regular-expression pass marks where any motif may begin; only those windows become
    rows and meet the concrete spellings of all motifs, a bounded table that is broadcast,
    so the cost per base hardly grows with the catalogue.
    """
    enzymes = select_enzymes(names, catalogue)
    whole = _scannable(records, enzymes, skip_short_circles)
    width = max(SEED, max(len(e.recognition_sequence) for e in enzymes))
    beginnings = _beginnings(enzymes)
    anywhere = _any_of(sorted({letters for letters, *_ in beginnings}))
    seed_table = _seed_table(records.sparkSession, beginnings)
    # Binary slices copy bytes in place; string slices would walk the tile for every hit.
    opened = tile_records(whole, width - 1, step, spread).select(
        "record_id", "topology", "length", "tile_start", motif_offsets(F.col("bases"), anywhere).alias("hits"),
        F.col("bases").cast("binary").alias("bytes"),
    )
    windows = F.expr(f"inline(transform(hits, h -> struct(h as at, cast(substring(bytes, h + 1, {width}) as string) as window)))")
    hits = (
        opened.select("record_id", "topology", "length", "tile_start", windows)
        .withColumn("site_start", F.col("tile_start") + F.col("at"))
        .where((F.col("at") < step) & (F.col("site_start") < F.col("length")))
        .join(F.broadcast(seed_table), F.substring("window", 1, SEED) == F.col("seed"))
        .where("regex is null or window rlike concat('^', regex)")
    )
    if skip_short_circles:
        spans = F.create_map(*[F.lit(x) for e in enzymes for x in (e.name, e.span)])
        hits = hits.where(
            (F.col("topology") != "circular") | (F.col("length") >= F.element_at(spans, F.col("enzyme")))
        )
    n, start, circular = F.col("length"), F.col("site_start"), F.col("topology") == "circular"

    def boundary(offset):
        at = start + F.col(offset)
        return F.when(circular, F.pmod(at, n)).when((at >= 0) & (at <= n), at)

    return hits.select(
        "record_id", "enzyme", "strand", "site_start", "site_length",
        boundary("top").alias("top_cut"),
        boundary("bottom").alias("bottom_cut"),
        (boundary("top").isNotNull() & boundary("bottom").isNotNull()).alias("cleavage_available"),
        "overhang_polarity", "overhang_length", "length", "topology",
    )


def enzyme_counts(records: DataFrame, names: list[str] | None = None, catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Per record and enzyme: sites and sites whose cleavage falls on the molecule.

    Enzymes without a site count zero, as do enzymes too long for a small circle.
    """
    names = names or [e.name for e in catalogue or builtin()]
    chosen = select_enzymes(names, catalogue)
    sites = find_sites(records, names, catalogue, skip_short_circles=True, **scan)
    # Zero rows come from the record itself, so one grouping serves found and absent enzymes.
    absent = records.where(~F.col("sequence").rlike("[^ACGT]")).select(
        "record_id", F.explode(F.array(*[F.lit(e.name) for e in chosen])).alias("enzyme"),
        F.lit(0).alias("site"), F.lit(0).alias("available"),
    )
    found = sites.select("record_id", "enzyme", F.lit(1).alias("site"), F.col("cleavage_available").cast("int").alias("available"))
    return (
        found.unionByName(absent)
        .groupBy("record_id", "enzyme")
        .agg(F.sum("site").alias("sites"), F.sum("available").alias("available_cuts"))
    )


def enzymes_in_set(counts: DataFrame, enzymes: DataFrame, which: str, custom: list[str] | None = None) -> DataFrame:
    """Enzymes of a named set per record: ``unique6``, ``unique_dual6``, ``unique_any``,
    ``common`` or ``custom``. ``enzymes`` is ``dims.enzymes.enzymes_table``."""
    joined = counts.join(
        F.broadcast(enzymes.select(F.col("name").alias("enzyme"), "specificity")), "enzyme"
    )
    rules = {
        "unique6": (F.col("sites") == 1) & (F.col("specificity") >= 6),
        "unique_dual6": F.col("sites").between(1, 2) & (F.col("specificity") >= 6),
        "unique_any": F.col("sites") == 1,
        "common": (F.col("sites") > 0) & F.col("enzyme").isin(COMMON.split()),
        "custom": (F.col("sites") > 0) & F.col("enzyme").isin(custom or []),
    }
    return joined.where(rules[which]).select("record_id", "enzyme", "sites", "available_cuts", "specificity")


def _grouped_cuts(sites: DataFrame) -> DataFrame:
    stagger = (
        F.when(F.col("overhang_polarity") == "five_prime", F.col("overhang_length"))
        .when(F.col("overhang_polarity") == "three_prime", -F.col("overhang_length"))
        .otherwise(F.lit(0))
    )
    top = F.when(F.col("cleavage_available"), F.col("top_cut")).otherwise(F.lit(-1))
    return (
        sites.select("record_id", "length", "topology", top.alias("top"), (top + stagger).alias("bottom"), "enzyme", "problem")
        .groupBy("record_id", "length", "topology", "top", "bottom")
        .agg(F.array_sort(F.collect_set("enzyme")).alias("enzymes"), F.max("problem").alias("problem"))
    )


def merge_cuts(sites: DataFrame) -> DataFrame:
    """Physical cuts: equal (top, bottom) pairs once, with their enzymes.

    ``bottom`` keeps the signed stagger from ``top`` and so may leave ``[0, n)`` on a circle.
    """
    available = sites.where("cleavage_available").withColumn("problem", F.lit(None).cast("string"))
    return _grouped_cuts(available).drop("problem")


def digest_intervals(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Fragment coordinates of a complete digest, one row per fragment plus a ``reason``
    on every row of a record whose digest is refused.

    Boundaries of both ends are unwrapped: the right one of the fragment that closes a
    circle lies beyond ``n``.
    """
    sites = find_sites(records, names, catalogue, **scan)
    scannable = _scannable(records, select_enzymes(names, catalogue))
    n = F.length("sequence").cast("bigint")
    none = F.array().cast("array<string>")

    def edge(at, kind):
        return F.struct(at.alias("top"), at.alias("bottom"), none.alias("enzymes"), F.lit(kind).alias("kind"))

    zero = F.lit(0).cast("bigint")
    edges = scannable.select(
        "record_id", n.alias("length"), "topology",
        F.explode(
            F.when(F.col("topology") == "linear", F.array(edge(zero, "edge"), edge(n, "edge")))
            .otherwise(F.array(edge(zero, "circle")))
        ).alias("e"),
    ).select("record_id", "length", "topology", "e.*", F.lit(None).cast("string").alias("problem"))
    problem = (
        F.when(~F.col("cleavage_available"), F.lit("cut outside the molecule"))
        .when(
            (F.col("topology") == "linear")
            & (F.col("top_cut").isin(0) | F.col("bottom_cut").isin(0)
               | (F.col("top_cut") == F.col("length")) | (F.col("bottom_cut") == F.col("length"))),
            F.lit("cut at a terminus"),
        )
    )
    # A site that voids its record travels with the cuts instead of a second scan and join.
    cuts = _grouped_cuts(sites.withColumn("problem", problem)).select(
        "record_id", "length", "topology", "top", "bottom", "enzymes", F.lit("cut").alias("kind"), "problem"
    )
    whole = Window.partitionBy("record_id")
    ordered = whole.orderBy("top", "bottom", F.when(F.col("kind") == "edge", F.col("top")).otherwise(F.lit(1)))
    here = F.struct("top", "bottom", "enzymes")
    rows = (
        cuts.unionByName(edges)
        .withColumn("n_cuts", F.count(F.when(F.col("kind") == "cut", 1)).over(whole))
        .withColumn("problem", F.max("problem").over(whole))
        .where("kind != 'circle' or n_cuts = 0")
        .withColumn("left", here)
        .withColumn("next", F.lead(here).over(ordered))
        .withColumn("head", F.first(here).over(ordered))
        .withColumn("fragment_ord", F.row_number().over(ordered))
    )
    n = F.col("length")
    closing = F.struct(
        (F.col("head.top") + n).alias("top"), (F.col("head.bottom") + n).alias("bottom"),
        F.col("head.enzymes").alias("enzymes"),
    )
    rows = rows.withColumn(
        "right", F.coalesce("next", F.when(F.col("topology") == "circular", closing))
    ).where("right is not null")
    paired = F.least("right.top", "right.bottom") - F.greatest("left.top", "left.bottom")
    rows = rows.withColumn("paired_length", paired)
    overlap = F.max(F.col("paired_length") <= 0).over(whole)
    return rows.withColumn(
        "reason",
        F.coalesce("problem", F.when(overlap, F.lit("overlapping or touching cuts"))),
    ).select(
        "record_id", F.col("length").alias("n"),
        F.when(F.col("kind") == "circle", F.lit("circular")).otherwise(F.lit("linear")).alias("topology"),
        F.col("topology").alias("source_topology"),
        "fragment_ord", F.format_string("fragment-%04d", "fragment_ord").alias("fragment_id"),
        "left", "right", "paired_length", "reason",
    )


def digest_rejects(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Records without a digest and why; a refused record never gives partial results."""
    failed = digest_intervals(records, names, catalogue, **scan).where("reason is not null")
    return scan_rejects(records, names, catalogue).unionByName(
        failed.groupBy("record_id").agg(F.min("reason").alias("reason"))
    )


def digest_spans(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Fragments with the place of both strands and no bases: ``top`` and ``bottom`` are ``struct(start, length)``."""
    parts = digest_intervals(records, names, catalogue, **scan).where("reason is null")

    def strand(side):
        a, b = F.col(f"left.{side}"), F.col(f"right.{side}")
        return F.struct(F.pmod(a, F.col("n")).alias("start"), (b - a).alias("length")).alias(side)

    return parts.select(
        "record_id", "n", "source_topology", "fragment_ord", "fragment_id", "topology", strand("top"), strand("bottom"), "paired_length"
    )


def digest_ends(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Fragments with both ends as ``digest`` gives them; only the bases of overhangs are fetched."""
    parts = digest_intervals(records, names, catalogue, **scan).where("reason is null and topology = 'linear'")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("at")) for s in ("left", "right")])).alias("s")
    cuts = parts.select("record_id", "n", "fragment_ord", "fragment_id", sides).select(
        "record_id", "n", "fragment_ord", "fragment_id", "s.side", "s.at.top", "s.at.bottom", "s.at.enzymes",
        F.least("s.at.top", "s.at.bottom").alias("lo"), F.abs(F.col("s.at.top") - F.col("s.at.bottom")).alias("size"),
    )
    keys = ["record_id", "fragment_ord", "side"]
    cohesive = attach_bases(cuts.where("size > 0"), records, keys, "lo", "size", "n", "bases")
    ends = cohesive.unionByName(cuts.where("size = 0").withColumn("bases", F.lit("")))
    protruding = F.when(F.col("size") > 0, F.when((F.col("bottom") > F.col("top")) == (F.col("side") == "left"), F.lit("forward")).otherwise(F.lit("reverse")))
    end = F.struct(
        (F.size("enzymes") == 0).alias("original_terminus"),
        F.when(F.col("size") == 0, F.lit("blunt")).when(F.col("bottom") > F.col("top"), F.lit("five_prime")).otherwise(F.lit("three_prime")).alias("polarity"),
        protruding.alias("protruding_strand"),
        F.when(protruding == "reverse", F.reverse(F.translate("bases", "ACGT", "TGCA"))).otherwise(F.col("bases")).alias("overhang"),
        "enzymes",
    )
    return (
        ends.withColumn("end", end).groupBy("record_id", "fragment_ord", "fragment_id")
        .agg(*[F.first(F.when(F.col("side") == s, F.col("end")), ignorenulls=True).alias(f"{s}_end") for s in ("left", "right")])
    )


def digest(records: DataFrame, names: list[str], catalogue: list[Enzyme] | None = None, **scan) -> DataFrame:
    """Fragments with both strands and both ends.

    ``top`` and ``bottom`` are ``struct(start, length, sequence)`` with the sequence
    5'->3'; ``left_end`` and ``right_end`` are ``struct(original_terminus, polarity,
    protruding_strand, overhang, enzymes)``, null for an uncut circle.
    """
    parts = digest_intervals(records, names, catalogue, **scan).where("reason is null").drop("reason")
    spans = parts.withColumn("_lo", F.least("left.top", "left.bottom")).withColumn(
        "_size", F.greatest("right.top", "right.bottom") - F.col("_lo")
    )
    spans = attach_bases(spans, records, ["record_id", "fragment_ord"], "_lo", "_size", "n", "_bases")

    def bases(a, b):
        return F.substring("_bases", (a - F.col("_lo") + 1).cast("int"), (b - a).cast("int"))

    def flip(s):
        return F.reverse(F.translate(s, "ACGT", "TGCA"))

    def strand(side):
        a, b = F.col(f"left.{side}"), F.col(f"right.{side}")
        text = bases(a, b)
        return F.struct(
            F.pmod(a, F.col("n")).alias("start"), (b - a).alias("length"),
            (flip(text) if side == "bottom" else text).alias("sequence"),
        )

    def end(side):
        top, bottom = F.col(f"{side}.top"), F.col(f"{side}.bottom")
        protruding = F.when(top == bottom, F.lit(None)).otherwise(
            F.when((bottom > top) == F.lit(side == "left"), F.lit("forward")).otherwise(F.lit("reverse"))
        )
        text = bases(F.least(top, bottom), F.greatest(top, bottom))
        return F.when(
            F.col("topology") == "linear",
            F.struct(
                (F.size(f"{side}.enzymes") == 0).alias("original_terminus"),
                F.when(bottom == top, F.lit("blunt")).when(bottom > top, F.lit("five_prime"))
                .otherwise(F.lit("three_prime")).alias("polarity"),
                protruding.alias("protruding_strand"),
                F.when(protruding == "reverse", flip(text)).otherwise(text).alias("overhang"),
                F.col(f"{side}.enzymes").alias("enzymes"),
            ),
        )

    return spans.select(
        "record_id", "n", "source_topology", "fragment_ord", "fragment_id", "topology",
        strand("top").alias("top"), strand("bottom").alias("bottom"), "paired_length",
        end("left").alias("left_end"), end("right").alias("right_end"),
    )


def digest_conservation(fragments: DataFrame) -> DataFrame:
    """Audit: the fragment lengths of each strand add up to the molecule."""
    return fragments.groupBy("record_id").agg(
        F.max("n").alias("length"), F.count("*").alias("fragments"),
        F.sum("top.length").alias("top_bases"), F.sum("bottom.length").alias("bottom_bases"),
    ).withColumn("conserved", (F.col("top_bases") == F.col("length")) & (F.col("bottom_bases") == F.col("length")))


def digest_summary(fragments: DataFrame) -> DataFrame:
    """Per fragment: a one-line description of both ends."""

    def describe(end):
        e = F.col(end)
        overhang = (
            F.when(e["polarity"] == "blunt", F.lit("blunt"))
            .when(e["polarity"] == "five_prime", F.concat(F.lit("5' "), e["overhang"]))
            .otherwise(F.concat(F.lit("3' "), e["overhang"]))
        )
        return F.when(e.isNull() | e["original_terminus"], F.lit("end")).otherwise(
            F.concat(F.array_join(e["enzymes"], "/"), F.lit(" ("), overhang, F.lit(")"))
        )

    return fragments.select(
        "record_id", "fragment_id", F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        describe("left_end").alias("left_end"), describe("right_end").alias("right_end"),
    )


def digest_by_length(fragments: DataFrame) -> DataFrame:
    """Fragments of every record, longest first, then by start."""
    return fragments.select(
        "record_id", "fragment_id", F.col("top.start").alias("start"), F.col("top.length").alias("length")
    ).orderBy("record_id", F.desc("length"), "start")


def cut_labels(sites: DataFrame) -> DataFrame:
    """Enzyme names at each top-strand cut position."""
    return (
        sites.where("top_cut is not null")
        .groupBy("record_id", "top_cut")
        .agg(F.array_join(F.array_sort(F.collect_set("enzyme")), ", ").alias("enzymes"))
    )
