"""SnapGene files, content sniffing and recursive folder listing."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.dna import normalize_dna
from strandlake.operators.joining import large
from strandlake.sources.text import Import, _bound, _stem

# Packet types of the format.
COOKIE, DNA, PRIMERS, NOTES, FEATURES = 9, 0, 5, 6, 10
EXTENSIONS = "*.{dna,gb,gbk,genbank,fa,fasta,fna,json}"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence file below a folder: ``source_path, content, sha256``; hidden files are skipped."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).load(folder)
        .select(F.col("path").alias("source_path"), "content", F.sha2("content", 256).alias("sha256"))
        .dropDuplicates(["source_path"])
    )


def sniff(files: DataFrame) -> DataFrame:
    """Add ``format`` by content, else by extension, with ``mismatch`` or a ``reason`` to refuse."""
    head = F.hex(F.substring("content", 1, 16))
    # Blanks of any number may come first; the match keeps no more than it has to tell formats apart.
    opening = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"^(?:ï»¿)?\s*+(.{0,8})", 1)
    bundle = F.get_json_object(F.when(opening.startswith("{"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff", "")), "$.format")
    seen = (
        F.when(head.startswith("09") & (F.substring(head, 11, 16) == "536E617047656E65"), F.lit("snapgene"))
        .when(opening.startswith("LOCUS"), F.lit("genbank")).when(opening.startswith(">"), F.lit("fasta"))
        .when(bundle.rlike("^[a-z]+-locus$"), F.lit("locus"))
    )
    other = (
        F.when(head.startswith("504B0304"), F.lit("a ZIP archive or Office document")).when(head.startswith("25504446"), F.lit("a PDF document"))
        .when(head.startswith("89504E47"), F.lit("a PNG image")).when(head.startswith("FFD8FF"), F.lit("a JPEG image"))
        .when(head.startswith("D0CF11E0"), F.lit("a legacy Office document")).when(head.startswith("7B5C727466"), F.lit("an RTF document"))
    )
    extension = F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    named = (
        F.when(extension == "dna", F.lit("snapgene")).when(extension.isin("gb", "gbk", "genbank"), F.lit("genbank"))
        .when(extension.isin("fa", "fasta", "fna"), F.lit("fasta")).when(extension == "json", F.lit("locus"))
    )
    reason = (
        F.when(named.isNull(), F.lit("unsupported extension"))
        .when(seen.isNull() & other.isNotNull(), F.concat(F.lit("not a sequence file: "), other))
        .when(seen.isNull() & (named == "snapgene") & ~head.startswith("09"), F.lit("not a SnapGene file"))
    )
    return files.withColumn("reason", reason).withColumn("format", F.when(F.col("reason").isNull(), F.coalesce(seen, named))).withColumn(
        "mismatch", F.col("format") != named
    )


def _split(batches):
    """Walk the type-length-value packets of each file of a batch."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["source_path"], batch["content"]):
            at, reason, found = 0, None, []
            while at < len(content):
                size = struct.unpack(">I", content[at + 1 : at + 5])[0] if len(content) - at >= 5 else None
                if size is None or at + 5 + size > len(content):
                    reason = f"truncated packet at byte {at}"
                    break
                found.append({"packet": len(found), "packet_type": content[at], "payload": content[at + 5 : at + 5 + size]})
                at += 5 + size
            if not reason and not found:
                reason = "file contains no packets"
            rows.append((path, [] if reason else found, reason))
        yield pd.DataFrame(rows, columns=["source_path", "packets", "reason"])


def split_packets(files: DataFrame) -> DataFrame:
    """One row per path: ``source_path, packets, reason``.

    All tables of an import read the rows behind this one shuffle, so that a file is walked once.
    """
    walked = files.select("source_path", "content").mapInPandas(
        _split, "source_path string, packets array<struct<packet int, packet_type int, payload binary>>, reason string"
    )
    return walked.groupBy("source_path").agg(F.flatten(F.collect_list("packets")).alias("packets"), F.max("reason").alias("reason"))


_FEATURES_XML = """Feature array<struct<_type string, _directionality string, _name string,
  Segment array<struct<_range string, _color string>>, Q array<struct<_name string, V array<struct<_text string, _predef string, _int bigint>>>>>>"""
_PRIMERS_XML = "Primer array<struct<_sequence string, _name string, _description string>>"


def parse_snapgene(files: DataFrame) -> tuple[Import, DataFrame]:
    """Records, features, parts, warnings and rejects, and the imported primers."""
    dna = F.filter("packets", lambda p: p["packet_type"] == DNA)
    opening = F.get("packets", F.lit(0))
    shape = split_packets(files).select(
        "source_path", "packets", F.col("reason").alias("cut"), opening["packet_type"].alias("first"), F.size(dna).alias("dna"),
        F.get(dna, F.lit(0))["payload"].alias("body"), F.substring(opening["payload"], 1, 8).alias("cookie"),
    )
    flags = F.conv(F.hex(F.substring("body", 1, 1)), 16, 10).cast("int")
    whole = _bound(shape, normalize_dna(F.decode(F.expr("substring(body, 2)"), "US-ASCII")).alias("sequence")).withColumn(
        "topology", F.when(flags.bitwiseAND(1) == 1, F.lit("circular")).otherwise(F.lit("linear"))
    ).withColumn(
        "reason",
        F.when(F.col("cut").isNotNull(), F.col("cut"))
        .when((F.col("first") != COOKIE) | (F.col("cookie") != F.lit(b"SnapGene")), F.lit("first packet is not the SnapGene cookie"))
        .when(F.col("dna") == 0, F.lit("no DNA packet")).when(F.col("dna") > 1, F.lit("more than one DNA packet"))
        .when(F.col("sequence").isNull(), F.lit("invalid DNA sequence")),
    )
    good = whole.where("reason is null")
    records = good.select(F.col("source_path").alias("record_id"), _stem(F.col("source_path")).alias("name"), "sequence",
                          F.length("sequence").cast("bigint").alias("length"), "topology", "source_path")

    def kept(wanted):
        return good.select(F.col("source_path").alias("record_id"), F.length("sequence").cast("bigint").alias("length"), "topology",
                           F.inline(F.filter("packets", lambda p: wanted(p["packet_type"]))))

    left_alone = kept(lambda kind: ~kind.isin(COOKIE, DNA, FEATURES, PRIMERS)).select(
        "record_id", F.when(F.col("packet_type") == NOTES, F.lit("snapgene_notes_not_interpreted")).otherwise(F.lit("snapgene_packet_not_interpreted")).alias("code"),
        F.concat(F.lit("packet type "), F.col("packet_type").cast("string"), F.lit(" was kept but not interpreted")).alias("message"))
    listed = kept(lambda kind: kind == FEATURES).withColumn("x", F.from_xml(F.decode("payload", "UTF-8"), _FEATURES_XML)).select(
        "record_id", "length", "topology", F.posexplode("x.Feature").alias("at", "f"))
    ranged = listed.select("record_id", "length", "topology", "at", "f", F.posexplode_outer("f.Segment").alias("part", "s")).withColumn(
        "a", F.expr(r"try_cast(regexp_extract(s._range, '^(\\d+)-\\d+$', 1) as bigint)")).withColumn(
        "b", F.expr(r"try_cast(regexp_extract(s._range, '^\\d+-(\\d+)$', 1) as bigint)"))
    fits = F.expr("a > 0 and b > 0 and a <= length and b <= length and (a <= b or topology = 'circular')")
    ranged = ranged.withColumn("ok", F.coalesce(fits, F.lit(False))).withColumn("feature_id", F.format_string("feature-%04d", F.col("at") + 1))
    strand = F.when(F.col("f._directionality") == "1", F.lit("forward")).when(F.col("f._directionality") == "2", F.lit("reverse")).otherwise(F.lit("unknown"))
    from pyspark.sql import Window

    parts = ranged.where("ok").select(
        "record_id", "feature_id", strand.alias("strand"),
        (F.row_number().over(Window.partitionBy("record_id", "feature_id").orderBy("part")) - 1).alias("part_index"),
        (F.col("a") - 1).alias("start"), F.expr("if(a <= b, b - a + 1, length - a + 1 + b)").alias("length"))
    sizes = parts.groupBy("record_id", "feature_id").agg(F.count("*").alias("k"))
    qualifiers = F.expr("""flatten(transform(coalesce(f.Q, array()), q -> if(q.V is null or size(q.V) = 0, array(named_struct('key', q._name, 'value', cast(null as string))),
        transform(q.V, v -> named_struct('key', q._name, 'value', coalesce(v._text, v._predef, cast(v._int as string)))))))""")
    features = listed.withColumn("feature_id", F.format_string("feature-%04d", F.col("at") + 1)).join(large(sizes), ["record_id", "feature_id"]).select(
        "record_id", "feature_id", (F.col("at") + 1).alias("feature_ord"), F.coalesce("f._type", F.lit("misc_feature")).alias("kind"),
        F.coalesce("f._name", F.lit("")).alias("label"), strand.alias("strand"), F.when(F.col("k") == 1, F.lit("contiguous")).otherwise(F.lit("join")).alias("operator"),
        qualifiers.alias("qualifiers"), F.expr("try_element_at(filter(transform(f.Segment, s -> s._color), c -> c is not null), 1)").alias("color"))
    number = F.concat(F.lit("feature "), (F.col("at") + 1).cast("string"))
    bad = ranged.where("not ok and s is not null").select(
        "record_id", F.when(F.col("s._range").isNull(), F.lit("snapgene_feature_segment_missing_range")).otherwise(F.lit("snapgene_feature_range_unsupported")).alias("code"),
        F.when(F.col("s._range").isNull(), F.concat(number, F.lit(" contains a segment without a range"))).otherwise(F.concat(number, F.lit(" range "), F.col("s._range"))).alias("message"))
    gone = ranged.groupBy("record_id", "at").agg(F.bool_or("ok").alias("any")).where("not any").select(
        "record_id", F.lit("snapgene_feature_skipped").alias("code"), F.concat(number, F.lit(" has no supported segments")).alias("message"))
    oligos = kept(lambda kind: kind == PRIMERS).withColumn("x", F.from_xml(F.decode("payload", "UTF-8"), _PRIMERS_XML)).select(
        "record_id", F.posexplode("x.Primer").alias("primer_ord", "p")).withColumn("sequence", normalize_dna("p._sequence"))
    primers = oligos.where("sequence is not null").select("record_id", "primer_ord", F.coalesce("p._name", F.lit("")).alias("name"), "sequence", F.nullif(F.col("p._description"), F.lit("")).alias("description"))
    bad_primers = oligos.where("sequence is null").select("record_id", F.lit("snapgene_primer_skipped").alias("code"), F.concat(F.lit("primer "), (F.col("primer_ord") + 1).cast("string"), F.lit(" has an invalid sequence")).alias("message"))
    warnings = left_alone.unionByName(bad).unionByName(gone).unionByName(bad_primers)
    return Import(records, features, parts, warnings, whole.where("reason is not null").select("source_path", F.col("source_path").alias("record_id"), "reason")), primers


def read_snapgene(spark: SparkSession, path: str) -> tuple[Import, DataFrame]:
    return parse_snapgene(spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_path"), "content"))
