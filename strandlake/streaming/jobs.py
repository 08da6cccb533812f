"""Continuous import of sequence files and detection on arriving records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.detection import detect_features
from strandlake.operators.library import classify_sources, incomplete_features, library_candidates, upsert_occurrences
from strandlake.session import ship_package
from strandlake.sources.binary import EXTENSIONS, parse_snapgene, sniff
from strandlake.sources.locus import SCHEMA, bundle_rejects, locus_tables
from strandlake.sources.text import parse_fasta, parse_genbank

OCCURRENCES = """source_path string, feature_ord bigint, label string, kind string, color string,
qualifiers array<struct<key: string, value: string>>, sequence string, canonical string, stranded boolean, start bigint, parts bigint, sha256 string"""

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def import_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read files of mixed formats: ``(occurrences, rejects, skipped)``. ``files`` holds ``source_path,
    content, sha256``; a file that cannot be read never stops the others. ``skipped`` counts the features of each
    file that stay out of the library, by reason; a feature whose location was read in part is one of them."""
    ship_package(files.sparkSession)
    judged = sniff(files)
    rejects = [judged.where("reason is not null").select("source_path", "reason")]

    def chunks(name, separator):
        text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿?\\s*", "")
        return judged.where(F.col("format") == name).select("source_path", F.explode(F.split(text, separator)).alias("value")).where(F.trim("value") != "")

    genbank = parse_genbank(chunks("genbank", "\n//"))
    fasta = parse_fasta(chunks("fasta", "\n>"))
    snapgene, _ = parse_snapgene(judged.where("format = 'snapgene'"))
    bundles = judged.where("format = 'locus'").select(
        F.col("source_path").alias("record_id"), F.from_json(F.make_valid_utf8(F.col("content").cast("string")), SCHEMA).alias("b")).select("record_id", "b.*")
    locus = locus_tables(bundles)
    rejects += [r.select("source_path", "reason") for r in (genbank.rejects, fasta.rejects, snapgene.rejects)]
    rejects.append(bundle_rejects(bundles).select(F.col("record_id").alias("source_path"), "reason"))
    found, skipped = None, None
    read = [(r.features, r.parts, r.records, incomplete_features(r.warnings)) for r in (genbank, snapgene)]
    read.append((locus["features"], locus["parts"], locus["records"].withColumn("source_path", F.col("record_id")), None))
    for features, parts, records, incomplete in read:
        candidates = library_candidates(features, parts, records, incomplete).join(records.select("record_id", "source_path"), "record_id")
        if "color" not in candidates.columns:
            candidates = candidates.withColumn("color", F.lit(None).cast("string"))
        left_out = candidates.where("skip_reason is not null").groupBy("source_path", "skip_reason").agg(F.count("*").alias("features"))
        rows = candidates.where("skip_reason is null").select(
            "source_path", F.col("feature_ord").cast("bigint"), "label", "kind", "color", "qualifiers", "sequence", "canonical", "stranded", "start", "parts")
        found = rows if found is None else found.unionByName(rows)
        skipped = left_out if skipped is None else skipped.unionByName(left_out)
    failed = rejects[0]
    for more in rejects[1:]:
        failed = failed.unionByName(more)
    return found.join(files.select("source_path", "sha256"), "source_path"), failed, skipped


def merge_batch(spark: SparkSession, files: DataFrame, library_path: str, batch: int) -> None:
    """Fold one batch of files into the versioned occurrence table below ``library_path``.

    Version ``batch`` is written from the version before it, so a repeated batch after a lost
    driver overwrites the same folder with the same rows. Content is known by its hash: files that are unchanged or
    copies are dropped before anything is parsed. Files that cannot be read stand in the version's ``rejects``, left
    out features in its ``skipped``.
    """
    before = f"{library_path}/v{batch - 1}"
    occurrences = spark.read.schema(OCCURRENCES).parquet(f"{before}/occurrences") if batch > 0 else spark.createDataFrame([], OCCURRENCES)
    known = spark.read.schema("source_path string, sha256 string").parquet(f"{before}/sources") if batch > 0 else spark.createDataFrame([], "source_path string, sha256 string")
    outcomes = classify_sources(files.select("source_path", "sha256"), known)
    fresh = outcomes.where("outcome in ('imported', 'replaced')").select("source_path")
    candidates, rejects, skipped = import_files(files.join(fresh, "source_path", "left_semi"))
    merged = upsert_occurrences(occurrences, outcomes, candidates)
    taken = outcomes.where("outcome in ('imported', 'replaced')").select("source_path", "sha256")
    sources = known.join(taken.select("source_path"), "source_path", "left_anti").unionByName(taken)
    after = f"{library_path}/v{batch}"
    merged.write.mode("overwrite").parquet(f"{after}/occurrences")
    sources.write.mode("overwrite").parquet(f"{after}/sources")
    rejects.write.mode("overwrite").parquet(f"{after}/rejects")
    skipped.write.mode("overwrite").parquet(f"{after}/skipped")


def stream_library_import(spark: SparkSession, folder: str, library_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Import files as they arrive below ``folder``; the newest ``v*`` folder is the library."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).load(folder)
        .select(F.col("path").alias("source_path"), "content", F.sha2("content", 256).alias("sha256"))
    )

    def each(batch: DataFrame, number: int) -> None:
        merge_batch(batch.sparkSession, batch, library_path, number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_detect(records: DataFrame, library: DataFrame, out_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Annotate arriving records against a static library, in append mode."""

    def each(batch: DataFrame, number: int) -> None:
        detect_features(batch, library).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
