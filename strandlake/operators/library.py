"""A shared parts library built from annotated records.

``occurrences`` is the fact table: ``source_path, feature_ord, label, kind, color,
qualifiers, sequence, canonical, stranded, start, parts``. ``canonical`` (the smaller of a
sequence and its reverse complement) identifies a library feature; its id is a hash of it.
"First seen" follows (source path, feature order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.dna import canonical_dna
from strandlake.operators.joining import large
from strandlake.operators.sequences import feature_sequences

# Placeholder names that do not name a part.
PLACEHOLDERS = ["feature", "new feature", "misc_feature", "misc feature", "untitled", "unnamed", "region"]


def generic_name(label, kind):
    name = F.lower(F.trim(label))
    stem = F.regexp_replace(name, r"[0-9\s#]+$", "")
    return (
        ~name.rlike(r"[\p{L}\p{N}]") | name.startswith("(null)") | (name == F.lower(kind)) | stem.isin(PLACEHOLDERS)
    )


def sequence_name(label):
    return F.trim(label).rlike("^[ACGTNacgtn]{8,}$")


def incomplete_features(warnings: DataFrame) -> DataFrame:
    """Features whose import lost segments, read from the numbered warnings."""
    number = F.regexp_extract("message", r"^feature (\d+)\b", 1)
    return (
        warnings.where(F.col("code").isin("snapgene_feature_range_unsupported", "snapgene_feature_segment_missing_range"))
        .where(number != "")
        .select("record_id", F.format_string("feature-%04d", number.cast("int")).alias("feature_id"))
        .distinct()
    )


def library_candidates(features: DataFrame, parts: DataFrame, records: DataFrame, incomplete: DataFrame | None = None, min_length: int = 12) -> DataFrame:
    """Every annotated feature with its sequence and key, or a ``skip_reason``."""
    joined = features.join(
        large(feature_sequences(parts, records).select("record_id", "feature_id", "sequence", "size", "n")), ["record_id", "feature_id"]
    )
    first = parts.groupBy("record_id", "feature_id").agg(
        F.min_by("start", "part_index").alias("start"), F.count("*").alias("parts")
    )
    joined = joined.join(large(first), ["record_id", "feature_id"])
    if incomplete is not None:
        joined = joined.join(large(incomplete.withColumn("lost", F.lit(True))), ["record_id", "feature_id"], "left")
    else:
        joined = joined.withColumn("lost", F.lit(None).cast("boolean"))
    label, kind = F.col("label"), F.col("kind")
    reason = (
        F.when(F.col("lost"), F.lit("incomplete_location"))
        .when(F.lower(kind) == "source", F.lit("source_feature"))
        .when(F.col("size") >= F.col("n"), F.lit("whole_molecule"))
        .when(F.col("size") < min_length, F.lit("too_short"))
        .when(generic_name(label, kind), F.lit("generic_name"))
        .when(sequence_name(label), F.lit("sequence_as_name"))
        .when(F.col("sequence").isNull(), F.lit("ambiguous_bases"))
    )
    return joined.select(
        "record_id", "feature_id", "feature_ord", F.trim(label).alias("label"), "kind",
        *[c for c in ("color", "qualifiers") if c in features.columns],
        "sequence", canonical_dna("sequence").alias("canonical"), (F.col("strand") != "unknown").alias("stranded"),
        "start", "parts", reason.alias("skip_reason"),
    )


def classify_sources(incoming: DataFrame, known: DataFrame, rescan: bool = False) -> DataFrame:
    """Outcome of each incoming ``(source_path, sha256)`` against the known ones.

    ``unchanged`` (same content, same path), ``duplicate`` (content known elsewhere),
    ``replaced`` (path known with other content) or ``imported``. Within the batch the
    first path of equal contents is the original.
    """
    by_hash = known.select("sha256", F.col("source_path").alias("hash_path"))
    by_path = known.select("source_path", F.lit(True).alias("path_known"))
    first = incoming.groupBy("sha256").agg(F.min("source_path").alias("first_path"))
    same = F.col("hash_path") == F.col("source_path")
    outcome = (
        F.when(same & F.lit(not rescan), F.lit("unchanged"))
        .when(F.col("hash_path").isNotNull() & ~same, F.lit("duplicate"))
        .when(F.col("hash_path").isNull() & (F.col("first_path") != F.col("source_path")), F.lit("duplicate"))
        .when(F.col("path_known"), F.lit("replaced"))
        .otherwise(F.lit("imported"))
    )
    return (
        incoming.join(large(first), "sha256").join(large(by_hash), "sha256", "left").join(large(by_path), "source_path", "left")
        .withColumn("outcome", outcome)
        .withColumn("duplicate_of", F.when(F.col("outcome") == "duplicate", F.coalesce("hash_path", "first_path")))
        .drop("first_path", "hash_path", "path_known")
    )


def upsert_occurrences(existing: DataFrame, outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Occurrences after an import: replaced sources lose theirs, taken sources add theirs."""
    taken = outcomes.where("outcome in ('imported', 'replaced')").select("source_path")
    return existing.join(large(taken), "source_path", "left_anti").unionByName(
        candidates.join(large(taken), "source_path", "left_semi"), allowMissingColumns=True
    )


def derive_features(occurrences: DataFrame) -> DataFrame:
    """One row per distinct part: most frequent name, kind and colour (ties: first seen),
    direction by majority, sequence and qualifiers of the first occurrence with the name.

    Counting per value comes first, so a part seen everywhere shuffles a few rows per task.
    """
    seen = F.struct("source_path", "feature_ord")
    values = F.array(
        F.struct(F.lit("label").alias("what"), F.col("label").alias("value")),
        F.struct(F.lit("kind").alias("what"), F.col("kind").alias("value")),
        F.struct(F.lit("color").alias("what"), F.col("color").alias("value")),
    )
    ranked = (
        occurrences.withColumn("seen", seen)
        .withColumn("as_shown", F.struct("sequence", "qualifiers", "start", "parts"))
        .select("canonical", "seen", "as_shown", F.col("stranded").cast("int").alias("stranded"), F.inline(values))
        .where("value is not null")
        .groupBy("canonical", "what", "value")
        .agg(F.count("*").alias("times"), F.min("seen").alias("first"), F.min_by("as_shown", "seen").alias("as_shown"), F.sum("stranded").alias("stranded"))
    )

    def winner(value, what):
        return F.expr(f"min_by({value}, struct(-times, first)) filter (where what = '{what}')")

    return ranked.groupBy("canonical").agg(
        winner("value", "label").alias("name"), winner("value", "kind").alias("kind"), winner("value", "color").alias("color"),
        winner("as_shown", "label").alias("shown"),
        F.expr("sum(times) filter (where what = 'label')").alias("occurrences"),
        F.expr("2 * sum(stranded) filter (where what = 'label') >= sum(times) filter (where what = 'label')").alias("stranded"),
        F.min("first").alias("first_seen"),
    ).select(
        F.sha2("canonical", 256).alias("library_id"), "canonical", "name", "kind", "color",
        F.col("shown.sequence").alias("sequence"), F.col("shown.qualifiers").alias("qualifiers"),
        F.length("canonical").cast("bigint").alias("length"), "stranded", "occurrences", "first_seen",
        F.lit("imported").alias("status"), F.lit("auto").alias("grouping"),
    )


def curate(features: DataFrame, edits: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Overlay ``(library_id, edited_at, name, kind, hidden, standalone)`` edits.

    The latest non-null value of each field wins; any edit marks a feature curated or hidden,
    and edits survive a refresh because they are kept apart. ``before`` is the feature table of the time before the
    refresh: edited features that no file carries any more stay as they were there, without occurrences.
    """
    if before is not None:
        gone = before.join(large(features.select("library_id")), "library_id", "left_anti").join(large(edits.select("library_id")), "library_id", "left_semi")
        features = features.unionByName(gone.withColumn("occurrences", F.lit(0).cast(features.schema["occurrences"].dataType)).select(*features.columns))
    latest = edits.groupBy("library_id").agg(
        *[F.expr(f"max_by({c}, edited_at) filter (where {c} is not null)").alias(f"e_{c}") for c in ("name", "kind", "hidden", "standalone")]
    ).withColumn("edited", F.lit(True))
    status = F.when(F.col("edited").isNull(), F.col("status")).when(F.col("e_hidden"), F.lit("hidden")).otherwise(F.lit("curated"))
    grouping = F.when(F.col("e_standalone"), F.lit("standalone")).when(~F.col("e_standalone"), F.lit("auto")).otherwise(F.col("grouping"))
    changed = {"name": F.coalesce("e_name", "name"), "kind": F.coalesce("e_kind", "kind"), "status": status, "grouping": grouping}
    return features.join(large(latest), "library_id", "left").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in features.columns])


def aliases(features: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Other labels of each feature, most frequent first, ties first seen."""
    counted = occurrences.groupBy("canonical", "label").agg(
        F.count("*").alias("times"), F.min(F.struct("source_path", "feature_ord")).alias("first")
    )
    others = counted.join(large(features.select("canonical", "name")), "canonical").where("label != name")
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("t"), "first", "label"))), lambda x: x["label"])
    return others.groupBy("canonical").agg(listed.alias("aliases"))


def library_info(features: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Counts of visible features, families, curated and hidden ones, sources and occurrences."""
    family = F.coalesce(F.col("family_id"), F.col("library_id")) if "family_id" in features.columns else F.col("library_id")
    shown = F.col("status") != "hidden"
    a = features.agg(
        F.count_if(shown).alias("features"), F.count_if(shown & (family == F.col("library_id"))).alias("families"),
        F.count_if(F.col("status") == "curated").alias("curated"), F.count_if(~shown).alias("hidden"),
    )
    b = occurrences.agg(F.count_distinct("source_path").alias("sources"), F.count("*").alias("occurrences"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def with_families(features: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``family_id, relation, identity`` from ``families.compute_families`` links."""
    return features.join(
        large(links.select(F.col("member").alias("library_id"), F.col("head").alias("_head"), "relation", "identity")), "library_id", "left"
    ).withColumn("family_id", F.coalesce("_head", "library_id")).drop("_head")


def family_rollup(features: DataFrame) -> DataFrame:
    """Visible variants and occurrences of each family head."""
    members = features.where("family_id != library_id and status != 'hidden'")
    return members.groupBy(F.col("family_id").alias("library_id")).agg(
        F.count("*").alias("variants"), F.sum("occurrences").alias("member_occurrences")
    )


def list_library(features: DataFrame, occurrences: DataFrame, search: str | None = None, kind: str | None = None,
                 include_hidden: bool = False, heads_only: bool = False, limit: int | None = None) -> DataFrame:
    """Features most seen first, filtered by a part of the name or of any label and by kind.

    With ``heads_only`` a head is also found by its members' labels and ranked by its family.
    """
    listed = features if include_hidden else features.where("status != 'hidden'")
    if "family_id" not in features.columns:
        listed = listed.withColumn("family_id", F.col("library_id"))
        features = features.withColumn("family_id", F.col("library_id"))
    if kind is not None:
        listed = listed.where(F.lower("kind") == kind.lower())
    if heads_only:
        listed = listed.where("family_id = library_id")
    if search is not None:
        wanted = search.lower()
        hit = occurrences.where(F.lower("label").contains(wanted)).select("canonical").distinct()
        hits = features.join(large(hit), "canonical", "left_semi").select("library_id", "family_id")
        found = hits.select("library_id")
        if heads_only:
            found = found.union(hits.select("family_id"))
        named = features.where(F.lower("name").contains(wanted)).select("library_id")
        listed = listed.join(large(found.union(named).distinct()), "library_id", "left_semi")
    seen = occurrences.groupBy("canonical").agg(F.count_distinct("source_path").alias("sources"))
    total = F.coalesce("occurrences", F.lit(0)) + F.coalesce("member_occurrences", F.lit(0))
    out = (
        listed.join(large(seen), "canonical", "left").join(large(family_rollup(features)), "library_id", "left")
        .select(
            "library_id", "name", "kind", "length", "color", "status", "occurrences", F.coalesce("sources", F.lit(0)).alias("sources"),
            "family_id", F.coalesce("variants", F.lit(0)).alias("variants"), total.alias("family_occurrences"), "first_seen", "canonical",
        )
        .join(large(aliases(features, occurrences)), "canonical", "left")
        .orderBy(F.desc("family_occurrences" if heads_only else "occurrences"), "name", "first_seen")
    )
    return out.limit(limit) if limit is not None else out


def seen_in(features: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Where each feature was seen; ``reversed`` when it reads against the representative."""
    return occurrences.join(large(features.select("library_id", "canonical", F.col("sequence").alias("shown"))), "canonical").select(
        "library_id", "source_path", "label", "kind", "start", "parts", (F.col("sequence") != F.col("shown")).alias("reversed")
    )


def family_members(features: DataFrame) -> DataFrame:
    """Every visible feature beside its family, head first, then longest first."""
    order = Window.partitionBy("family_id").orderBy((F.col("library_id") != F.col("family_id")), F.desc("length"), "first_seen")
    return features.where("status != 'hidden'").select("family_id", "library_id", "name", "length", F.row_number().over(order).alias("rank"))
