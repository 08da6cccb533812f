"""No table that grows with the input is gathered on the driver to be broadcast."""

import re

import pytest

from strandlake.plans import all_queries
from strandlake.sinks.text import genbank
from strandlake.sources.binary import parse_snapgene
from strandlake.sources.text import parse_genbank
from tests.helpers import parts, records

FOUND = [
    "assembly_junctions", "codon_positions", "amplicons", "binding_sites", "library_skip_reasons", "ligation_junctions", "ligation_placements",
    "overhang_classes", "overlap_assembly", "library_variant_families", "end_pair_classes", "end_pair_matrix", "end_partner_counts",
    "enzyme_usage_by_polarity", "fasta_rejects", "feature_sequences", "fragment_ends", "library_candidates", "enzyme_set_unique6",
    "enzyme_set_unique_dual6", "strand_fasta", "translate_all_cds", "translate_ranges", "translation_skipped",
]


def broadcast_of_rows(plan: str) -> list[str]:
    """Scans of files or checkpoints below a broadcast."""
    found, depth = [], None
    for line in plan.splitlines():
        at = len(re.match(r"[\s:|+\-*()\d]*", line).group())
        if depth is not None and at <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at
        elif depth is not None and ("FileScan" in line or re.search(r"ExistingRDD\[(oligo|member|head|library_id)", line)):
            found.append(line.strip()[:120])
    return found


@pytest.mark.parametrize("name", FOUND)
def test_growing_tables_are_not_broadcast(spark, name):
    df = all_queries()[name].run(spark, "/root/testdata/sf0.001")
    assert broadcast_of_rows(df._jdf.queryExecution().executedPlan().toString()) == []


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_genbank_moves_texts_and_features_once(spark):
    """A record is read within its row: only the record's text (numbering of twins) and its features (their numbers) are shuffled."""
    chunks = spark.createDataFrame([("a.gb", "LOCUS")], "source_path string, value string").repartition(2)
    assert exchanges(parse_genbank(chunks).features) == 2
    molecules = records(spark, ("a", "ACGT", "linear"))
    features = spark.createDataFrame([], "record_id string, feature_id string, feature_ord int, kind string, label string, strand string")
    assert exchanges(genbank(molecules, features, parts(spark))) <= 3


def test_snapgene_files_meet_their_packets_in_one_shuffle(spark):
    files = spark.createDataFrame([("a.dna", b"x")], "source_path string, content binary")
    read, primers = parse_snapgene(files)
    assert exchanges(read.records) == exchanges(primers) == 1


def test_bases_are_spelled_behind_the_spread(spark):
    """The input of a spread is a few small files: a filter on the bases below it would spell them in as few tasks."""
    plan = all_queries()["restriction_sites"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("REPARTITION_BY_NUM")
    assert "md5" in above and "md5" not in below


@pytest.mark.parametrize("name", ["library_listing", "library_features", "library_aliases", "library_seen_in"])
def test_parts_are_spelled_behind_the_spread(spark, name):
    """A join on the parts' bases filters them; below the spread that filter spelled every customer's part in one task."""
    lines = all_queries()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [len(re.match(r"[\s:|+\-*()\d]*", x).group()) for x in lines]
    spreads = [i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    assert spreads and any("md5" in x for x in lines)
    for i in spreads:
        for k in range(i + 1, len(lines)):
            if at[k] <= at[i]:
                break
            assert "md5" not in lines[k]
