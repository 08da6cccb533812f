import struct

import pytest
from pyspark.sql import functions as F

from strandlake.operators import isoforms
from strandlake.operators import records as P
from strandlake.sources import binary as B
from strandlake.sources import locus, plans
from strandlake.sources import text as S
from strandlake.streaming import jobs
from tests.helpers import records, rows

GENBANK = """LOCUS       toy                       40 bp    DNA     circular SYN 01-JAN-2020
DEFINITION  a toy.
FEATURES             Location/Qualifiers
     CDS             complement(join(3..5,
                     8..12))
                     /gene="abc"
                     /note="a ""quoted"" text
                     over two lines"
                     /pseudo
     misc_feature    38..2
                     /label=wrap
     gene            <1..>9
                     /locus_tag="L1"
     bad             join(1..3,complement(5..6))
     remote          J00194.1:100..202
     exon            join(complement(8..12),complement(3..5))
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgtacgtac gtac*tacgt
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "toy.gb").write_text(GENBANK * 2)
    read = S.read_genbank(spark, str(tmp_path))
    assert rows(read.records, "name", "topology", "length") == [("toy", "circular", 40)] * 2
    one = read.records.limit(1).select("record_id")
    f = read.features.join(one, "record_id", "left_semi").orderBy("feature_ord").collect()
    assert [(x.feature_id, x.kind, x.label, x.strand, x.operator) for x in f] == [
        ("feature-0001", "CDS", "abc", "reverse", "join"), ("feature-0002", "misc_feature", "wrap", "forward", "contiguous"),
        ("feature-0003", "gene", "L1", "forward", "contiguous"), ("feature-0004", "exon", "exon", "reverse", "join")]
    assert [(q.key, q.value) for q in f[0].qualifiers] == [("gene", "abc"), ("note", 'a "quoted" text over two lines'), ("pseudo", None)]
    p = read.parts.join(one, "record_id", "left_semi")
    assert rows(p, "feature_id", "part_index", "start", "length") == [
        ("feature-0001", 0, 2, 3), ("feature-0001", 1, 7, 5), ("feature-0002", 0, 37, 5), ("feature-0003", 0, 0, 9), ("feature-0004", 0, 2, 3), ("feature-0004", 1, 7, 5)]
    codes = rows(read.warnings.join(one, "record_id", "left_semi"), "code")
    assert codes == [("genbank_feature_skipped",), ("genbank_feature_skipped",), ("genbank_partial_location",), ("genbank_sequence_placeholder",)]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nacgt\r\nNNRY\n>two\nAC GT\n>three\n>\nGG\n")
    read = S.read_fasta(spark, str(tmp_path))
    assert rows(read.records, "name", "sequence") == [("one", "ACGTNNRY"), ("x", "GG")]
    assert len(read.rejects.collect()) == 2


def test_rebase(spark, tmp_path):
    (tmp_path / "e").write_text("# head\nAaI GAATTC 6 2 0 1 5 0 0\nBbI CCNNGG 6 2 0 -2 4 0 0\nCcI GANXTC 6 2 0 1 4 0 0\nDdI GATC 4 4 0 1 2 3 4\nEeI AAAA 4 2 0 1 1 0 0\nFfI TTTT 4 0 0 0 0 0 0\nAaI AAAA 4 2 0 1 1 0 0\n")
    (tmp_path / "r").write_text("# head\n" + "".join(f"{n}\na\nb\nc\nd\n{s}\ne\n//\n" for n, s in (("AaI", "N"), ("BbI", "N"), ("CcI", "N"), ("DdI", "N"), ("EeI", ""), ("FfI", "N"))))
    enzymes, unsupported = S.read_rebase(spark, str(tmp_path / "e"), str(tmp_path / "r"))
    assert rows(enzymes, "name", "top_cut_offset", "bottom_cut_offset") == [("AaI", 1, 5), ("BbI", -1, 4)]
    assert rows(unsupported, "name") == [("CcI",), ("DdI",), ("FfI",)]


def packet(kind, body):
    return bytes([kind]) + struct.pack(">I", len(body)) + body


def snapgene(sequence=b"\x01" + b"ACGTACGTACGTACGTACGT", xml=b'<Features><Feature name="x" directionality="2"><Segment range="18-3"/></Feature></Features>'):
    return packet(9, b"SnapGene\x00\x01\x00\x0f\x00\x13") + packet(0, sequence) + packet(10, xml)


def test_snapgene_and_sniffing(spark, tmp_path):
    (tmp_path / "ok.dna").write_bytes(snapgene())
    (tmp_path / "cut.dna").write_bytes(snapgene()[:-4])
    (tmp_path / "two.dna").write_bytes(snapgene() + packet(0, b"\x00ACGT"))
    (tmp_path / "text.dna").write_text(GENBANK)
    (tmp_path / "doc.gb").write_bytes(b"%PDF-1.4")
    files = B.list_files(spark, str(tmp_path))
    judged = {r.source_path.rsplit("/", 1)[1]: (r.format, r.mismatch, r.reason) for r in B.sniff(files).collect()}
    assert judged["ok.dna"] == ("snapgene", False, None) and judged["text.dna"] == ("genbank", True, None) and judged["doc.gb"][2].endswith("a PDF document")
    read, _ = B.parse_snapgene(B.sniff(files).where("format = 'snapgene'"))
    assert rows(read.records, "name", "length", "topology") == [("ok", 20, "circular")]
    assert rows(read.parts, "feature_id", "strand", "start", "length") == [("feature-0001", "reverse", 17, 6)]
    assert sorted(r.reason.split(" at ")[0] for r in read.rejects.collect()) == ["more than one DNA packet", "truncated packet"]


def test_plans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"plan_id":"a","version":1,"topology":"circular","inputs":[{"path":"x","enzymes":["EcoRI"]}],"fragments":[{"input":1,"fragment_id":"fragment-0001","orientation":"forward"}]}')
    (tmp_path / "b.json").write_text('{"plan_id":"b","version":1,"topology":"circular","inputs":[],"fragments":[],"extra":1}')
    (tmp_path / "c.json").write_text('{"plan_id":')
    good, bad = plans.read_plans(spark, "ligation", str(tmp_path / "*.json"))
    assert rows(plans.ligation_rows(good), "plan_id", "record_id", "input", "fragment_id") == [("a", "x", 1, "fragment-0001")]
    assert sorted(r.reason for r in bad.collect()) == ["malformed JSON", "unknown field"]


def test_locus(spark, tmp_path):
    (tmp_path / "l.json").write_text("""{"format":"toy-locus","version":1,"sequence":"%s","gene":{"symbol":"GENE","strand":"-"},
      "transcripts":[{"transcript_id":"T1","exons":[[20,30],[2,10]],"cds":[[22,28]],"cds_includes_stop":false,"codon_start":1,"evidence":{"state":"quantified"},
      "expression":{"q":[{"cell_line":"A","mean":4.0}]}},{"transcript_id":"T2","exons":[[1,9]],"cds":[],"evidence":{"state":"discoverable"}}],
      "panel":{"q":{"cell_lines":[{"cell_line":"A"},{"cell_line":"B"}],"reports_zeros":false}}}""" % ("ACGT" * 10))
    tables = locus.locus_tables(locus.read_locus(spark, str(tmp_path / "l.json")))
    assert rows(tables["features"], "feature_id", "kind", "strand", "color") == [
        ("feature-0001", "mRNA", "reverse", locus.COLOR_EXPRESSED), ("feature-0002", "CDS", "reverse", locus.COLOR_EXPRESSED), ("feature-0003", "misc_RNA", "reverse", locus.COLOR_NOT_FOUND)]
    assert rows(tables["parts"].where("feature_id = 'feature-0001'"), "part_index", "start", "length") == [(0, 2, 8), (1, 20, 10)]
    assert tables["warnings"].count() == 1


def test_stream_equals_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "lib"
    folder.mkdir()
    long = GENBANK.replace("complement(join(3..5,\n                     8..12))", "complement(3..20)")
    (folder / "a.gb").write_text(long)
    (folder / "b.dna").write_bytes(snapgene(xml=b'<Features><Feature name="piece" directionality="1"><Segment range="2-16"/></Feature></Features>'))
    for step, name in enumerate(("first", "second")):
        if step:
            (folder / "c.gb").write_text(long.replace('"abc"', '"xyz"'))
            (folder / "copy.gb").write_text(long)
        jobs.stream_library_import(spark, str(folder), str(out), str(tmp_path / "check")).awaitTermination()
    newest = sorted(out.glob("v*"))[-1]
    streamed = spark.read.parquet(f"{newest}/occurrences")
    assert len(list(out.glob("v*"))) == 2
    jobs.merge_batch(spark, B.list_files(spark, str(folder)), str(tmp_path / "once"), 0)
    batch = spark.read.parquet(f"{tmp_path}/once/v0/occurrences")
    assert rows(streamed, "label", "canonical") == rows(batch, "label", "canonical") and len(rows(batch, "label")) == 3


def test_edits_and_integrity(spark):
    table = records(spark, ("r", "ATGAAATAGCCCCCC", "circular"))
    edits = spark.createDataFrame(
        [("r", 1, "cds", "CDS", "#ff0000", 0, 9, "forward", True, 1, 1, None), ("r", 2, " ", "CDS", None, 0, 9, "forward", False, 1, 1, None), ("r", 3, "wrap", "misc", None, 12, 2, "unknown", False, 1, 1, "n")],
        "record_id string, edit_ord int, label string, kind string, color string, start bigint, end bigint, strand string, translate boolean, codon_start int, transl_table int, note string")
    old = spark.createDataFrame([("r", "feature-0007", 1)], "record_id string, feature_id string, feature_ord int")
    added, p, warnings = P.add_features(edits, table, old)
    assert rows(added, "feature_id", "label") == [("feature-0008", "cds"), ("feature-0009", "wrap")]
    assert rows(p, "feature_id", "start", "length") == [("feature-0008", 0, 9), ("feature-0009", 12, 5)]
    assert {q.key: q.value for q in added.where("label = 'cds'").collect()[0].qualifiers}["translation"] == "MK"
    assert warnings.count() == 0 and P.edit_rejects(edits, table).count() == 1
    assert P.integrity_report(table, added, p.withColumn("start", F.col("start") + 12)).count() >= 1


def test_equal_records_of_one_fasta_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nAAAGAATTCTTT\n>x\nAAAGAATTCTTT\n")
    read = S.read_fasta(spark, str(tmp_path / "a.fa"))
    ids = [r.record_id for r in read.records.collect()]
    assert len(ids) == 2 and len(set(ids)) == 2


def test_fasta_without_header_is_refused_as_a_whole(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGTACGT\nGGTTGGTT\n>x\nACGT\n")
    (tmp_path / "good.fa").write_text("\n>y\nACGT\n")
    read = S.read_fasta(spark, str(tmp_path / "*.fa"))
    assert rows(read.records, "name", "sequence") == [("y", "ACGT")]
    assert {r.source_path.rsplit("/", 1)[1] for r in read.rejects.collect()} == {"bad.fa"}


def test_lone_quote_costs_its_own_qualifier_only(spark, tmp_path):
    body = """LOCUS       T 20 bp DNA linear
FEATURES             Location/Qualifiers
     gene            1..4
                     /gene="one"
                     /note=5" end
     gene            5..8
                     /note="a /slash=1
                     /line and ""quoted"" words"
                     /gene="two"
     gene            9..12
                     /gene="three"
ORIGIN
        1 acgtacgtac gtacgtacgt
//
"""
    (tmp_path / "q.gb").write_text(body)
    read = S.read_genbank(spark, str(tmp_path / "q.gb"))
    assert sorted(r.label for r in read.features.collect()) == ["one", "three", "two"]
    notes = [q.value for f in read.features.where("label = 'two'").collect() for q in f.qualifiers if q.key == "note"]
    assert notes == ['a /slash=1 /line and "quoted" words']


def test_sniffing_reads_past_any_number_of_blanks(spark, tmp_path):
    (tmp_path / "blank.dna").write_bytes(b" " * 10_000 + b"LOCUS x")
    (tmp_path / "bundle.json").write_text('{"sequence": "%s", "format": "toy-locus"}' % ("ACGT" * 3000))
    found = {r.source_path.rsplit("/", 1)[1]: r.format for r in B.sniff(B.list_files(spark, str(tmp_path))).collect()}
    assert found == {"blank.dna": "genbank", "bundle.json": "locus"}


def test_import_of_all_formats_with_rejects_and_skips(spark, tmp_path):
    (tmp_path / "a.dna").write_bytes(snapgene(xml=b'<Features><Feature name="cut" directionality="1"><Segment range="2-16"/><Segment range="1-900"/></Feature>'
                                                 b'<Feature name="whole" directionality="1"><Segment range="2-16"/></Feature></Features>'))
    (tmp_path / "l.json").write_text('{"format":"toy-locus","version":1,"sequence":"%s","gene":{"symbol":"G","strand":"+"},"transcripts":[{"transcript_id":"T1",'
                                     '"exons":[[2,30]],"cds":[],"evidence":{"state":"discoverable"}}],"panel":{}}' % ("ACGTTGCA" * 5))
    (tmp_path / "bad.json").write_text('{"format":"toy-locus","version":7,"sequence":"ACGT"}')
    (tmp_path / "bad.fa").write_text("ACGT\n")
    found, rejects, skipped = jobs.import_files(B.list_files(spark, str(tmp_path)))
    assert sorted(r.label for r in found.collect()) == ["T1", "whole"]
    assert {r.source_path.rsplit("/", 1)[1] for r in rejects.collect()} == {"bad.json", "bad.fa"}
    assert [(r.skip_reason, r.features) for r in skipped.collect()] == [("incomplete_location", 1)]


def test_edit_through_the_origin_with_a_long_kind(spark):
    table = records(spark, ("r", "ATGAAATAGCCCCCC", "circular"))
    edits = spark.createDataFrame(
        [("r", 1, "x", "a_kind_of_many_letters", None, 12, 0, "forward", False, 1, 1, None), ("r", 2, "y", "misc", None, 0, 9, "forward", True, 1, 1, None)],
        "record_id string, edit_ord int, label string, kind string, color string, start bigint, end bigint, strand string, translate boolean, codon_start int, transl_table int, note string")
    old = spark.createDataFrame([], "record_id string, feature_id string, feature_ord int")
    added, p, _ = P.add_features(edits, table, old)
    assert rows(added, "label", "kind") == [("x", "a_kind_of_many_letters"), ("y", "CDS")] and rows(p, "start", "length") == [(0, 9), (12, 3)]


def test_arriving_records_are_annotated_once(spark, tmp_path):
    folder, out, check = tmp_path / "records", tmp_path / "found", tmp_path / "check"
    part = "ACCGTTAGGCATTACGAT"
    library = spark.createDataFrame(
        [("p", "part", "CDS", "p", True, part, "imported")], "library_id string, name string, kind string, family_id string, stranded boolean, sequence string, status string")

    def run():
        arriving = spark.readStream.schema(records(spark).schema).parquet(str(folder))
        jobs.stream_detect(arriving, library, str(out), str(check)).awaitTermination()
        return sorted((r.record_id, r.start, r.strand) for r in spark.read.parquet(str(out)).collect())

    records(spark, ("one", "TTTT" + part + "GGGG", "linear")).coalesce(1).write.mode("append").parquet(str(folder))
    first = [("one", 4, "forward")]
    assert run() == first and run() == first
    records(spark, ("two", part[9:] + "CCCC" + part[:9], "circular")).coalesce(1).write.mode("append").parquet(str(folder))
    both = [*first, ("two", 13, "forward")]
    assert run() == both
    # A driver lost before it noted the last batch runs this batch again.
    for note in (check / "commits").glob("*1*"):
        note.unlink()
    assert run() == both


def test_unknown_quantifier_is_an_error(spark):
    means = spark.createDataFrame([("r", "t", "tpm", 1.0, "shown")], "record_id string, transcript_id string, quantifier string, panel_mean double, display string")
    views = spark.createDataFrame([("r", "t", [1], [(3,)])], "record_id string, transcript_id string, exons array<int>, cds array<struct<length: bigint>>")
    assert isoforms.isoform_summary(views, means, "tpm").count() == 1
    with pytest.raises(ValueError, match="fpkm.*there are: tpm"):
        isoforms.isoform_summary(views, means, "fpkm")
