import random
import re

from strandlake.dims.enzymes import builtin, enzymes_table, select_enzymes
from strandlake.functions.dna import iupac_regex, revcomp_text
from strandlake.operators import restriction as R
from tests.helpers import dna, rc, records, rows


def brute_sites(sequence, topology, names):
    found, n = [], len(sequence)
    for e in select_enzymes(names):
        m = len(e.recognition_sequence)
        if topology == "circular" and n < e.span:
            continue
        text = sequence * 3 if topology == "circular" else sequence
        for strand, motif in (("forward", e.recognition_sequence), ("reverse", revcomp_text(e.recognition_sequence))):
            if strand == "reverse" and motif == e.recognition_sequence:
                continue
            top, bottom = (e.top_cut_offset, e.bottom_cut_offset) if strand == "forward" else (m - e.bottom_cut_offset, m - e.top_cut_offset)
            for i in range(n):
                if re.fullmatch(iupac_regex(motif), text[i : i + m]):
                    cut = (lambda o: (i + o) % n) if topology == "circular" else (lambda o: i + o if 0 <= i + o <= n else None)
                    found.append((e.name, strand, i, cut(top), cut(bottom)))
    return sorted(found, key=str)


def sites_of(spark, sequence, topology, names, **kw):
    found = R.find_sites(records(spark, ("r", sequence, topology)), names, **kw)
    return sorted((tuple(r) for r in found.select("enzyme", "strand", "site_start", "top_cut", "bottom_cut").collect()), key=str)


def test_hand_checked_sites(spark):
    assert sites_of(spark, "AAAAAGAGACCAAAAA", "linear", ["bsai"]) == [("BsaI", "reverse", 5, 0, 4)]
    assert sites_of(spark, "TTCGAA", "circular", ["EcoRI"]) == [("EcoRI", "forward", 3, 4, 2)]
    assert sites_of(spark, "GGTCTC", "linear", ["BsaI"]) == [("BsaI", "forward", 0, None, None)]


def test_sites_match_brute_force_for_every_tile_size(spark):
    rng = random.Random(3)
    names = [e.name for e in builtin()]
    molecules = [("a", dna(rng, 400), "linear"), ("b", dna(rng, 300), "circular"), ("c", "GATC" * 20, "circular"), ("d", "CCGG" * 9 + "GA", "linear")]
    table = records(spark, *molecules)
    for step in (64, 1000):
        found = R.find_sites(table, names, step=step, skip_short_circles=True)
        got = {}
        for r in found.collect():
            got.setdefault(r.record_id, []).append((r.enzyme, r.strand, r.site_start, r.top_cut, r.bottom_cut))
        for key, sequence, topology in molecules:
            assert sorted(got.get(key, []), key=str) == brute_sites(sequence, topology, names), (key, step)


def test_counts_hold_absent_enzymes_and_sets(spark):
    table = records(spark, ("r", "AAAGAATTCTTTGGATCCAAAGGATCC", "linear"))
    counts = R.enzyme_counts(table)
    assert counts.count() == 99
    assert rows(counts.where("enzyme in ('EcoRI', 'BamHI', 'NotI')"), "enzyme", "sites") == [("BamHI", 2), ("EcoRI", 1), ("NotI", 0)]
    dims = enzymes_table(spark)
    assert "EcoRI" in [r.enzyme for r in R.enzymes_in_set(counts, dims, "unique6").collect()]
    assert [r.enzyme for r in R.enzymes_in_set(counts, dims, "custom", ["BamHI", "NotI"]).collect()] == ["BamHI"]


def test_linear_digest_ends(spark):
    f = R.digest(records(spark, ("r", "AAAGAATTCTTT", "linear")), ["EcoRI"]).orderBy("fragment_ord").collect()
    assert [x.top.sequence for x in f] == ["AAAG", "AATTCTTT"]
    assert [x.bottom.sequence for x in f] == ["AATTCTTT", "AAAG"]
    assert [x.paired_length for x in f] == [4, 4]
    assert f[0].right_end.overhang == "AATT" and f[0].right_end.protruding_strand == "reverse"
    assert f[0].left_end.original_terminus and not f[0].right_end.original_terminus


def test_every_rotation_of_a_circle_conserves_bases(spark):
    base = "AAGAATTCAAAAGGTACCTTTTGAGACCTTCTTTTT"
    table = records(spark, *[(str(i), base[i:] + base[:i], "circular") for i in range(len(base))])
    digest = R.digest(table, ["EcoRI", "KpnI"])
    checked = R.digest_conservation(digest).collect()
    assert len(checked) == len(base) and all(r.conserved and r.fragments == 2 for r in checked)
    tops = {tuple(sorted(x.top.sequence for x in digest.where(f"record_id = '{i}'").collect())) for i in (0, 4, 20)}
    assert len(tops) == 1


def test_refusals(spark):
    table = records(spark, ("amb", "AANTT", "linear"), ("out", "GGTCTC", "linear"), ("short", "GGTCTCA", "circular"), ("uncut", "AAAAAAAAAAAAAAAAAAA", "circular"))
    assert [r[0] for r in rows(R.digest_rejects(table, ["BsaI"]), "record_id", "reason")] == ["amb", "out", "short"]
    left = R.digest(table, ["BsaI"]).collect()
    assert [(x.record_id, x.topology, x.left_end) for x in left] == [("uncut", "circular", None)]


def test_revcomp_helper():
    assert rc("GAATTC") == "GAATTC"
