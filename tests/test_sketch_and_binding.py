"""The seed filter, and binding sites of oligos of mixed lengths against every place of small molecules."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import detection, primers, sites
from strandlake.operators.sketch import Sketch
from strandlake.plans import all_queries
from tests.helpers import dna, rc, records


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_loses_nothing_and_lets_little_pass(spark, n):
    seeds = spark.range(n).select(F.xxhash64("id").alias("key"))
    sketch = Sketch(seeds, "key")
    asked = spark.range(50_000).where(sketch.holds(F.xxhash64("id")))
    found = {r.id for r in asked.collect()}
    assert set(range(n)) <= found and len(found) <= n + 50


def brute_sites(oligos, molecules, most, anchor):
    out = set()
    for key, text, ring in molecules:
        for oligo in oligos:
            for start in range(len(text)):
                if len(oligo) > len(text) or (not ring and start + len(oligo) > len(text)):
                    continue
                window = (text * 2)[start : start + len(oligo)]
                for reverse in (False, True):
                    read = rc(window) if reverse else window
                    wrong = sum(a != b for a, b in zip(oligo, read))
                    if wrong <= most and read[-anchor:] == oligo[-anchor:]:
                        out.add((key, oligo, reverse, start, wrong))
    return out


@pytest.mark.parametrize("most,anchor,step", [(0, 8, 64), (1, 6, 32), (2, 4, 8192), (2, 8, 40)])
def test_binding_sites_equal_every_place(spark, most, anchor, step):
    rng = random.Random(most * 10 + anchor)
    molecules = [(f"m{i}", dna(rng, n), i % 2 == 0) for i, n in enumerate((300, 257, 90, 61, 25, 19, 18, 12, 4))]
    oligos = set()
    for _, text, _ in molecules[:6]:
        for _ in range(6):
            size, at = rng.choice((18, 19, 21, 26, 31)), rng.randrange(len(text))
            found = list((text * 3)[at : at + size])
            for _ in range(rng.randrange(0, 4)):
                found[rng.randrange(size)] = rng.choice("ACGT")
            found = "".join(found)
            oligos.add(rng.choice((found, rc(found))))
    oligos.add("A" * 18)
    molecules.append(("runs", "A" * 50, True))
    table = records(spark, *[(k, t, "circular" if ring else "linear") for k, t, ring in molecules])
    frame = spark.createDataFrame([(o,) for o in oligos] * 2, "oligo string")
    got = primers.binding_sites(frame, table, most, anchor, 18, step=step).collect()
    listed = [(r.record_id, r.oligo, r.reverse, r.start, r.mismatches) for r in got]
    assert len(listed) == len(set(listed)) and set(listed) == brute_sites(oligos, molecules, most, anchor)


def test_no_oligos_and_no_molecules(spark):
    table = records(spark, ("a", "ACGTACGTACGTACGTACGTACGT", "circular"))
    none = spark.createDataFrame([], "oligo string")
    assert primers.binding_sites(none, table, 1, 8, 18).count() == 0
    one = spark.createDataFrame([("ACGTACGTACGTACGTAC",)], "oligo string")
    assert primers.binding_sites(one, table.limit(0), 1, 8, 18).count() == 0


def test_detection_with_an_empty_library(spark):
    table = records(spark, ("a", "ACGTACGTACGTACGTACGTACGT", "circular"))
    library = spark.createDataFrame([], "library_id string, name string, kind string, family_id string, stranded boolean, sequence string, status string")
    assert detection.detect_features(table, library).count() == 0


def test_motif_counts_equal_every_place(spark):
    rng = random.Random(12)
    base = dna(rng, 60)
    molecules = [("a", base + dna(rng, 40) + base[:30], True), ("b", base + rc(base[10:40]), False), ("c", dna(rng, 25), True), ("d", "ACGT" * 12, True), ("e", base, False)]
    motifs = [(k, (t * 2)[i : i + n]) for k, t, _ in molecules for i in (0, 7, len(t) - 9) for n in (9, 18, 24)]
    motifs += [("a", base[:200]), ("e", base * 2), ("e", None), ("b", base[:18]), ("b", base[:18]), ("e", molecules[2][1][:12])]
    frame = spark.createDataFrame(motifs, "record_id string, motif string")
    table = records(spark, *[(k, t, "circular" if ring else "linear") for k, t, ring in molecules])
    want = {}
    for key, motif in {m for m in motifs if m[1]}:
        text, ring = next((t, r) for k, t, r in molecules if k == key)
        places = [(text * 2)[i : i + len(motif)] for i in range(len(text)) if len(motif) <= len(text) and (ring or i + len(motif) <= len(text))]
        n = sum(p == motif for p in places) + sum(rc(p) == motif for p in places)
        if n:
            want[key, motif] = n
    got = {(r.record_id, r.motif): r.sites for r in sites.motif_counts(frame, table, step=32).collect()}
    assert got == want
    once = {(r.record_id, r.motif) for r in sites.unique_motifs(frame, table).collect()}
    assert once == {k for k, n in want.items() if n == 1 and rc(k[1]) != k[1]}


def test_seeds_name_more_bases_when_there_are_more_oligos():
    """a seed of the anchor and a third of the other bases is held by chance in a share of windows that grows with the oligos."""
    assert sites._segments(1_800_000, 2, 8, 12) == 4 and sites._segments(30_000, 2, 8, 12) == 3
    chance = {n: sum(1.8e6 / 4 ** (8 + sum(b - a for a, b in (sites._cuts(12, n)[j] for j in c))) for c in sites._choices(n, 2)) for n in (3, 4)}
    assert chance[4] < chance[3] / 7 and sites._segments(10, 2, 8, 10) >= 3 and sites._segments(10, 2, 8, 0) == 3


def test_both_strands_of_amplicons_come_from_one_scan(spark):
    plan = all_queries()["amplicons"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("segments", [3, 4, 5, 6])
def test_sites_are_the_same_for_any_number_of_segments(spark, monkeypatch, segments):
    monkeypatch.setattr(sites, "_segments", lambda *_: segments)
    rng = random.Random(segments)
    molecules = [(f"m{i}", dna(rng, n), i % 2 == 0) for i, n in enumerate((200, 150, 40, 19))]
    oligos = set()
    for _, text, _ in molecules:
        for _ in range(10):
            size, at = rng.choice((18, 20, 23)), rng.randrange(len(text))
            found = list((text * 3)[at : at + size])
            for _ in range(rng.randrange(0, 3)):
                found[rng.randrange(size - 6)] = rng.choice("ACGT")
            oligos.add(rng.choice(("".join(found), rc("".join(found)))))
    table = records(spark, *[(k, t, "circular" if ring else "linear") for k, t, ring in molecules])
    got = primers.binding_sites(spark.createDataFrame([(o,) for o in oligos], "oligo string"), table, 2, 6, 18, step=64).collect()
    listed = [(r.record_id, r.oligo, r.reverse, r.start, r.mismatches) for r in got]
    assert len(listed) == len(set(listed)) and set(listed) == brute_sites(oligos, molecules, 2, 6)
