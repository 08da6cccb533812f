import random
import re

from pyspark.sql import functions as F

from strandlake.operators import detection as D
from strandlake.operators import families as V
from strandlake.operators import library as L
from tests.helpers import dna, rc, records, rows


def entries(spark, *items):
    """``(id, name, sequence, stranded, family)``."""
    return spark.createDataFrame(
        [(i, n, "misc_feature", f, s, q, "imported") for i, n, q, s, f in items],
        "library_id string, name string, kind string, family_id string, stranded boolean, sequence string, status string",
    )


def brute_hits(sequence, topology, query):
    n, found = len(sequence), []
    text = sequence * 2 if topology == "circular" else sequence
    for hit, q in (("forward", query), ("reverse", rc(query))):
        if hit == "reverse" and q == query:
            continue
        if len(q) <= n:
            found += [(i, hit) for i in range(n) if text[i : i + len(q)] == q]
    return found


def test_detection_matches_brute_force(spark):
    rng = random.Random(5)
    a = dna(rng, 200)
    molecules = [("lin", a + "A" * 40 + dna(rng, 60), "linear"), ("circ", a[150:] + dna(rng, 50) + a[:150], "circular"), ("low", "AT" * 40, "circular")]
    queries = [("q1", a[10:40]), ("q2", rc(a[100:160])), ("q3", "A" * 14), ("q4", "AT" * 7), ("q5", a[140:160]), ("q6", "GAATTCGAATTC")]
    lib = entries(spark, *[(i, i, q, True, i) for i, q in queries])
    for step in (32, 8192):
        got = {}
        for r in D.detect_features(records(spark, *molecules), lib, step=step).collect():
            got.setdefault(r.record_id, []).append((r.library_id, r.start, r.hit))
        for key, sequence, topology in molecules:
            want = sorted((i, s, h) for i, q in queries for s, h in brute_hits(sequence, topology, q))
            assert sorted(got.get(key, [])) == want, (key, step)


def test_superseded_over_the_origin_and_folding(spark):
    a = dna(random.Random(8), 60)
    lib = entries(spark, ("long", "L", a, True, "fam"), ("short", "S", a[10:40], True, "fam"), ("other", "O", a[5:30], True, "oth"))
    found = D.rank_matches(D.detect_features(records(spark, ("c", a[30:] + "CCCCCCCCCC" + a[:30], "circular")), lib))
    for width in (8, 4096):
        folded = D.superseded_by(found, width)
        by = {r.library_id: (r.match_index, r.superseded_by) for r in folded.collect()}
        assert by["short"][1] == by["long"][0] and by["long"][1] is None and by["other"][1] is None
        proposals = {r.library_id: (r.variants, r.contained_in) for r in D.fold_proposals(folded, width).collect()}
        assert proposals["long"] == (1, None) and proposals["other"] == (0, by["long"][0])


def test_import_outcomes(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2")], "source_path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "2"), ("d", "7"), ("e", "7")], "source_path string, sha256 string")
    assert rows(L.classify_sources(new, known), "source_path", "outcome", "duplicate_of") == [
        ("a", "unchanged", None), ("b", "replaced", None), ("c", "duplicate", "b"), ("d", "imported", None), ("e", "duplicate", "d")]


def test_names_aliases_and_curation(spark):
    schema = ("source_path string, feature_ord int, label string, kind string, color string, qualifiers array<struct<key:string,value:string>>, "
              "sequence string, canonical string, stranded boolean, start int, parts int")
    s = "ACCGTTAGGCATTACG"
    occ = spark.createDataFrame([
        ("f1", 1, "AmpR", "CDS", None, [], s, min(s, rc(s)), True, 0, 1), ("f2", 1, "bla", "CDS", None, [], rc(s), min(s, rc(s)), True, 4, 1),
        ("f3", 1, "bla", "gene", "#111111", [], rc(s), min(s, rc(s)), False, 4, 1)], schema)
    lib = L.derive_features(occ)
    one = lib.collect()[0]
    assert (one.name, one.kind, one.color, one.stranded, one.sequence, one.occurrences) == ("bla", "CDS", "#111111", True, rc(s), 3)
    assert [r.aliases for r in L.aliases(lib, occ).collect()] == [["AmpR"]]
    edits = spark.createDataFrame([(one.library_id, 1, "x", None, None, None), (one.library_id, 2, "y", None, True, None)],
                                  "library_id string, edited_at int, name string, kind string, hidden boolean, standalone boolean")
    assert rows(L.curate(lib, edits), "name", "status") == [("y", "hidden")]


def brute_families(items):
    """One by one, longest first: the definition."""
    def edits(short, long, limit):
        row = [0] * (len(long) + 1)
        for i, a in enumerate(short, 1):
            nxt = [i]
            for j, b in enumerate(long, 1):
                nxt.append(min(row[j - 1] + (a != b), row[j] + 1, nxt[-1] + 1))
            row = nxt
        return min(row) if min(row) <= limit else None

    heads, links = [], {}
    for key, name, seq in sorted(items, key=lambda x: (-len(x[2]), x[0])):
        for hk, hname, hseq in heads:
            if len(seq) * 5 < len(hseq) * 4:
                continue
            if len(seq) < len(hseq) and (seq in hseq or rc(seq) in hseq):
                links[key] = (hk, "contained")
                break
            limit = int((1 - 0.97) * len(seq))
            if name == hname and len(seq) >= 100 and any(edits(s, hseq, limit) is not None for s in (seq, rc(seq))):
                links[key] = (hk, "similar_dna")
                break
        else:
            heads.append((key, name, seq))
    return links


def test_families_match_the_sequential_definition(spark):
    rng = random.Random(21)
    items = []
    for g in range(4):
        base = dna(rng, 130)
        mutant = base[:60] + base[60].translate(str.maketrans("ACGT", "CATG")) + base[61:]
        shorter = base[4:120]
        items += [(f"{g}a", f"p{g}", base), (f"{g}b", f"p{g}", mutant), (f"{g}c", "other", shorter), (f"{g}d", "else", mutant[:40] + "T" + mutant[41:]),
                  (f"{g}e", f"p{g}", rc(base[:58] + base[60:])), (f"{g}f", "tiny", base[10:21]), (f"{g}g", "tiny", base[10:20])]
    items = list({q: (k, n, q) for k, n, q in items}.values())
    table = spark.createDataFrame([(k, q, "misc_feature", [n], False, k) for k, n, q in items],
                                  "library_id string, sequence string, kind string, names array<string>, standalone boolean, first_seen string")
    got = {r.member: (r.head, r.relation) for r in V.compute_families(table).collect()}
    assert got == brute_families(items)
    assert V.stale(V.compute_families(table)).count() == 0


def test_long_variants_of_one_name(spark):
    rng = random.Random(8)
    items = []
    for g in range(6):
        base = dna(rng, 240)
        near = base[:100] + rc(base[100]) + base[101:]
        items += [(f"{g}a", "hot", base), (f"{g}b", "hot", near), (f"{g}c", "hot", rc(near[:50] + near[51:])), (f"{g}d", "hot", base[:235]),
                  (f"{g}e", "hot", "".join(rc(c) if i % 15 == 7 else c for i, c in enumerate(base)))]
    table = spark.createDataFrame([(k, q, "misc_feature", [n], False, k) for k, n, q in items],
                                  "library_id string, sequence string, kind string, names array<string>, standalone boolean, first_seen string")
    got = {r.member: (r.head, r.relation) for r in V.compute_families(table).collect()}
    assert got == brute_families(items)


def test_codon_variants_and_standalone_parts(spark):
    rng = random.Random(3)
    codons = [c for c in (a + b + d for a in "ACGT" for b in "ACGT" for d in "CT") if c not in ("TAC", "TAT")]
    base = "".join(rng.choice(codons) for _ in range(110))
    other = "".join(base[i : i + 2] + {"C": "T", "T": "C"}[base[i + 2]] for i in range(0, 330, 3))
    rows_ = [("a", base, "CDS", ["X-1"], False, "1"), ("b", other, "cds", ["x 1"], False, "2"), ("c", other, "gene", ["x1"], False, "3"),
             ("d", base[:300], "CDS", ["y"], True, "4"), ("e", base[3:300], "CDS", ["y"], False, "5"), ("f", other[3:], "CDS", ["z"], False, "6")]
    table = spark.createDataFrame(rows_, "library_id string, sequence string, kind string, names array<string>, standalone boolean, first_seen string")
    got = {r.member: (r.head, r.relation) for r in V.compute_families(table).collect()}
    assert got == {"b": ("a", "same_protein"), "e": ("a", "contained"), "f": ("c", "contained")}


def test_regrouping_is_due_after_any_change_of_the_parts(spark):
    schema = "library_id string, sequence string, kind string, names array<string>, standalone boolean, first_seen string"
    parts = [("a", "ACGTACGTACGTACGT", "CDS", ["x", "X 1"], False, "1"), ("b", "ACGTACGTACGTACG", "gene", ["y"], False, "2"), ("b2", "TTGTACGTACGTACG", "gene", [], False, "2")]
    frame = lambda rows_: spark.createDataFrame(rows_, schema)
    stored = V.fingerprint(frame(parts))

    def due(rows_, known=stored):
        return tuple(V.regrouping_due(known, frame(rows_)).first())

    assert due(parts) == (False, None) and due(parts[::-1]) == (False, None)
    assert due([(*parts[0][:3], ["X-1", "x"], *parts[0][4:]), *parts[1:]]) == (False, None)  # equal names, folded
    changed = (True, "the parts have changed")
    assert due([*parts, ("c", "GGGTACGTACGTACGT", "CDS", ["z"], False, "3")]) == changed  # import
    assert due(parts[1:]) == changed  # hide
    assert due([(*parts[0][:4], True, "1"), *parts[1:]]) == changed  # regroup
    assert due([(*parts[0][:3], ["other"], False, "1"), *parts[1:]]) == changed  # rename
    assert due(parts, V.fingerprint(frame([]))) == changed and due([], V.fingerprint(frame([]))) == (False, None)
    assert due(parts, stored.withColumn("rule", F.lit("families v1"))) == (True, "made under another rule")
    assert due(parts, stored.limit(0)) == (True, "families were never made")


def test_contained_pairs_need_no_alignment(spark):
    """Pairs of parts in one another come from their own seeds; proteins and alignments are left to the other relations."""
    from strandlake.operators.families import related_pairs
    from strandlake.plans import all_queries
    from strandlake.plans.library_queries import _family_input
    from strandlake.plans.testtables import variants

    plan = all_queries()["library_family_pairs_contained"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    for features in (variants(spark, "/root/testdata/sf0.001"), _family_input(spark, "/root/testdata/sf0.001")):
        every = related_pairs(features).where("relation = 'contained'").collect()
        assert every and sorted(map(tuple, related_pairs(features, contained_only=True).collect())) == sorted(map(tuple, every))


def test_detection_with_seeds_of_all_sizes_at_once(spark):
    """Entries of every length from the shortest seed on, at both ends of linear molecules and over the origin of circles."""
    rng = random.Random(31)
    a, b, c = dna(rng, 90), dna(rng, 61), dna(rng, 20)
    molecules = [("lin", a, "linear"), ("circ", b, "circular"), ("small", c, "circular"), ("rep", "ACG" * 25, "linear")]
    queries = [a[:12], a[-12:], a[-13:], a[:15], a[-16:], rc(a[:16]), a[-23:], a[-24:], rc(a[-25:]), a, b[-7:] + b[:9], rc(b[-20:] + b[:7]), b, c, c[9:] + c[:9], "ACG" * 9, "ACG" * 5, a[30:54], a[30:53]]
    queries = list(dict.fromkeys(queries))
    lib = entries(spark, *[(f"q{i}", f"q{i}", q, True, "f") for i, q in enumerate(queries)])
    for step in (16, 8192):
        got = sorted((r.record_id, r.library_id, r.start, r.hit) for r in D.detect_features(records(spark, *molecules), lib, step=step).collect())
        assert got == sorted((k, f"q{i}", s, h) for k, t, top in molecules for i, q in enumerate(queries) for s, h in brute_hits(t, top, q))


def test_chance_windows_do_not_grow_with_the_library(spark, monkeypatch):
    """F8-F11: with seeds of twelve letters, windows that hold one by chance grew with bases x entries."""
    seen = []
    join = D.attach_bases

    def counted(hits, *a, **kw):
        seen.append(hits.count())
        return join(hits, *a, **kw)

    monkeypatch.setattr(D, "attach_bases", counted)
    bases = "translate(concat({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    text = bases.format(", ".join(f"md5(concat(id, '-', {i}))" for i in range(16)))
    table = spark.range(3000).selectExpr("cast(id as string) as record_id", f"{text} as sequence", "512L as length", "'circular' as topology")
    lib = spark.range(60000).selectExpr("cast(id as string) as library_id", "'n' as name", "'k' as kind", "'f' as family_id", "true as stranded", f"{bases.format("md5(cast(id as string))")} as sequence", "'imported' as status")
    assert D.detect_features(table, lib).count() == 0 and seen[0] < 100


def test_matches_are_computed_once_for_their_annotations(spark):
    """F8: matches were computed for the spans they share and again for the result."""
    from strandlake.plans import all_queries

    plan = all_queries()["detect_annotated_as"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"SortMergeJoin \[(?:key|seed)#", plan.split("Initial Plan")[-1])) == 1


def test_candidates_take_the_length_of_the_record_with_the_bases(spark):
    """features were shuffled by record and joined to all records anew for the length alone."""
    from strandlake.plans import all_queries

    for name in ("library_candidates", "library_skip_reasons"):
        plan = all_queries()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("REPARTITION_BY_NUM") == 2, name
