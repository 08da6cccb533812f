from pyspark.sql import functions as F

from strandlake.operators import annotation as A
from strandlake.operators import ends as E
from strandlake.operators import ligation as L
from strandlake.operators import restriction as R
from tests.helpers import parts, rc, records, rows


def plan_for(fragments, topology, turned=()):
    return fragments.select(
        F.col("record_id").alias("plan_id"), F.col("fragment_ord").alias("ord"), F.lit(1).alias("input"), F.lit(1).alias("inputs"), "record_id", "fragment_id",
        F.when(F.col("fragment_ord").isin(*turned or [-1]), "reverse").otherwise("forward").alias("orientation"), F.lit(topology).alias("topology"))


def test_end_reasons(spark):
    table = spark.createDataFrame(
        [("five_prime", "ACGA", "five_prime", "TCGT"), ("blunt", "", "blunt", ""), ("five_prime", "AA", "three_prime", "TT"),
         ("five_prime", "AAA", "five_prime", "TT"), ("five_prime", "AAC", "five_prime", "AAC")], "a string, b string, c string, d string")
    assert [r[0] for r in table.select(E.end_reason("a", "b", "c", "d")).collect()] == [
        "complementary_overhangs", "blunt_ends", "polarity_mismatch", "overhang_length_mismatch", "overhang_sequence_mismatch"]


def test_partner_counts_equal_the_matrix(spark):
    frags = R.digest(records(spark, ("r", "AAAGAATTCTTTGGATCCAAAGAATTCAACCCGGGTT", "linear")), ["EcoRI", "BamHI", "SmaI"])
    ends = E.endpoints(frags)
    assert E.invalid_ends(ends).count() == 0
    pairs = E.end_pair_matrix(ends).where("compatible").collect()
    expected = {}
    for p in pairs:
        for e in (p.first, p.second):
            expected[e] = expected.get(e, 0) + 1
    got = {r.end_id: r.partners for r in E.partner_counts(ends).collect() if r.partners}
    assert got == expected


def test_circular_closure_phases(spark):
    for enzyme, phase in (("EcoRI", 4), ("KpnI", 8), ("EcoRV", 0)):
        site = {"EcoRI": "GAATTC", "KpnI": "GGTACC", "EcoRV": "GATATC"}[enzyme]
        frags = R.digest(records(spark, ("r", f"AAA{site}TTT", "circular")), [enzyme])
        made = L.ligate(plan_for(frags, "circular"), frags).collect()
        assert [m.bottom_forward_start for m in made] == [phase]


def test_incompatible_and_invalid_plans(spark):
    frags = R.digest(records(spark, ("r", "AAAGAATTCTTTCCCGGATCCAAA", "linear")), ["EcoRI", "BamHI"])
    out = L.ligation_outcomes(plan_for(frags, "linear", turned=(2,)), frags).collect()[0]
    assert out.reason.startswith("junction after component 1: overhang_sequence_mismatch")
    good = L.ligate(plan_for(frags, "linear"), frags).collect()[0]
    assert good.top_sequence == "AAAGAATTCTTTCCCGGATCCAAA"
    twice = plan_for(frags, "linear").unionByName(plan_for(frags, "linear"))
    assert [r.reason for r in L.ligation_rejects(twice, frags).collect()] == ["fragment reused"]


def test_feature_projection(spark):
    table = records(spark, ("r", "AAAGAATTCTTT", "linear"), ("c", "AAAGAATTCTTT", "circular"))
    frags = R.digest(table, ["EcoRI"])
    feature = parts(spark, ("r", "f", 0, 2, 8, "forward"), ("c", "f", 0, 2, 8, "forward"))
    for width in (4, 16384):
        mapped = A.annotated_digest(feature, frags, width).where("not bottom")
        assert rows(mapped.where("record_id = 'r'"), "interval_id", "retained_bases") == [("fragment-0001", 2), ("fragment-0002", 6)]
        split = mapped.where("record_id = 'c'").collect()
        assert len(split) == 1 and split[0].complete and split[0].split_source_parts == [0]


def test_classes_of_a_thousand_ends(spark):
    ends = spark.range(1000).selectExpr(
        "'g' as group_id", "if(id % 2 = 0, 'five_prime', 'blunt') as polarity", "if(id % 2 = 0, 'AATT', '') as overhang", "cast(id as string) as end_id")
    got = {(r.first_polarity, r.second_polarity): (r.pairs, r.compatible) for r in E.end_pair_classes(ends).collect()}
    assert got == {("blunt", "blunt"): (124750, True), ("blunt", "five_prime"): (250000, False), ("five_prime", "five_prime"): (124750, True)}


def test_plan_of_two_hundred_components_is_not_refused(spark):
    plan = spark.range(200).selectExpr("'p' as plan_id", "id as ord", "cast(id + 1 as int) as input", "200 as inputs", "'fragment-0001' as fragment_id")
    assert L.plan_rejects(plan).count() == 0


def test_partners_of_a_common_end_are_found_in_many_tasks(spark):
    """all pairs of one kind of ends were made by one task."""
    rows_ = [(f"g{i}", f"e{i}", "five_prime" if i % 5 else "blunt", "" if i % 5 == 0 else "AATT" if i % 7 else "GGCC" if i % 2 else "ACCA", "left") for i in range(300)]
    table = spark.createDataFrame(rows_, "group_id string, end_id string, polarity string, overhang string, side string").repartition(4)
    wanted = table.where("group_id < 'g2'")
    made = E.compatible_partners(wanted, table, block=20)
    turn = lambda p, x: x if p == "blunt" else rc(x)
    want = sorted((a[0], a[1], b[0], b[1]) for a in rows_ if a[0] < "g2" for b in rows_ if a[2] == b[2] and turn(a[2], a[3]) == b[3] and a[:2] != b[:2])
    assert rows(made, "wanted_group", "wanted_end", "group_id", "end_id") == want
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        common = E.compatible_partners(wanted, table, block=20).where("overhang = 'AATT'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(common) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in common) < 0.6 * sum(r["count"] for r in common)
