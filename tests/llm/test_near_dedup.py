import random

import numpy as np
from tests.llm import brute

from strandlake.llm import common, near_dedup, shingles


def collection(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(4):
        base = [r.choice(words) for _ in range(200)]
        for _ in range(30):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
                own[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(own))
    passage = [r.choice(words) for _ in range(60)]
    for _ in range(40):
        own = [r.choice(words) for _ in range(100)]
        texts.append(" ".join(own[:30] + passage + own[30:]))
    texts += [" ".join(passage)] * 10 + [" ".join(passage).upper() + "\t\n"] * 3
    texts += ["", None, " \n", "a b", "A  b", "a b c d e", "a b\u00a0c d e"]
    return dict(enumerate(texts))


def test_components_equal_those_of_all_pairs(spark, docs_of):
    texts = collection()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs_of(texts)).collect()}
    assert got == brute.near_duplicates(texts)


def test_null_ids_repeats_and_no_rows(spark, docs_of):
    docs = docs_of([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (1, None), (1, None)])
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [
        (0, 0, True), (0, 3, False), (1, 1, True), (1, 1, True), (3, 3, True), (3, 3, True)]
    out = near_dedup.representatives(docs)
    assert out.columns == docs.columns and out.count() == 5
    assert near_dedup.near_duplicates(docs_of({}).limit(0)).count() == 0


def test_shingle_sets_count_like_words():
    texts = [t for t in collection(9).values()]
    sizes = [len(s) for s in shingles.shingle_sets(texts, 5)]
    assert sizes == [len(brute.shingles(t)) for t in texts]


def test_long_text_in_one_chunk():
    text = " ".join(f"x{i}" for i in range(600_000))
    sets = list(shingles.shingle_sets(["a b c d e f", text, "a b c d e f"], 5))
    assert [len(s) for s in sets] == [2, 599_996, 2] and (sets[0] == sets[2]).all()
    assert len(shingles.signature(sets[1], *shingles.maps(16))) == 16 and np.all(np.diff(sets[1].astype(object)) > 0)


def test_a_round_of_components_is_planned_once(spark, monkeypatch):
    """Unions of a table with itself planned each round several times over, which filled the driver of long runs."""
    plans, keep = [], common.keep

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(common, "keep", seen)
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (6, 2)], "src long, dst long")
    found = common.components(edges).collect()
    assert sorted(map(tuple, found)) == [(2, 2), (3, 2), (4, 2), (5, 2), (6, 2), (8, 8), (9, 8)]
    assert max(p.count("HashAggregate(") for p in plans) <= 12


def test_rest_meets_only_sets_that_may_be_near(spark):
    """Many texts of one kind, most pairs alike by 0.6 to 0.75: these became rows of the join, with the group's square."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passages = [[[r.choice(words) for _ in range(12)] for _ in range(4)] for _ in range(15)]
    base = [r.choice(words) for _ in range(9)]
    kept = [r.randrange(4) for _ in passages]
    texts = [[w for p, k in zip(passages, kept) for w in [*p[k if r.random() < 0.85 else r.randrange(4)], *base]] for _ in range(120)]
    texts = [" ".join(t) for t in texts] + [" ".join(r.choice(words) for _ in range(n)) for n in (3, 5, 300)]
    rest = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, component long")
    found = near_dedup._rest_pairs(rest, spark.createDataFrame(list(enumerate(texts)), "node long, text string"), 5, 80)
    got = [(min(p), max(p)) for p in found.collect()]
    sets = [brute.shingles(t) for t in texts]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(texts)) for a in range(b)}
    near = {p for p, share in alike.items() if share >= 0.8}
    assert near and near <= set(got)
    assert len(set(got) - near) <= sum(0.7 <= share < 0.8 for share in alike.values()) < sum(0.5 <= share < 0.8 for share in alike.values()) / 2
