import math
import random
from collections import Counter, defaultdict

import pytest

from strandlake.llm import quality


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney, straight from its definition, over ids as the operator has them."""
    grams = lambda t: [tuple([2] * (order - 1) + [ord(c) for c in t] + [3])[i : i + order] for i in range(len(t) + 1)]
    counts = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, free = {}, {}, {}
    for k, own in counts.items():
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
        discount[k] = [min(max(x, 0.1), i - 0.05) for i, x in zip((1, 2, 3), d)]
        total[k], free[k] = defaultdict(float), defaultdict(float)
        for g, c in own.items():
            total[k][g[:-1]] += c
            free[k][g[:-1]] += discount[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 4096
        if g[:-1] not in total[k]:
            return below
        c = counts[k].get(g, 0)
        own = (c - discount[k][min(c, 3) - 1]) / total[k][g[:-1]] if c else 0.0
        return own + free[k][g[:-1]] / total[k][g[:-1]] * below

    return lambda t: sum(math.log(p(g)) for g in grams(t))


def words(r, n):
    return " ".join("".join(r.choice(["the", "ing", "on", "er", "ati"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_log_probabilities_are_those_of_the_definition(spark, docs_of):
    r = random.Random(2)
    trusted = [words(r, 20) for _ in range(12)]
    texts = {1: words(r, 15), 2: "ZZ!! the", 3: "", 4: None, 5: "é the ing", 6: trusted[0]}
    model = quality.Model(docs_of(dict(enumerate(trusted))))
    want = brute_model(trusted, quality.ORDER)
    got = {x.doc_id: x for x in quality.score(docs_of(texts), model).collect()}
    for i, t in texts.items():
        assert got[i].tokens == len(t or "") + 1
        assert got[i].logp == pytest.approx(want(t or ""), rel=1e-9)


def test_junk_goes_and_clean_documents_stay(spark, docs_of):
    r = random.Random(3)
    rows = [(i, words(r, r.randrange(20, 120)), "s", r.choice(["en", "xx", None])) for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in words(r, 60).split()), "s", "en") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)] + [(1000 + i, 0, 0) for i in range(10)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + junk + [(5000, None, "s", "en"), (5001, "", "s", None), (7, rows[7][1], "s", "en")])
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(junk) + 3
    assert not any(x.kept for x in got if x.doc_id in range(1000, 1040))
    assert sum(x.kept for x in got if x.doc_id < 1000) >= 398
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns and out.where("doc_id between 1000 and 1039").isEmpty()


def test_without_trusted_documents_all_stay(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of({1: "a", 2: None})
    assert [x.kept for x in quality.classify(docs, labels).collect()] == [True, True]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_long_text_and_chunks_agree():
    text = "abc def " * 200_000
    one = [g.sum() for g, _ in quality.gram_chunks([text, "x"])]
    sizes = [n.tolist() for _, n in quality.gram_chunks([text, "x", None])]
    assert sum(sizes, []) == [len(text) + 1, 2, 1] and len(one) == 2


def test_all_trusted_documents_are_fitted_or_held_out(spark, docs_of):
    n = 200_500
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    roles = quality.trusted_roles(labels)
    held = roles.where("held_out").count()
    assert roles.count() == n and abs(held - n / 5) < 2000
    docs = docs_of({1: "abc", 2: None, n + 1: "not trusted", None: "no id"})
    fitted = roles.where("doc_id in (1, 2)").selectExpr("doc_id", "false as held_out")
    assert sorted(x.text or "" for x in quality.trusted_texts(docs, fitted).collect()) == ["", "abc"]


def test_the_cut_is_the_quantile_where_the_sample_holds_it(spark, docs_of):
    r = random.Random(4)
    docs = docs_of({i: words(r, r.randrange(40, 120)) for i in range(700)})
    labels = spark.range(700).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    held = {x.doc_id for x in quality.trusted_roles(labels).where("held_out").collect()}
    got = quality.classify(docs, labels).collect()
    scores = sorted(x.score for x in got if x.doc_id in held)
    assert len(scores) >= quality.RESOLVED
    assert scores[0] <= got[0].low <= scores[3] and scores[-4] <= got[0].high <= scores[-1]
