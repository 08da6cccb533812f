import random
from collections import defaultdict

import pytest
from tests.llm import brute

from strandlake.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] >= 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= set(over)


def test_targets_and_taken_words(spark, docs_of):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 60))), r.choice(["a", "b", "B", "é", "z", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(None, "one two", "a"), (5000, None, "a"), (5001, " \t", "b"), (1, "one", "a")]
    df = docs_of([(i, t, s) for i, t, s in rows])
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += brute.size(t)
    want = targets(dict(sizes))
    taken = defaultdict(int)
    for r_ in out:
        taken[r_.source] += r_.taken
        assert r_.taken in (0, r_.size, 2 * r_.size) and r_.target == pytest.approx(want[r_.source]) and r_.source_size == sizes[r_.source]
    for s in want:
        assert abs(taken[s] - want[s]) <= 60, s
    assert sum(taken.values()) <= sum(want.values()) + 1e-3
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda rows_: sorted((x.doc_id or -1, x.text_key, x.taken) for x in rows_)
    assert key(out) == key(again)


def test_positions_follow_virtual_finish_times(spark, docs_of):
    out = mixing.mix(docs_of([(i, "a b c", "s" if i % 3 else "t") for i in range(60)])).where("copies > 0").collect()
    starts = sorted(r.position for r in out)
    assert starts[0] == 0 and len(set(starts)) == len(starts)


def test_mixed_rows_repeat_documents(spark, docs_of):
    docs = docs_of([(1, "a b", "x"), (2, "c d", "y"), (3, None, "y")])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert all(r.text for r in out.collect()) and out.count() <= 4


def test_empty_texts_and_no_rows(spark, docs_of):
    out = mixing.mix(docs_of([(1, None, None), (2, "", "a")])).collect()
    assert [(r.size, r.taken) for r in out] == [(0, 0)] * 2
    assert mixing.mix(docs_of({}).limit(0)).count() == 0
